"""Near copies among vectors by an inverted multi-index.

Vectors are cut in halves, and each half has a codebook of its own; the product of both is a grid of cells, and every vector is indexed in its
cell. A query visits cells by the sum of its squared distances to both half centroids, smallest first (multi-sequence order), as far as a
stated share of the true neighbours of sampled queries needs, each query weighed alike, and of pairs made at the threshold, so that visits
are measured too where no neighbours are met; what it meets there is verified by cosine in double precision.

Equal vectors are one node with a count. Each vector visits cells as a query. A link found from both ends counts once: a cell's rows know
which cells their owner visits. Neighbouring cells are one part of a bounded number of index rows, and a vector goes to each part once, with the
cells that it visits there. Larger cells are cut into blocks, and queries go to all blocks. Queries come in streams; nothing is gathered
beyond a part, and no pair is ever a row. Classes come from spanning edges, fewer than the rows of a part.

Vectors travel as they were stored, many of one part in one row. Parts are dealt out in rounds, and what a round has shuffled goes before the
next, so the disk follows the table and not the visits.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are classes of their own. Vectors of
different lengths do not link. The codebooks and the number of visits are fitted on bounded samples (`fit_rows`, `probe_rows`), every vector
is indexed. Rows with equal or null ids are judged by their own vector. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entiform.functions.storage import Scratch
from entiform.llm.common import by_value, share
from entiform.llm.graph import classes, members

#: Index rows of a part, unless fewer and larger parts are enough for all cores; and queries that are compared with them at once.
BLOCK = 4_096
PARTS_PER_CORE = 8
_CHUNK = 4_096
_STEP = 512
#: Bytes of vectors in double precision that a task holds at once, and similarities.
_HELD = 32 << 20
_NEAR = 1 << 21
#: What a round may shuffle: so many bytes, or so many times the bytes of all vectors.
ROUND_BYTES = 64 << 20
ROUND_TIMES = 1
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def unit(values) -> np.ndarray | None:
    """The vector in double precision with length one, or None if it has no direction."""
    if values is None or len(values) == 0:
        return None
    v = np.array([math.nan if x is None else x for x in values], np.float64) if isinstance(values, list) else np.asarray(values, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / np.sqrt((v * v).sum())


@dataclass
class MultiIndex:
    """Codebooks of both halves by vector length, and the cells that a query visits."""

    books: dict[int, tuple[np.ndarray, np.ndarray]]
    visits: int = 1

    @property
    def number(self) -> np.dtype:
        """Number type of a cell."""
        return np.dtype(np.uint16 if all(len(a) * len(b) <= 1 << 16 for a, b in self.books.values()) else np.int32)

    def _distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        half = x.shape[1] // 2
        for part, book in zip((x[:, :half], x[:, half:]), self.books.get(x.shape[1]) or (np.zeros((1, half)), np.zeros((1, x.shape[1] - half)))):
            out.append((part ** 2).sum(1)[:, None] - 2 * part @ book.T + (book ** 2).sum(1)[None, :])
        return out[0], out[1]

    def order(self, x: np.ndarray, visits: int) -> np.ndarray:
        """Cells in the order of their visit, for each row of `x`. Only the first `visits` of each side can be among them."""
        a, b = self._distances(x)
        visits = min(visits, a.shape[1] * b.shape[1])
        near_a, near_b = np.argsort(a, 1, kind="stable")[:, :visits], np.argsort(b, 1, kind="stable")[:, :visits]
        # The k-th of one side with the l-th of the other comes after k * l cells, so it need not be looked at if these are too many.
        k, at = np.nonzero(np.arange(1, near_a.shape[1] + 1)[:, None] * np.arange(1, near_b.shape[1] + 1)[None, :] <= visits)
        total = np.take_along_axis(a, near_a, 1)[:, k] + np.take_along_axis(b, near_b, 1)[:, at]
        first = np.argsort(total, 1, kind="stable")[:, :visits]
        return np.take_along_axis(near_a[:, k] * b.shape[1] + near_b[:, at], first, 1)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids of at most `k` groups."""
    rng = np.random.default_rng(seed)
    book = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((book ** 2).sum(1)[None, :] - 2 * x @ book.T).argmin(1)
        count = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


def _element(df: DataFrame, vector: str) -> np.dtype:
    """Number type in which vectors are kept: as the column has it, or double precision."""
    kind = df.schema[vector].dataType
    return np.dtype(np.float32 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else np.float64)


def units(x: np.ndarray) -> np.ndarray:
    """The rows of `x` as `unit` gives them."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    x /= np.sqrt((x * x).sum(1))[:, None]
    return x


def directions(df: DataFrame, name: str, vector: str) -> DataFrame:
    """(name, key, dim, body): a key of equal unit vectors, and the vector in the number type of its column."""
    kind = _element(df, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            keys, dims, bodies = ([None] * len(column) for _ in range(3))
            flat = column.flatten()
            if not flat.null_count and pa.types.is_floating(flat.type):
                values, sizes = flat.to_numpy(), pc.list_value_length(column).fill_null(0).to_numpy()
                starts = np.cumsum(sizes) - sizes
                for d in np.unique(sizes[sizes > 0]):
                    here = np.flatnonzero(sizes == d)
                    x = values[starts[here][:, None] + np.arange(d)]
                    good = np.isfinite(x).all(1) & (x != 0).any(1)
                    here, x = here[good], x[good]
                    for k, v, u in zip(here, np.ascontiguousarray(x, kind), units(x)):
                        keys[k], dims[k], bodies[k] = hashlib.blake2b(u.tobytes(), digest_size=16).digest(), int(d), v.tobytes()
            else:
                for k, v in enumerate(column.to_pylist()):
                    if (u := unit(v)) is not None:
                        keys[k], dims[k], bodies[k] = hashlib.blake2b(u.tobytes(), digest_size=16).digest(), len(u), np.array(v, kind).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(bodies, pa.binary())],
                [batch.schema.names[0], "key", "dim", "body"])

    return df.select(name, vector).mapInArrow(run, f"`{name}` {df.schema[name].dataType.simpleString()}, key binary, dim int, body binary")


def _matrix(bodies: list[bytes], kind: np.dtype) -> np.ndarray:
    return units(np.frombuffer(b"".join(bodies), kind).reshape(len(bodies), -1))


def _values(column: pa.Array, here: np.ndarray, kind) -> np.ndarray:
    """The rows `here` of a binary column without nulls, which are equally long, as rows of a matrix."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets, data = np.frombuffer(offsets, wide)[column.offset:column.offset + len(column) + 1], np.frombuffer(data, np.uint8)
    size = offsets[here[0] + 1] - offsets[here[0]]
    if len(here) == len(column):
        return data[offsets[0]:offsets[-1]].reshape(len(here), size).view(kind)
    return data[offsets[here][:, None] + np.arange(size)].view(kind)


def made_ranks(index: MultiIndex, x: np.ndarray, threshold: float, cells: int, times: int = 16, seed: int = 11) -> np.ndarray:
    """For pairs of each vector with itself turned to the threshold: visits after which one of both finds the other."""
    rng, ranks = np.random.default_rng(seed), []
    if x.shape[1] < 2:
        return np.ones(0, np.int64)
    there = index.order(x, cells)
    home = there[:, 0]
    there = np.argsort(there, 1)
    for _ in range(times):
        side = rng.normal(size=x.shape)
        side -= (side * x).sum(1)[:, None] * x
        side /= np.linalg.norm(side, axis=1)[:, None]
        back = index.order(threshold * x + math.sqrt(max(0.0, 1 - threshold ** 2)) * side, cells)
        ranks.append(np.minimum(there[np.arange(len(x)), back[:, 0]], (back == home[:, None]).argmax(1)) + 1)
    return np.concatenate(ranks)


def fit(nodes: DataFrame, kind: np.dtype, threshold: float, target: float, per_cell: int, fit_rows: int, probe_rows: int) -> MultiIndex:
    """Codebooks from at most `fit_rows` vectors, and visits that find `target` of the links of at most `probe_rows` queries, which are
    compared with all vectors, and `target` of pairs that are made from these queries at the threshold."""
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("key")).limit(fit_rows).select("dim", "body").collect()
    side = max(1, min(len(sample) // 8, math.ceil(math.sqrt(n / per_cell))))
    books = {}
    for dim in {r["dim"] for r in sample}:
        x = _matrix([r["body"] for r in sample if r["dim"] == dim], kind)
        books[dim] = k_means(x[:, :dim // 2], side), k_means(x[:, dim // 2:], side)
    index = MultiIndex(books)
    queries = nodes.orderBy(F.xxhash64(F.lit(3), "key")).limit(probe_rows).select("dim", "key", "body").collect()
    asked = {dim: _matrix([r["body"] for r in queries if r["dim"] == dim], kind) for dim in {r["dim"] for r in queries}}
    cells = max((len(a) * len(b) for a, b in books.values()), default=1)
    given = share(nodes.sparkSession, (index, asked, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, probes, most = given()
        ranks = {d: np.argsort(model.order(q, most), 1) for d, q in probes.items()}  # rank of each cell for each query
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d, q in probes.items():
                here = np.flatnonzero(dims == d)
                if not len(here):
                    continue
                x = units(_values(batch.column("body"), here, kind))
                near = q @ x.T
                row, col = np.nonzero((near >= threshold) & (near < 1 - 1e-12))
                if len(row):
                    met, at = np.unique(col, return_inverse=True)
                    rank, count = np.unique(np.column_stack([row, ranks[d][row, model.order(x[met], 1)[at, 0]]]), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([int(d)] * len(rank), pa.int64()), pa.array(rank[:, 0]), pa.array(rank[:, 1]), pa.array(count, pa.int64())], ["dim", "probe", "rank", "n"])

    met = nodes.select("dim", "body").mapInArrow(run, "dim bigint, probe bigint, rank bigint, n bigint").groupBy("dim", "probe", "rank").agg(F.sum("n").alias("n")).collect()
    links_of: dict[tuple[int, int], int] = {}
    for r in met:
        links_of[r["dim"], r["probe"]] = links_of.get((r["dim"], r["probe"]), 0) + r["n"]
    met = sorted((r["rank"], r["n"] / links_of[r["dim"], r["probe"]]) for r in met)  # the links of each probe weigh one together
    index.visits, seen = 4, 0.0
    for rank, part in met:
        seen += part
        if seen >= target * len(links_of) - 1e-9:
            index.visits = max(index.visits, rank + 1)
            break
    for d, q in asked.items():
        made = np.sort(made_ranks(index, q, threshold, cells))
        if len(made):
            index.visits = max(index.visits, int(made[min(len(made) - 1, math.ceil(target * len(made)) - 1)]))
    return index


def routed(nodes: DataFrame, kind: np.dtype, index: MultiIndex) -> DataFrame:
    """Adds `own`, the cell of each vector, and `route`, the cells that it visits, its own first."""
    given = share(nodes.sparkSession, index)
    names = [*nodes.columns, "own", "route"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given()
        for whole in batches:
            for at in range(0, whole.num_rows, _STEP):
                batch = whole.slice(at, _STEP)
                dims = batch.column("dim").to_numpy()
                own, route = np.zeros(len(dims), np.int32), [b""] * len(dims)
                for d in np.unique(dims):
                    here = np.flatnonzero(dims == d)
                    order = model.order(units(_values(batch.column("body"), here, kind)), model.visits).astype(model.number)
                    own[here] = order[:, 0]
                    for k, cells in zip(here, order):
                        route[k] = cells.tobytes()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(route, pa.binary())], names)

    return nodes.mapInArrow(run, T.StructType([*nodes.schema.fields, T.StructField("own", T.IntegerType()), T.StructField("route", T.BinaryType())]))


@dataclass
class Parts:
    """By vector length and cell: the first part that holds the cell, and the blocks that it is cut into (none where nothing is indexed)."""

    first: dict[int, np.ndarray]
    blocks: dict[int, np.ndarray]
    count: int = 0

    @classmethod
    def of(cls, sizes: list[tuple[int, int, int]], cells: dict[int, int], row: dict[int, int], most: int) -> Parts:
        """`sizes`: (length, cell, index rows). A part is a run of cells of `most` index rows; cells with one centroid of the first half
        (`row` cells), which a vector often visits together, stay together where they fit."""
        made, first, blocks = 0, {}, {}
        held: dict[int, dict[int, int]] = {}
        for d, cell, n in sizes:
            held.setdefault(d, {})[cell] = n
        for d in sorted(held):
            first[d], blocks[d] = np.zeros(cells.get(d, 1), np.int32), np.zeros(cells.get(d, 1), np.int32)
            bound = max(1, min(most, _HELD // 8 // d))
            lines, line, full = Counter(), -1, bound
            for cell, n in held[d].items():
                lines[cell // row.get(d, 1)] += n
            for cell in sorted(held[d]):
                n, at = held[d][cell], cell // row.get(d, 1)
                if full + (lines[at] if at != line else n) > bound:
                    full, made = 0, made + 1
                line = at
                first[d][cell], blocks[d][cell] = made - 1, max(1, -(-n // bound))
                full, made = full + n, made + blocks[d][cell] - 1
        return cls(first, blocks, int(made))

    def visits(self, d: int, route: np.ndarray, hashes: np.ndarray, take: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, part, cell, indexed) of each visit, or of those to the parts to take; a row is indexed in one block of its first cell."""
        first, blocks = self.first[d], self.blocks[d]
        some = blocks > 0
        if take is not None:
            taken = np.r_[0, np.cumsum(take)]
            some &= taken[first + blocks] > taken[first]
        rows, column = np.nonzero(some[route])
        cells, home = route[rows, column], column == 0
        times = blocks[cells]
        block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        rows, cells, home, times = (np.repeat(x, times) for x in (rows, cells, home, times))
        part, home = first[cells] + block, home & (block == hashes[rows] % np.maximum(1, times))
        return (rows, part, cells, home) if take is None else tuple(x[take[part]] for x in (rows, part, cells, home))


def _hashes(keys: np.ndarray) -> np.ndarray:
    return (keys[:, 0] >> np.uint64(1)).astype(np.int64)


_PACKED = "part int, asks boolean, dim int, n int, keys binary, copies binary, own binary, counts binary, cells binary, routes binary, bodies binary"


def loads(nodes: DataFrame, number: np.dtype, parts: Parts) -> DataFrame:
    """(part, n): vectors that go to each part."""
    given = share(nodes.sparkSession, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given()
        total = np.zeros(model.count, np.int64)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                here = np.flatnonzero(dims == d)
                row, part, _, _ = model.visits(int(d), _values(batch.column("route"), here, number), _hashes(_values(batch.column("key"), here, np.uint64)))
                total += np.bincount(np.unique(part * np.int64(len(here)) + row) // len(here), minlength=model.count)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["part", "n"])

    return nodes.select("key", "dim", "route").mapInArrow(run, "part int, n bigint").groupBy("part").agg(F.sum("n").alias("n"))


def packed(nodes: DataFrame, number: np.dtype, parts: Parts, wanted: np.ndarray) -> DataFrame:
    """Vectors that visit the wanted parts, many of a part in one row: index rows (`asks` is false) and others. Both ask."""
    given = share(nodes.sparkSession, (parts, wanted))
    names = [x.split()[0] for x in _PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, take = given()
        for whole in batches:
            step = max(_STEP, _HELD // 4 // max(1, whole.column("body").nbytes // max(1, whole.num_rows)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                lengths, copies, own = (batch.column(c).to_numpy() for c in ("dim", "copies", "own"))
                for d in np.unique(lengths):
                    here = np.flatnonzero(lengths == d)
                    route, key, body = (_values(batch.column(c), here, t) for c, t in (("route", number), ("key", np.uint64), ("body", np.uint8)))
                    row, part, cell, home = model.visits(int(d), route, _hashes(key), take)
                    if not len(row):
                        continue
                    at_home = np.zeros(len(here), np.int64) - 1  # the part of each vector in which it is indexed
                    at_home[row[home]] = part[home]
                    asks = at_home[row] != part
                    order = np.lexsort((row, asks, part))
                    row, part, cell, asks = row[order], part[order], cell[order], asks[order]
                    starts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(part) != 0)])  # a vector in a part
                    counts = np.diff(np.r_[starts, len(row)]).astype(np.int32)
                    groups = np.flatnonzero(np.r_[True, (np.diff(part[starts]) != 0) | (np.diff(asks[starts].astype(np.int8)) != 0)])
                    out = []
                    many, home_cell = copies[here].astype(np.int64), own[here].astype(np.int32)
                    for low, high in zip(groups, np.r_[groups[1:], len(starts)]):
                        who, first = row[starts[low:high]], starts[low]
                        last = starts[high] if high < len(starts) else len(row)
                        index = not asks[first]
                        out.append((int(part[first]), not index, int(d), len(who), key[who].tobytes(), many[who].tobytes(), home_cell[who].tobytes(), counts[low:high].tobytes(),
                                    cell[first:last].tobytes(), route[who].tobytes() if index else b"", body[who].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.bool_(), pa.int32(), pa.int32(), *[pa.binary()] * 7))], names)

    return nodes.select("key", "copies", "dim", "own", "route", "body").mapInArrow(run, _PACKED)


@dataclass
class _Rows:
    """Vectors in a part: keys, members, own cells, visited cells of the part in one array and their number for each, routes, unit vectors."""

    keys: np.ndarray
    copies: np.ndarray
    own: np.ndarray
    counts: np.ndarray
    cells: np.ndarray
    routes: np.ndarray | None
    x: np.ndarray

    @classmethod
    def of(cls, rows: list[dict], kind: np.dtype, number: np.dtype) -> _Rows:
        def all_of(name: str, t) -> np.ndarray:
            return np.frombuffer(b"".join(r[name] for r in rows), t)

        n, d = sum(r["n"] for r in rows), rows[0]["dim"]
        routes = all_of("routes", number)
        return cls(all_of("keys", "V16"), all_of("copies", np.int64), all_of("own", np.int32), all_of("counts", np.int32), all_of("cells", number),
                   routes.reshape(n, -1) if len(routes) else None, units(all_of("bodies", kind).reshape(n, d)))


def _ranges(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places) of each distinct value."""
    order = np.argsort(values, kind="stable")
    ends = np.flatnonzero(np.diff(values[order])) + 1
    for places in np.split(order, ends) if len(order) else []:
        yield int(values[places[0]]), places


class _Part:
    """Index rows of one part; queries come in chunks."""

    def __init__(self, index: _Rows, threshold: float):
        self.index, self.threshold = index, threshold
        self.at = {k: i for i, k in enumerate(index.keys.tolist())}
        self.cells = {c: (places, np.ascontiguousarray(index.x[places].T)) for c, places in _ranges(index.own)}
        self.back = np.zeros(len(index.keys), np.int64)

    def ask(self, queries: _Rows) -> tuple[np.ndarray, list[tuple[bytes, bytes]]]:
        """(links of the queries, edges as key pairs); adds to `back` the links of index rows that would not find the query themselves."""
        asked, edges = np.zeros(len(queries.keys), np.int64), []
        who, itself = np.repeat(np.arange(len(queries.keys)), queries.counts), np.array([self.at.get(k, -1) for k in queries.keys.tolist()])
        for cell, visits in _ranges(queries.cells):
            places, x = self.cells.get(cell, (None, None))
            if places is None:
                continue
            step = max(1, _NEAR // len(places))
            for low in range(0, len(visits), step):
                rows = who[visits[low:low + step]]
                k, i = np.nonzero(queries.x[rows] @ x >= self.threshold)
                other = places[i] != itself[rows[k]]
                if other.any():
                    edges += self._met(queries, asked, rows, places, k[other], i[other])
        return asked, edges

    def _met(self, queries: _Rows, asked: np.ndarray, rows: np.ndarray, places: np.ndarray, k: np.ndarray, i: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Counts the links of rows[k] with index rows places[i]; spanning edges."""
        asked += np.bincount(rows[k], self.index.copies[places[i]], len(asked)).astype(np.int64)
        for cell, links in _ranges(queries.own[rows[k]]):
            blind = ~(self.index.routes[places] == cell).any(1)
            links = links[blind[i[links]]]
            self.back += np.bincount(places[i[links]], queries.copies[rows[k[links]]], len(self.back)).astype(np.int64)
        label, least = np.arange(len(places)), np.full(len(rows), len(places))
        while True:  # least label over shared queries
            np.minimum.at(least, k, label[i])
            new = label.copy()
            np.minimum.at(new, i, least[k])
            if (new == label).all():
                break
            label = new
        keys, asks, mine = self.index.keys[places], np.flatnonzero(least < len(places)), np.flatnonzero(label != np.arange(len(places)))
        return [*zip(keys[mine].tolist(), keys[label[mine]].tolist()), *zip(queries.keys[rows[asks]].tolist(), keys[least[asks]].tolist())]


def links(rows: DataFrame, kind: np.dtype, number: np.dtype, threshold: float, tasks: int) -> DataFrame:
    """Rows (a, b, n) of packed vectors: with b a spanning edge, without it n members that a is linked with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, part, index, queries = None, None, [], []

        def told(keys, counts, edges):
            some = np.flatnonzero(counts)
            if len(some) or edges:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*keys[some].tolist(), *(e[0] for e in edges)], pa.binary()), pa.array([None] * len(some) + [e[1] for e in edges], pa.binary()),
                     pa.array([*counts[some].tolist(), *[0] * len(edges)], pa.int64())], ["a", "b", "n"])

        def answer(over: bool):
            nonlocal part, queries, index
            if part is None and index:
                whole, index = _Rows.of(index, kind, number), []
                part = _Part(whole, threshold)
                yield from told(whole.keys, *part.ask(whole))
            if part is not None and queries:
                asking = _Rows.of(queries, kind, number)
                yield from told(asking.keys, *part.ask(asking))
            if part is not None and over:
                yield from told(part.index.keys, part.back, [])
            queries = []

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != name:
                    yield from answer(True)
                    name, part, index = row["part"], None, []
                (queries if row["asks"] else index).append(row)
                if row["asks"] and sum(r["n"] for r in queries) >= min(_CHUNK, max(_STEP, _HELD // 8 // row["dim"])):
                    yield from answer(False)
        yield from answer(True)

    return rows.repartition(tasks, "part").sortWithinPartitions("part", "asks").mapInArrow(run, "a binary, b binary, n bigint")


def _kept(scratch: Scratch, df: DataFrame, table: str) -> DataFrame:
    """Write `df` once; what it has shuffled goes at once."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return scratch.write(df, table)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def rounds(load: dict[int, int], row_bytes: float, table_bytes: float) -> list[list[int]]:
    """Parts by rounds: each shuffles about as much, at most ROUND_TIMES the bytes of all vectors (or ROUND_BYTES), or one part."""
    count = min(max(1, len(load)), math.ceil(sum(load.values()) * row_bytes / max(ROUND_BYTES, ROUND_TIMES * table_bytes)) or 1)
    heap, out = [(0, k) for k in range(count)], [[] for _ in range(count)]
    for part in sorted(load, key=lambda p: (-load[p], p)):
        n, k = heapq.heappop(heap)
        out[k].append(part)
        heapq.heappush(heap, (n + load[part], k))
    return [sorted(x) for x in out]


def near_classes(vectors: DataFrame, threshold: float = 0.95, target: float = 0.999, per_cell: int = 64, fit_rows: int = 8_192, probe_rows: int = 256,
                 name: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(name, key, class_id, class_key, first_id, n_links) of each row; class_id is the smallest id that links reach."""
    kind, scratch = _element(vectors, vector), Scratch(vectors.sparkSession, "vectors")
    every = scratch.write(directions(vectors, name, vector), "every")
    each = scratch.write(every.select(name, "key"), "each")
    alike = every.where(F.col("key").isNotNull()).groupBy("key", "dim").agg(F.min(name).alias("first_id"), F.count("*").alias("copies"), F.first("body").alias("body"))
    distinct = _kept(scratch, alike, "distinct")
    scratch.drop("every")
    index = fit(distinct, kind, threshold, target, per_cell, fit_rows, probe_rows)
    nodes = scratch.write(routed(distinct, kind, index), "nodes")
    scratch.drop("distinct")
    sizes = [tuple(r) for r in nodes.groupBy("dim", "own").agg(F.count("*").alias("n")).collect()]
    most = max(BLOCK, sum(n for _, _, n in sizes) // (PARTS_PER_CORE * scratch.spark.sparkContext.defaultParallelism))
    parts = Parts.of(sizes, {d: len(a) * len(b) for d, (a, b) in index.books.items()}, {d: len(b) for d, (_, b) in index.books.items()}, most)
    load = {r["part"]: r["n"] for r in loads(nodes, index.number, parts).collect()}
    wide, total = (nodes.agg(F.avg(F.octet_length("body") + 48), F.sum(F.octet_length("body") + F.octet_length("route") + 48)).first())
    done = []
    for k, wanted in enumerate(rounds(load, wide or 0, total or 0)):
        take = np.zeros(max(1, parts.count), bool)
        take[wanted] = True
        done.append(_kept(scratch, links(packed(nodes, index.number, parts, take), kind, index.number, threshold, max(1, 3 * len(wanted))), f"links-{k}"))  # parts seldom meet in one task
    found = scratch.spark.read.schema(done[0].schema).parquet(*[f"{scratch.path}/links-{k}" for k in range(len(done))])
    linked = classes(nodes.select("key", "first_id", "copies"), found.where(F.col("b").isNull()).select(F.col("a").alias("key"), "n"),
                     found.where(F.col("b").isNotNull()).select("a", "b"))
    return members(each, nodes.select("key", "first_id", "copies"), linked, name)


by_value(__name__)
