"""All links between texts whose sets of word shingles have a Jaccard similarity from a threshold on, by chosen paths.

Equal sets are one node with a count. Each set is embedded by MinHash into coordinates. A run sends it down a tree: at a node of the tree the
same few coordinates are chosen for all sets there, and a set goes on to the child that its values name. So sets that share most tokens are
likely to share a path, others part soon. Nodes with few sets are compared by brute force, others are split again; what is still large after
`depth` levels (one group of near copies does not part) is compared in blocks, none left out. Runs are repeated until a pair at the
threshold is found with the target recall.

Comparison first filters by the sketches that travel with the paths, then by the exact sets, which are fetched only for texts with a likely
partner. A pair is counted in the smallest of the paths that both have, so each link counts once though no pair is ever a row;
classes come from spanning edges of each bucket, fewer than its sets.

Texts are lower-case words; five words make a shingle and a shorter text is one shingle of all its words. Null texts and texts without words are
linked with nothing. Rows with the same id are judged by their own text; a null id never names a class that has another id. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entiform.llm.common import NEAR, SHINGLE_WORDS, by_value, settle, shingle_hashes, word_hashes, words
from entiform.llm.graph import classes, members

#: Coordinates of the embedding; each travels as one byte.
COORDINATES = 64
#: Sets of a bucket that are compared at once.
BUCKET = 2_000
_SEEDS = np.random.default_rng(20240607).integers(1, 2 ** 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = np.atleast_1d(x)
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """32-bit coordinates of a set."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 8192):
        part = shingles[at:at + 8192, None]
        out = np.minimum(out, (((part ^ (part >> np.uint64(31))) * _SEEDS[None, :]) >> np.uint64(32)).min(0))
    return out


def chosen(path: int, threshold: float) -> list[int]:
    """Coordinates that are chosen at a node of the tree: one, and a second as often as to make 1/threshold on average."""
    ranks = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(path))
    order = np.argsort(ranks)
    more = int(_mix(np.array([path], np.uint64) + np.uint64(17))[0] >> np.uint64(11)) / 2 ** 53 < 1 / threshold - 1
    return order[:1 + more].tolist()


def child(path: np.ndarray, coordinate: int, value: np.ndarray) -> np.ndarray:
    return _mix(_mix(np.asarray(path, np.uint64) + np.uint64(coordinate * 2 + 1)) ^ (value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _roots(threshold: float, runs: int) -> list[tuple[int, int]]:
    """(path, coordinate) of the first level of each run."""
    starts = [int(x) for x in _mix(np.arange(1, runs + 1, dtype=np.uint64))]
    return [(p, c) for p in starts for c in chosen(p, threshold)]


def sets(df: DataFrame, name: str, text: str, threshold: float, runs: int) -> DataFrame:
    """(name, key, paths, sketch): a key of the whole set, its first paths, and its coordinates in one byte each."""
    roots = _roots(threshold, runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, paths, sketches = [], [], []
            for t in batch.column(1).to_pylist():
                shingles = shingle_hashes(word_hashes(words(t)), SHINGLE_WORDS)
                if not len(shingles):
                    keys.append(None), paths.append(None), sketches.append(None)
                    continue
                signature = minhash(shingles)
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                paths.append([int(child(np.uint64(p), c, signature[c:c + 1])[0].astype(np.int64)) for p, c in roots])
                sketches.append(signature.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(paths, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], [batch.schema.names[0], "key", "paths", "sketch"])

    kind = df.schema[name].dataType.simpleString()
    return df.select(name, text).mapInArrow(run, f"`{name}` {kind}, key binary, paths array<bigint>, sketch binary")


def _split(rows: DataFrame, threshold: float) -> DataFrame:
    """The next level of the tree for (path, key, copies, sketch)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column("path").to_numpy().astype(np.uint64)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            take, to = [], []
            for p in np.unique(path):
                here = np.flatnonzero(path == p)
                for c in chosen(int(p), threshold):
                    take.append(here)
                    to.append(child(p, c, sketch[here, c]))
            at = pa.array(np.concatenate(take) if take else np.zeros(0, np.int64))
            part = batch.take(at)
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(to) if to else np.zeros(0, np.uint64)).astype(np.int64)), *part.columns[1:]], part.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _blocks(rows: DataFrame) -> DataFrame:
    """Large buckets (with their `size`) as one bucket for each two blocks of theirs."""
    n = F.ceil(F.col("size") / (BUCKET // 2)).cast("int")
    own = F.pmod(F.xxhash64("key", "path"), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    return (rows.withColumn("own", own).withColumn("other", other)
            .withColumn("path", F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))).drop("own", "other", "size"))


def buckets(nodes: DataFrame, threshold: float, depth: int) -> DataFrame:
    """(path, key, copies, sketch) of all buckets with two sets or more, none of them large.

    Only paths and keys are counted and split; sketches join those that are left.
    """
    body = nodes.select("key", "copies", "sketch")
    now, ready = nodes.select(F.explode("paths").alias("path"), "key"), []
    for level in range(depth + 1):
        sizes = settle(now.groupBy("path").agg(F.count("*").alias("size")).where(F.col("size") > 1), "bucket-sizes")
        ready.append(now.join(sizes.where(F.col("size") <= BUCKET), "path", "left_semi"))
        large = sizes.where(F.col("size") > BUCKET)
        if large.isEmpty():
            break
        rest = now.join(large, "path")
        if level == depth:
            ready.append(_blocks(rest))
        else:
            whole = rest.join(body, "key").select("path", "key", "copies", "sketch")
            now = settle(_split(whole, threshold).select("path", "key"), "paths")
    return reduce(DataFrame.unionByName, ready).join(body, "key").select("path", "key", "copies", "sketch")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by it; keys with little to do come many at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if not len(keys):
            continue
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            held.append(batch.slice(0, int(cuts[-1])))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(int(cuts[-1]) if len(cuts) else 0))
    if held:
        yield pa.Table.from_batches(held)


def _bounds(keys: np.ndarray) -> list[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b - a > 1]


def likely(sketches: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a bucket whose sketches agree often enough; four standard deviations below the threshold still count."""
    least = COORDINATES * (threshold - 4 * math.sqrt(threshold * (1 - threshold) / COORDINATES))
    n = len(sketches)
    step = max(1, 4_000_000 // (n * COORDINATES))
    for at in range(0, n - 1, step):
        block = sketches[at:at + step]
        same = (block[:, None, :] == sketches[None, at:, :]).sum(2)
        a, b = np.nonzero(same >= least)
        kept = b > a
        if kept.any():
            yield a[kept] + at, b[kept] + at


def _by_path(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("path")).sortWithinPartitions("path", "key")


def hopeful(rows: DataFrame, threshold: float) -> DataFrame:
    """(path, key, copies, sketch, likeness) of the sets with a likely partner in the bucket; likeness names these sets as a whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "path"):
            path = group.column("path").to_numpy()
            keys = group.column("key").to_pylist()
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            take, likeness = [], []
            for a, b in _bounds(path):
                hit = np.zeros(b - a, bool)
                for i, j in likely(sketch[a:b], threshold):
                    hit[i] = hit[j] = True
                if hit.any():
                    found = np.flatnonzero(hit) + a
                    name = hashlib.blake2b(b"".join(keys[k] for k in found), digest_size=8).digest()
                    take.append(found)
                    likeness.extend([int.from_bytes(name, "big", signed=True)] * len(found))
            if take:
                part = group.take(pa.array(np.concatenate(take)))
                yield from part.append_column("likeness", pa.array(likeness, pa.int64())).to_batches()

    return _by_path(rows).mapInArrow(run, "path bigint, key binary, copies bigint, sketch binary, likeness bigint")


def _exact(rows: DataFrame, threshold: float) -> DataFrame:
    """Links of each bucket: rows (a, b, n); with b a spanning edge, without it n members that a is linked with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "path"):
            out = _verify(group, threshold)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.int64())], ["a", "b", "n"])

    return _by_path(rows).mapInArrow(run, "a binary, b binary, n bigint")


def _verify(group: pa.Table, threshold: float) -> list[tuple[bytes, bytes | None, int]]:
    path, keys, copies = group.column("path").to_numpy(), group.column("key").to_pylist(), group.column("copies").to_numpy()
    blobs, ways = group.column("shingles").to_pylist(), group.column("ways").to_pylist()
    sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
    out = []
    for a, b in _bounds(path):
        held: dict[int, set] = {}
        way = [frozenset(w) for w in ways[a:b]]
        sizes = [len(x) // 8 for x in blobs[a:b]]
        n_links, up = np.zeros(b - a, np.int64), list(range(b - a))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        def tokens(k: int) -> set:
            if k not in held:
                held[k] = set(np.frombuffer(blobs[a + k], np.uint64).tolist())
            return held[k]

        for i, j in likely(sketch[a:b], threshold):
            for x, y in zip(i.tolist(), j.tolist()):
                n, m = sizes[x], sizes[y]
                if min(n, m) < threshold * max(n, m):
                    continue
                both = len(tokens(x) & tokens(y))
                if both < threshold * (n + m - both):
                    continue
                if min(way[x] & way[y]) == path[a]:
                    n_links[x] += copies[a + y]
                    n_links[y] += copies[a + x]
                p, q = root(x), root(y)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    out.append((keys[a + x], keys[a + y], 0))
        out.extend((keys[a + k], None, int(n_links[k])) for k in np.flatnonzero(n_links))
    return out


def _whole_sets(docs: DataFrame, nodes: DataFrame, name: str, text: str) -> DataFrame:
    """(key, shingles) of the wanted nodes (key, first_id), read again from their texts."""
    wanted = nodes.select(F.col("first_id").alias("wanted")).distinct()
    # As many ids as documents have partners: never a broadcast, so that each size runs the same plan.
    again = docs.select(name, text).join(wanted.hint("merge"), F.col(name).eqNullSafe(F.col("wanted")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(word_hashes(words(t)), SHINGLE_WORDS).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in found], pa.binary()), pa.array(found, pa.binary())], ["key", "shingles"])

    return again.mapInArrow(run, "key binary, shingles binary").join(nodes.select("key"), "key", "left_semi").dropDuplicates(["key"])


def lost(threshold: float, runs: int, levels: int) -> float:
    """Share of pairs at the threshold that no run brings to a common node below `levels` levels.

    All runs choose from the same coordinates, so the number of these in which a pair agrees comes first.
    """
    more, total = 1 / threshold - 1, 0.0
    for k in range(COORDINATES + 1):
        same, parted = k / COORDINATES, 0.0
        for _ in range(levels):
            each = 1 - same * (1 - parted)
            parted = (1 - more) * each + more * each ** 2
        total += math.comb(COORDINATES, k) * threshold ** k * (1 - threshold) ** (COORDINATES - k) * parted ** runs
    return total


def runs_needed(threshold: float, recall: float, levels: int) -> int:
    """The fewest runs that lose at most 1 - `recall` of the pairs at the threshold."""
    runs = 1
    while lost(threshold, runs, levels) > 1 - recall and runs < 1_000:
        runs += 1
    return runs


def near_classes(docs: DataFrame, threshold: float = NEAR, recall: float = 0.999, depth: int = 4, name: str = "doc_id", text: str = "text") -> DataFrame:
    """(name, key, class_id, class_key, first_id, n_links) of each row.

    class_id is the smallest id that links reach, n_links the number of other rows linked directly. `key` names the row's set, class_key the
    set that stands for the class, first_id the smallest id with the row's set. The number of runs follows from `recall`
    for a pair at the threshold in the deepest bucket, `depth` splits below the first paths.
    """
    runs = runs_needed(threshold, recall, depth + 1)
    each = settle(sets(docs, name, text, threshold, runs), "sets")
    nodes = settle(each.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min(name).alias("first_id"), F.count("*").alias("copies"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch")), "nodes")
    hope = settle(hopeful(buckets(nodes, threshold, depth), threshold), "hopeful")
    # Buckets with the same sets say the same: one of them is enough.
    first = hope.groupBy("likeness").agg(F.min("path").alias("path"))
    hope = settle(hope.join(first, ["likeness", "path"], "left_semi").drop("likeness"), "hopeful-once")
    ways = hope.groupBy("key").agg(F.collect_set("path").alias("ways"))
    whole = _whole_sets(docs, nodes.select("key", "first_id").join(ways.select("key"), "key", "left_semi"), name, text)
    known = ways.join(whole, "key")
    found = settle(_exact(hope.join(known, "key").select("path", "key", "copies", "sketch", "ways", "shingles"), threshold), "links")
    linked = classes(nodes.select("key", "first_id", "copies"), found.where(F.col("b").isNull()).select(F.col("a").alias("key"), "n"),
                     found.where(F.col("b").isNotNull()).select("a", "b"))
    return members(each.select(name, "key"), nodes.select("key", "first_id", "copies"), linked, name)


def keep_one(docs: DataFrame, threshold: float = NEAR, name: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, one of each class; texts without words stay. Columns are those of the input."""
    judged = settle(near_classes(docs, threshold, name=name, text=text), "classes")
    stays = F.col("key").isNull() | ((F.col("key") == F.col("class_key")) & F.col(name).eqNullSafe(F.col("first_id")))
    gone = judged.where(~stays)
    kept = judged.where(stays & F.col("key").isNotNull())
    # Ids that stand for several rows are rare; only their rows are looked at again, text by text.
    shared = settle(gone.select(name).intersect(judged.where(stays).select(name)).union(kept.groupBy(name).count().where("count > 1").select(name)).distinct().withColumnRenamed(name, "__id"), "shared-ids")
    drop = settle(gone.select(F.col(name).alias("__id")).distinct().unionByName(shared).distinct(), "dropped-ids")
    plain = docs.join(drop, docs[name].eqNullSafe(F.col("__id")), "left_anti")
    if shared.isEmpty():
        return plain
    doubtful = docs.join(shared, docs[name].eqNullSafe(F.col("__id")), "left_semi").withColumn("__key", set_key(F.col(text)))
    silent = doubtful.where(F.col("__key").isNull())
    spoken = doubtful.where(F.col("__key").isNotNull()).dropDuplicates([name, "__key"]).join(
        kept.select(F.col(name).alias("__kept"), F.col("key").alias("__kept_key")).distinct(), F.col(name).eqNullSafe(F.col("__kept")) & (F.col("__key") == F.col("__kept_key")), "left_semi")
    return plain.unionByName(silent.unionByName(spoken).drop("__key"))


def set_key(column):
    """The key of a text's set, as `sets` gives it."""
    @F.pandas_udf("binary")
    def key(texts: pd.Series) -> pd.Series:
        found = [shingle_hashes(word_hashes(words(t)), SHINGLE_WORDS) for t in texts]
        return pd.Series([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in found])

    return key(column)


by_value(__name__)
