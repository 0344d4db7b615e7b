"""Packing of documents into sequences of bounded length by bound-certified best-fit decreasing.

A document is its token ids and one closing id. Longer ones than a sequence are cut into whole sequences, and only their first piece may be
shorter. Pieces are dealt out over parts of bounded size; each part is packed by best fit decreasing, and dual feasible functions give a lower
bound of its sequences: where both meet, no packing of the part needs fewer. Then parts exchange documents: all of a part with a gap, and
those in unfilled sequences of the other parts (what rounding up costs each part). What was exchanged is dealt out anew over as few parts as
hold it and packed again. This goes on until the sequences of all parts meet the bound of the whole table, or `PATIENCE` exchanges in a row save
nothing.

Null texts are empty: the closing id alone. Null or repeated ids are documents of their own. An empty table gives no rows. Results have the
key column and columns of their own, so other columns of the input clash with nothing.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entiform.functions.storage import Scratch
from entiform.llm.common import by_value, share

#: Pieces that one part holds.
PART_ROWS = 50_000
PATIENCE = 2
#: Bytes from which a word goes to the tokenizers library: the faster one needs time by their square.
LONG_RUN = 2_000
#: Bytes of text whose words are looked up together; memory of a task is some 20 times this.
TOGETHER = 4_000_000
#: Largest k of the rounding functions.
ROUNDINGS = 12


#: Kinds of characters, and the one set between texts, which no plain text holds.
_BLANK, _WHITE, _LETTER, _NUMBER, _OTHER, _EDGE = range(6)
_BETWEEN = "\u2028"
_CUT = re.compile("(?<=[A-Za-z]) ")


# ---- token ids -------------------------------------------------------------------------------------------------------------------------

def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary of a byte-level tokenizer."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


def _kinds() -> np.ndarray:
    """The kind of each character that both libraries surely sort alike (they know different Unicode versions), and of the separator."""
    kinds = np.full(0x20AD, _OTHER, np.uint8)
    for c in range(len(kinds)):
        kinds[c] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)
    kinds[[*range(9, 14), 0x85, 0xA0]], kinds[ord(" ")], kinds[ord(_BETWEEN)] = _WHITE, _BLANK, _EDGE
    return kinds


class ByteEncoder:
    """Ids of a byte-level BPE file as the tokenizers library gives them.

    Plain texts are split into words by the tokenizer's rule, all of them together; each distinct word is spelled once, by a faster library with
    the same vocabulary. Other texts, and all where the file has other rules, go to the tokenizers library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.source = f.read()
        self.libraries = None

    def _open(self):
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_str(self.source)
        slow.no_truncation()
        slow.no_padding()
        given = json.loads(self.source)
        model, split = given["model"], given["pre_tokenizer"]
        self.added = {a["content"]: a["id"] for a in given["added_tokens"]}
        byte, vocab = _byte_of_char(), model["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        alike = (given["normalizer"] is None and split["type"] == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
                 and model["type"] == "BPE" and merged == sorted(merged))
        fast = None
        if alike:
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in self.added}
            fast = tiktoken.Encoding("from-file", pat_str=f"[^{_BETWEEN}]+", mergeable_ranks=ranks, special_tokens={})
            self.kinds, self.width = _kinds(), np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                self.width[i] = len(token)
        self.libraries = slow, fast, re.compile(r"[^\x00-\u024f\u2010-\u2027\u20ac]")

    def __getstate__(self):
        return {"source": self.source, "libraries": None}

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if self.libraries is None:
            self._open()
        slow, fast, far = self.libraries
        out, plain = [None] * len(texts), []
        for k, text in enumerate(texts):
            if fast is None or not text.isascii() and far.search(text) or any(map(text.__contains__, self.added)):
                out[k] = np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
            elif len(text) > TOGETHER:
                out[k] = np.concatenate([self._plain([part])[0] for part in _parts(text)])
            else:
                plain.append(k)
        for k, ids in zip(plain, self._plain([texts[k] for k in plain])):
            out[k] = ids
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = _BETWEEN + _BETWEEN.join(texts) + _BETWEEN * 2
        units = np.frombuffer(joined.encode("utf-16-le"), "<u2")
        kind = self.kinds[units]
        at = np.flatnonzero(self._starts(units, kind))
        place = np.append(at, len(units))
        if not joined.isascii():
            place[1:] = np.cumsum(np.uint8(1) + (units > 0x7F) + (units > 0x7FF), dtype=np.int32)[place[1:] - 1]
        words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(place), pa.py_buffer(joined.encode())]).dictionary_encode()
        held = self._spelled(words.dictionary).take(words.indices)
        ids, edges = held.flatten().to_numpy(), held.offsets.to_numpy()[:-1][kind[at] == _EDGE]
        return [ids[edges[k]:edges[k + 1]] for k in range(len(texts))]

    @staticmethod
    def _starts(units: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Whether a word begins at each character, as `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` splits
        each text: the last of some white space stands apart from the rest, and a blank goes with the word behind it."""
        before, here, after = kind[:-2], kind[1:-1], kind[2:]
        starts = np.ones(len(kind), bool)
        starts[1:-1] = np.where(here <= _WHITE, (before > _WHITE) | (after > _WHITE) & (after < _EDGE), (here != before) & (before != _BLANK) | (here == _EDGE))
        quote = np.flatnonzero(starts & (units == ord("'")))
        then, next_ = units[quote + 1], units[quote + 2]
        for ending in ("s", "t", "m", "d", "re", "ve", "ll"):
            ends = quote[(then == ord(ending[0])) & (next_ == ord(ending[1]) if len(ending) > 1 else True)]
            starts[ends + 1] = False
            starts[ends + 1 + len(ending)] = True
        return starts

    def _spelled(self, words: pa.Array) -> pa.Array:
        """Ids of each word; the separator has none."""
        slow, fast, _ = self.libraries
        size = pc.binary_length(words).to_numpy()
        if size.max() >= LONG_RUN:
            ids = [slow.encode(w, add_special_tokens=False).ids if len(w) >= LONG_RUN else fast.encode_ordinary(w) for w in words.to_pylist()]
            return pa.array(ids, pa.list_(pa.uint32()))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), pa.scalar(_BETWEEN, words.type))[0].as_py()
        ids = fast.encode_to_numpy(joined)
        ends = np.cumsum(np.where(pc.equal(words, _BETWEEN).to_numpy(zero_copy_only=False), 0, size))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.searchsorted(np.cumsum(self.width[ids]), ends, "right")), pa.int32()), pa.array(ids))


def _parts(text: str):
    """A long text in parts that begin with a blank behind a letter: a word surely begins there."""
    begin = 0
    while len(text) - begin > TOGETHER and (cut := _CUT.search(text, begin + TOGETHER)):
        yield text[begin:cut.start()]
        begin = cut.start()
    yield text[begin:]


def _together(batches):
    """Slices of about `TOGETHER` bytes of text, one text at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // TOGETHER)) + 1
        for begin, end in pairwise([0, *cuts.tolist(), batch.num_rows]):
            yield batch.slice(begin, end - begin)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, closing: int = 2, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32, token_ids) of each piece of each document; without `with_ids` no ids are kept."""
    given = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
    encode = share(docs.sparkSession, ByteEncoder(tokenizer))

    def cut(batches):
        encoder = encode()
        for some in _together(batches):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, body in enumerate(encoder.many([t or "" for t in some.column(1).to_pylist()])):
                tokens = np.append(body, np.uint32(closing)).astype("<u4", copy=False)
                begin, end, k = 0, (len(tokens) - 1) % capacity + 1, 0
                while begin < len(tokens):
                    part = tokens[begin:end]
                    rows.append(row)
                    piece.append(k)
                    start.append(begin)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part.astype(np.int32))
                    begin, end, k = end, end + capacity, k + 1
            out = [some.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = given.schema[key].dataType.simpleString()
    return given.mapInArrow(cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (", token_ids array<int>" if with_ids else ""))


# ---- one part ----------------------------------------------------------------------------------------------------------------------

def bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Sequences that these pieces need at least: the largest bound of a family of dual feasible functions.

    Each function keeps the pieces of any one sequence within its capacity: small pieces count nothing while their opposites count whole,
    and sizes are rounded to multiples of 1/k. Sums are whole numbers.
    """
    if not len(sizes):
        return 0
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    least = np.arange(0, capacity // 2 + 1)[:, None]
    lifted = np.where(sizes > capacity - least, capacity, np.where(sizes >= least, sizes, 0))
    best = -(-int((lifted * counts).sum(1).max()) // capacity)
    for k in range(1, ROUNDINGS + 1):
        up = (k + 1) * lifted
        rounded = np.where(up % capacity == 0, k * lifted, up // capacity * capacity)
        best = max(best, -(-int((rounded * counts).sum(1).max()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, room of each sequence) of best fit decreasing: the longest first, each where it leaves the least room.

    Pieces of one length go together. `open_` has a bit for each room that some sequence has left, so the tightest one is its lowest bit.
    """
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, rooms = 0, []
    ends = np.flatnonzero(np.append(np.diff(lengths[order]), 1)) + 1
    begin = 0
    for end in ends.tolist():
        size, at = int(lengths[order[begin]]), begin
        while at < end:
            fits = open_ >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                bin_ = held[room].pop()
                if not held[room]:
                    open_ &= ~(1 << room)
            else:
                room, bin_ = capacity, len(rooms)
                rooms.append(capacity)
            take = min(room // size, end - at)
            put = order[at:at + take]
            sequence[put] = bin_
            offset[put] = capacity - room + size * np.arange(take)
            at, room = at + take, room - take * size
            rooms[bin_] = room
            held[room].append(bin_)
            open_ |= 1 << room
        begin = end
    return sequence, offset, np.array(rooms, np.int64)


def _pack_part(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        pid, lengths = table.column("pid").to_numpy(), table.column("length").to_numpy()
        order = np.argsort(pid)
        pid, lengths = pid[order], lengths[order]
        sequence, offset, rooms = best_fit(lengths, capacity)
        need = bound(*np.unique(lengths, return_counts=True), capacity)
        first = np.full(len(rooms), np.iinfo(np.int64).max)
        np.minimum.at(first, sequence, pid)
        moves = (len(rooms) > need) | (rooms[sequence] > 0)
        return pa.table({"pid": pid, "length": lengths, "sequence_id": first[sequence], "offset": offset, "moves": moves})

    return pack


# ---- all parts ---------------------------------------------------------------------------------------------------------------------

def _bound_of(rows: DataFrame, capacity: int) -> tuple[int, int]:
    """(rows, lower bound) of a whole table; the driver sees one count for each length."""
    got = rows.groupBy("length").agg(F.count("*").alias("n")).collect()
    sizes, counts = np.array([r["length"] for r in got], np.int64), np.array([r["n"] for r in got], np.int64)
    return int(counts.sum()), bound(sizes, counts, capacity)


def assign(sizes: DataFrame, capacity: int, scratch: Scratch, part_rows: int = PART_ROWS) -> tuple[DataFrame, list[dict]]:
    """((pid, sequence_id, offset), rounds) of stored `sizes` (pid, length); pid is unique. A sequence takes the smallest pid it holds.

    `rounds` says for each round: pieces packed, parts, sequences after it, and the lower bound of the whole table.
    """
    whole = sizes.where(F.col("length") == capacity).select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    now = sizes.where(F.col("length") < capacity).select("pid", "length")
    rows, need = _bound_of(now, capacity)
    done, rounds, kept, before, idle = [whole], [], 0, None, 0
    schema = "pid long, length long, sequence_id long, offset long, moves boolean"
    while rows:
        k, parts = len(rounds), -(-rows // part_rows)
        part = F.pmod(F.xxhash64("pid", F.lit(k)), F.lit(parts)).alias("part")
        packed = scratch.write(now.withColumn("part", part).groupBy("part").applyInArrow(_pack_part(capacity), schema), f"round-{k}")
        heads = packed.where("offset = 0").agg(F.count("*").alias("all"), F.count_if("moves").alias("moving")).first()
        better = before is None or heads["all"] < before["moving"]
        total = kept + (heads["all"] if better else before["moving"])
        rounds.append({"pieces": rows, "parts": parts, "sequences": total, "bound": need})
        if not better:
            idle += 1
            if idle < PATIENCE and parts > 1:
                continue
            done.append(before["packed"].where("moves").select("pid", "sequence_id", "offset"))
            break
        idle = 0
        if total <= need or heads["moving"] < 2:
            done.append(packed.select("pid", "sequence_id", "offset"))
            break
        done.append(packed.where("NOT moves").select("pid", "sequence_id", "offset"))
        kept += heads["all"] - heads["moving"]
        before = {"moving": heads["moving"], "packed": packed}
        now = packed.where("moves").select("pid", "length")
        rows = now.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, rounds


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, closing: int = 2, key: str = "doc_id", text: str = "text", with_ids: bool = True,
         part_rows: int = PART_ROWS) -> tuple[DataFrame, list[dict]]:
    """(the pieces with `sequence_id` and `offset`, rounds) of all documents.

    Pieces are stored once with a number of their own; only numbers and lengths are dealt out, so neither a document nor its ids move before
    the last join.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.write(pieces(docs, tokenizer, capacity, closing, key, text, with_ids).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    placed, rounds = assign(cut.select("pid", "length"), capacity, scratch, part_rows)
    return cut.join(placed, "pid").drop("pid"), rounds


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, token_ids) of packed pieces with ids; a sequence holds no more pieces than tokens."""
    held = F.array_sort(F.collect_list(F.struct("offset", "token_ids")))
    return packed.groupBy("sequence_id").agg(held.alias("held")).select(
        "sequence_id", F.size("held").cast("long").alias("n_pieces"), F.flatten(F.transform("held", lambda p: p["token_ids"])).alias("token_ids"))


by_value(__name__)
