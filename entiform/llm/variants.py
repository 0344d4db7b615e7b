"""Spelling variants: words that lie one insertion, deletion or replacement apart, found in bidirectional FM-indexes.

A word with one error has its left or its right half whole. So each word is searched twice: its left half is matched exactly and extended to
the right with one error allowed, and its right half is matched exactly and extended to the left. The index is over the words of a block, each
behind a delimiter, as one circular text; it holds the Burrows-Wheeler transforms of the text and of its reverse as wavelet matrices, and a
search state is an interval of suffix ranks in each, of one length. Extending on one side looks up ranks in one of them and moves the other by
the number of smaller letters, so the half is matched up to its delimiter first and extended on its other side then. All words of a block are
searched at once, as arrays.

Words that a first search can find begin with the same letters, and those of a second one end with the same: half the shortest word's length
of them. Words are therefore dealt out by these letters, once for each search, and no word meets words that it cannot match. Where more
words share these letters than a block holds, the block's index is split, and each of these words is searched in all parts. A pair that both
searches find counts in the first. Only counts and best partners leave a block, no pairs.

Null texts have no words, a null id counts as ''. Repeated rows count as often as they stand. Equal counts go by code points. Empty tables
give no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entiform.functions.storage import Scratch, settle
from entiform.llm.common import by_value

#: Words of one index, words that are searched at once, counts a task holds before it passes them on.
BLOCK_WORDS, AT_ONCE, HELD_WORDS = 20_000, 4_096, 300_000
#: Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, after A-Z became lower case.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: One in this many (document, run) is read with a letter missing.
SLIPS = 199


# ---- words -----------------------------------------------------------------------------------------------------------------------------

def _counts(batches):
    def passed(held):
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for key, text in zip(*(c.to_pylist() for c in batch.columns)):
            seen, start = Counter(RUN.findall(text.encode().lower())), zlib.crc32(f"{key}:".encode())
            slipped = [(run, h) for run in seen if not (h := zlib.crc32(run, start)) % SLIPS]
            for run, h in slipped:
                letters, n = run.decode(), seen.pop(run)
                at = h % len(letters)
                held[(letters[:at] + letters[at + 1:]).encode()] += n
            held.update(seen)
            if len(held) > HELD_WORDS:
                yield passed(held)
                held.clear()
    yield passed(held)


def vocabulary(docs: DataFrame, min_length: int = 6, min_count: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of Latin letters of all texts, in lower case of A-Z, with their number.

    Where SLIPS divides the crc32 of `<id>:<run>`, the run loses the letter at that number modulo its length.
    """
    given = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counted = given.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= min_count) & (F.length("word") >= min_length))


# ---- index -----------------------------------------------------------------------------------------------------------------------------

def _rotations(text: np.ndarray, bits: int) -> np.ndarray:
    """Start of each rotation of a circular text, in order; letters first by as many as fit in one number, then by doubling."""
    n, width = len(text), 63 // bits
    rank = np.zeros(n, np.int64)
    for k in range(width):
        rank = (rank << bits) | np.roll(text, -k)
    while True:
        order = np.argsort(rank, kind="stable")
        step = np.append(0, np.cumsum(np.diff(rank[order]) != 0))
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1 or width >= n:
            return order
        rank, width = rank * n + np.roll(rank, -width), width * 2


class Ranks:
    """Wavelet matrix: how often a letter stands in a range, and how many smaller ones do."""

    def __init__(self, letters: np.ndarray, bits: int):
        self.levels, now = [], letters
        for b in range(bits - 1, -1, -1):
            bit = (now >> b) & 1
            self.levels.append((b, np.append(0, np.cumsum(bit)).astype(np.int32), int(len(bit) - bit.sum())))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.start = np.zeros(1 << bits, np.int64)
        self.start = self._down(np.zeros(1 << bits, np.int64), np.arange(1 << bits))

    def _down(self, at, letter):
        for b, ones, zeros in self.levels:
            up = ones[at]
            at = np.where((letter >> b) & 1, zeros + up, at - up)
        return at

    def of(self, low, high, letter):
        """(rank of `letter` before `low`, number in the range, smaller letters in the range)."""
        smaller = np.zeros(len(low), np.int64)
        for b, ones, zeros in self.levels:
            low1, high1 = ones[low].astype(np.int64), ones[high].astype(np.int64)
            bit = ((letter >> b) & 1).astype(bool)
            smaller += np.where(bit, (high - low) - (high1 - low1), 0)
            low, high = np.where(bit, zeros + low1, low - low1), np.where(bit, zeros + high1, high - high1)
        return low - self.start[letter], high - low, smaller

    def each(self, low, high):
        """(range, letter, rank before `low`, number, smaller letters) of all letters in all ranges."""
        owner, letter, smaller = np.arange(len(low)), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for b, ones, zeros in self.levels:
            low1, high1 = ones[low].astype(np.int64), ones[high].astype(np.int64)
            low0, high0 = low - low1, high - high1
            is0, is1 = high0 > low0, high1 > low1
            owner, letter = np.concatenate([owner[is0], owner[is1]]), np.concatenate([letter[is0], letter[is1] | (1 << b)])
            smaller = np.concatenate([smaller[is0], smaller[is1] + (high0 - low0)[is1]])
            low, high = np.concatenate([low0[is0], zeros + low1[is1]]), np.concatenate([high0[is0], zeros + high1[is1]])
        return owner, letter, low - self.start[letter], high - low, smaller


class Index:
    """Bidirectional FM-index over words (letter numbers from 1, one word after the other) as a circular text; 0 is the delimiter."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray, bits: int):
        starts = np.append(0, np.cumsum(lengths + 1)[:-1])
        text = np.zeros(len(letters) + len(lengths), np.int64)
        inside = np.ones(len(text), bool)
        inside[starts] = False
        text[inside] = letters
        order = _rotations(text, bits)
        back = text[::-1]
        self.size = len(text)
        self.before = np.append(0, np.cumsum(np.bincount(text, minlength=1 << bits)))
        self.left, self.right = Ranks(text[order - 1], bits), Ranks(back[_rotations(back, bits) - 1], bits)
        word_at = np.zeros(self.size, np.int64)
        word_at[starts] = np.arange(len(lengths))
        self.word = word_at[order]  # of a rank whose suffix begins with a delimiter

    def extend(self, state, letter, side: int):
        """States after one more letter on the left (0) or on the right (1)."""
        own, other, size = state[side], state[1 - side], state[2]
        rank, number, smaller = (self.right if side else self.left).of(own, own + size, letter)
        moved = self.before[letter] + rank, other + smaller, number
        return (moved[1], moved[0], moved[2]) if side else moved

    def branches(self, state, side: int):
        """(state number, letter, state) for all letters that follow on one side."""
        own, other, size = state[side], state[1 - side], state[2]
        owner, letter, rank, number, smaller = (self.right if side else self.left).each(own, own + size)
        moved = self.before[letter] + rank, other[owner] + smaller, number
        return owner, letter, (moved[1], moved[0], moved[2]) if side else moved


def _take(state, which):
    return tuple(x[which] for x in state)


def search(index: Index, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of all pairs one error apart whose error lies right (side 1: left half whole) or left (side 0) of the split.

    Letters are read away from the delimiter at the whole half, so both sides run alike: `letter(q, 0)` stands next to that delimiter.
    """
    whole = lengths // 2 if side else lengths - lengths // 2

    def letter(q, k):
        return letters[starts[q] + (k if side else lengths[q] - 1 - k)]

    q = np.arange(len(lengths))
    state = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), index.size, np.int64)
    at = whole.copy()
    while len(q) and at.max() > -1:  # the half, from the split to the delimiter
        more = at > -1
        put = np.flatnonzero(more)
        step = at[put] - 1
        seen = np.where(step >= 0, letter(q[put], np.maximum(step, 0)), 0)
        moved = index.extend(_take(state, put), seen, 1 - side)
        for x, y in zip(state, moved):
            x[put] = y
        at[put] = np.where(step >= 0, step, -1)
        alive = state[2] > 0
        q, at, state = q[alive], at[alive], _take(state, alive)
    at = whole[q]
    ones: list[tuple] = []
    while len(q):  # without an error so far; `at` letters read
        owner, seen, moved = index.branches(state, side)
        oq, oat = q[owner], at[owner]
        ended = oat == lengths[oq]
        want = np.where(ended, -1, letter(oq, np.minimum(oat, lengths[oq] - 1)))
        other = (seen != want) & (seen != 0)
        ones.append((oq[other], oat[other], _take(moved, other)))  # one letter more
        other &= ~ended
        ones.append((oq[other], oat[other] + 1, _take(moved, other)))  # another letter
        left = at < lengths[q]
        nxt = np.minimum(at + 1, lengths[q] - 1)
        # Of a run of one letter only the last is left out, and a letter is put in behind its like, so nothing is found twice by these.
        left &= (at + 1 == lengths[q]) | (letter(q, np.minimum(at, lengths[q] - 1)) != letter(q, nxt))
        ones.append((q[left], at[left] + 1, _take(state, left)))  # one letter less
        on = (seen == want) & ~ended
        q, at, state = oq[on], oat[on] + 1, _take(moved, on)
    if not ones:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, at = np.concatenate([o[0] for o in ones]), np.concatenate([o[1] for o in ones])
    state = tuple(np.concatenate([o[2][k] for o in ones]) for k in range(3))
    found_q, found_w = [], []
    while len(q):  # after the error, to the other delimiter
        ended = at == lengths[q]
        seen = np.where(ended, 0, letter(q, np.minimum(at, lengths[q] - 1)))
        state = index.extend(state, seen, side)
        alive = state[2] > 0
        good = alive & ended
        found_q.append(q[good])
        found_w.append(index.word[state[0][good]])
        go = alive & ~ended
        q, at, state = q[go], at[go] + 1, _take(state, go)
    pairs = np.unique(np.stack([np.concatenate(found_q), np.concatenate(found_w)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def search_block(words: list[str], counts: np.ndarray, indexed: np.ndarray, side: int):
    """(near words, best partner or -1, its count) of each word of a block, as far as the words `indexed` hold them.

    `words` are sorted by code points; side 1 finds errors behind the left half, side 0 those before the right half that side 1 does not find.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.append(0, np.cumsum(lengths)[:-1])
    known, letters = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), return_inverse=True)
    letters = letters + 1
    bits = max(1, int(len(known)).bit_length())
    held = np.flatnonzero(indexed)
    near, best, best_n = np.zeros(len(words), np.int64), np.full(len(words), -1), np.zeros(len(words), np.int64)
    if not len(held):
        return near, best, best_n
    index = Index(letters[np.repeat(indexed, lengths)], lengths[held], bits)
    for low in range(0, len(words), AT_ONCE):
        some = slice(low, low + AT_ONCE)
        q, w = search(index, letters, starts[some], lengths[some], side)
        q, w = q + low, held[w]
        if not side:  # those that begin with the left half belong to the other search
            own = np.array([words[b][:len(words[a]) // 2] != words[a][:len(words[a]) // 2] for a, b in zip(q, w)], bool)
            q, w = q[own], w[own]
        near += np.bincount(q, minlength=len(words))
        order = np.lexsort((w, -counts[w], q))
        q, w = q[order], w[order]
        head = np.append(True, np.diff(q) > 0) if len(q) else np.zeros(0, bool)
        best[q[head]], best_n[q[head]] = w[head], counts[w[head]]
    return near, best, best_n


def _search(table: pa.Table) -> pa.Table:
    words = table.column("word").to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    words = [words[k] for k in order]
    counts, indexed = table.column("n").to_numpy()[order], table.column("indexed").to_numpy()[order]
    near, best, best_n = search_block(words, counts, indexed, table.column("side")[0].as_py())
    some = best >= 0
    return pa.table({
        "word": pa.array(words, pa.string()), "n": pa.array(counts, pa.int64()), "near": pa.array(near, pa.int64()),
        "best": pa.array([words[b] if b >= 0 else None for b in best], pa.string()), "best_n": pa.array(best_n, pa.int64(), mask=~some)})


# ---- groups ----------------------------------------------------------------------------------------------------------------------------

def near_words(words: DataFrame, min_length: int = 6, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, n_near, best, best_n) of stored distinct `words` (word, n): near words and the commonest of them."""
    ends = min_length // 2
    shards = -(-words.count() // block_words)
    sided = words.select("word", "n", F.explode(F.array(
        F.struct(F.lit(1).alias("side"), F.substring("word", 1, ends).alias("end")), F.struct(F.lit(0).alias("side"), F.substring("word", -ends, ends).alias("end")))).alias("at")).select("word", "n", "at.*")
    # At most one in `block_words` of the words is such an end.
    large = settle(sided.groupBy("side", "end").agg(F.count("*").alias("held")).where(F.col("held") > block_words).select(
        "side", "end", F.ceil(F.col("held") / block_words).cast("int").alias("parts")), "ends")
    dealt = sided.join(large, ["side", "end"], "left").select(
        "word", "n", "side", F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("end"), F.lit(max(shards, 1))).cast("string")).otherwise(F.concat(F.lit("="), "end")).alias("shard"),
        F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    found = dealt.select("word", "n", "side", "shard", "part", (F.col("own") == F.col("part")).alias("indexed")).groupBy("side", "shard", "part").applyInArrow(
        lambda t: _search(t), "word string, n long, near long, best string, best_n long")
    chosen = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))).alias("chosen")
    return found.groupBy("word").agg(F.first("n").alias("n"), F.sum("near").alias("n_near"), chosen).select(
        "word", "n", "n_near", F.col("chosen.word").alias("best"), (-F.col("chosen.n")).alias("best_n"))


def group(words: DataFrame, min_length: int = 6, times: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct `words` (word, n) of at least `min_length` letters.

    The form is the commonest near word, if it occurs `times` as often; the root is the form that has none itself. Counts grow along forms,
    so they end; each round doubles the way that is known.
    """
    scratch = Scratch(words.sparkSession, "variants")
    near = near_words(scratch.write(words.select("word", "n"), "words"), min_length, block_words)
    formed = F.col("best_n") >= F.lit(times) * F.col("n")
    rows = scratch.write(near.select(
        "word", F.when(formed, F.col("best")).alias("form"), "n", "n_near", F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    ways, k = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 0
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = scratch.write(ways.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"ways-{k}")
        k += 1
        if ways.where("moved").isEmpty():
            break
    return rows.join(ways.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


by_value(__name__)
