"""BPE encoding and decoding with an automaton compiled from the merges.

States of the automaton are tokens (the last token read), arcs are labelled with tokens. It starts with one arc for each
base symbol from every state. Each merge (u, v) -> w then adds a gadget, in order of rank: an arc w is laid wherever u
was followed by v, and v may no longer follow u. What a gadget did to older states carries over to states and arcs made
later, because a new arc w enters where u entered and leaves where v left. So exactly one path spells each word, and it is
its BPE encoding. The arcs' gadgets are compiled into tables; the entry (state, arc) is worked out from the gadgets when
it is first used and then kept. The same holds for each beginning of a word: one path spells it, so one state is reached there.
Encoding therefore reads a word once from left to right and never goes back: the labels that end at a place come from a trie with suffix
links over all labels, and the one whose arc leaves the state at its beginning gives the state of the place. Decoding emits
the labels of the arcs.

White space, letters, digits and lower case are the tokenizer's own: where its library sorts a character otherwise than Python and the
`regex` module do (found by asking it for all characters when the file is compiled), texts with that character are
normalised and split by the library's rules. Only the planes in use are asked for (0 to 3 and 14; the others are unassigned or private).

Input rows are kept one to one: a null or empty text gives no tokens, other columns pass through (one with the name of a
result is replaced), the order of rows does not matter. Texts of any length take time in proportion to their length.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, pre_tokenizers

from entiform.llm.common import by_value, share, without

#: Distinct words that a worker remembers; the memory is emptied when it is full.
MEMO_WORDS = 160_000
#: White space as the tokenizer's normaliser sees it.
_SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Same alternatives, the commonest first; none of them can begin where another does.
_REORDERED = {
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+": r"\p{L}+|'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\s\p{L}\p{N}]+"}
_NEVER = 1 << 60
_ROWS = 512


def byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in seen}
    hidden = [b for b in range(256) if b not in out]
    return out | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Memo(dict):
    """Ids of the words met lately."""

    def __init__(self, spelled):
        super().__init__()
        self.spelled = spelled

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        got = self[word] = self.spelled(word)
        return got


class MergeAutomaton:
    """Compiled from a tokenizers file of a byte-level BPE whose last symbol of a word carries a suffix."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("a plain BPE model is needed")
        self.suffix = model.get("end_of_word_suffix") or ""
        labels = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.label = [labels.get(i, "") for i in range(max(labels) + 1)]
        self.arc = model["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.pattern = regex.compile(_REORDERED.get(pattern, pattern))
        self.blind = pattern in _REORDERED  # none of its words holds white space, so runs of it need no change
        self.rules = json.dumps({
            "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": spec.get("normalizer"), "pre_tokenizer": split,
            "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {}, "merges": []}})
        self.library: Tokenizer | None = None
        self.odd = self.odd_characters(pattern)
        self.high = regex.compile(f"[{regex.escape(min(self.odd))}-\U0010ffff]") if self.odd else None
        self.letters = byte_letters()
        size = len(self.label)
        self.width = list(map(len, self.label))
        self.ending = {t.removesuffix(self.suffix): i for t, i in self.arc.items() if t.endswith(self.suffix)}
        self.longest_ending = max(map(len, self.ending), default=0)
        self.labels_at = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in self.arc.items():
            if not (self.suffix and t.endswith(self.suffix)):
                self.labels_at.add_word(t, i)
        self.labels_at.make_automaton()
        self.made = [0] * size  # when the arc was added; 0: a base symbol
        self.first, self.last = list(range(size)), list(range(size))
        self.gadget: dict[tuple[int, int], int] = {}
        for rank, (u, v) in enumerate(map(self._pair, model["merges"]), 1):
            self.add_gadget(u, v, rank)
        self.table: dict[int, bool] = {}
        self.memo = Memo(self.spelled)
        self.size = size

    @staticmethod
    def _pair(merge) -> tuple[str, str]:
        return tuple(merge) if not isinstance(merge, str) else tuple(merge.split(" ", 1))

    def add_gadget(self, u: str, v: str, rank: int) -> None:
        """From now on u v is spelled by the arc uv alone."""
        a, b, w = self.arc[u], self.arc[v], self.arc[u + v]
        self.gadget[a, b] = rank
        if not self.made[w]:
            self.made[w], self.first[w], self.last[w] = rank, a, b

    def follows(self, state: int, arc: int) -> bool:
        """Whether `arc` leaves `state` once all gadgets are in."""
        key = state * self.size + arc
        known = self.table.get(key)
        if known is None:
            known = self.table[key] = self._resolve(state, arc)
        return known

    def _resolve(self, state: int, arc: int) -> bool:
        """Undo the younger of both merges step by step: a gadget that was in place by then closed the arc."""
        clock = _NEVER
        while True:
            if self.gadget.get((state, arc), _NEVER) < clock:
                return False
            if self.made[state] > self.made[arc]:
                clock, state = self.made[state], self.last[state]
            elif self.made[arc]:
                clock, arc = self.made[arc] + 1, self.first[arc]
            else:
                return True

    def walk(self, word: str) -> tuple[int, ...]:
        """Token ids of one pre-split word: the automaton's only path that spells it."""
        spelled = "".join(map(self.letters.__getitem__, word.encode()))
        n, width, size, table, ending = len(spelled), self.width, self.size, self.table, self.ending
        states, starts = [-1] * n, [0] * n  # state behind so many letters, and where its arc begins
        for end, t in self.labels_at.iter(spelled, 0, n - 1) if n > 1 else ():
            end += 1
            if states[end] < 0:
                start = end - width[t]
                if start:
                    ok = table.get(states[start] * size + t)
                    if not (self.follows(states[start], t) if ok is None else ok):
                        continue
                states[end], starts[end] = t, start
        for start in range(max(0, n - self.longest_ending), n):
            t = ending.get(spelled[start:])
            if t is not None and (not start or self.follows(states[start], t)):
                break
        else:
            raise ValueError(f"the vocabulary cannot spell {word!r}")
        path = [t]
        while start:
            path.append(states[start])
            start = starts[start]
        return tuple(reversed(path))

    def spelled(self, word: str) -> tuple[int, ...]:
        if len(self.table) >= 2 * MEMO_WORDS:
            self.table.clear()
        return self.walk(word)

    def normal(self, text: str) -> str:
        """NFC, white space runs to one blank, lower case letter by letter."""
        return self.lowered(_SPACE.sub(" ", unicodedata.normalize("NFC", text)))

    @staticmethod
    def lowered(text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def __getstate__(self):
        return self.__dict__ | {"library": None, "memo": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.memo = Memo(self.spelled)

    def own_rules(self) -> Tokenizer:
        """The tokenizer's own normaliser and splitter."""
        if self.library is None:
            self.library = Tokenizer.from_str(self.rules)
        return self.library

    def odd_characters(self, pattern: str) -> frozenset[str]:
        """Characters that the library normalises or sorts otherwise than `normal` and the `regex` module do."""
        every = "".join(chr(c) for c in chain(range(0xD800), range(0xE000, 0x40000), range(0xE0000, 0xF0000)))
        odd = set()
        for kind in set(regex.findall(r"\\[pP]\{\w+\}|\\[sSdDwW]", pattern)):
            others = "".join(x for x, _ in pre_tokenizers.Split(Regex(kind), "removed").pre_tokenize_str(every))
            odd |= set(regex.sub(kind, "", every)) ^ set(others)
        every = every.replace("\x01", "")
        normalizer, parted = self.own_rules().normalizer, "\x01".join(every)
        theirs = normalizer.normalize_str(parted) if normalizer else parted
        odd.update(c for c, x, y in zip(every, theirs.split("\x01"), self.normal(parted).split("\x01"), strict=True) if x != y)
        return frozenset(odd)

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if text.isascii():
            return self.pattern.findall(text.lower() if self.blind else self.normal(text))
        if self.high is None or self.odd.isdisjoint(self.high.findall(text)):
            return self.pattern.findall(self.lowered(text) if self.blind else self.normal(text))
        rules = self.own_rules()
        text = rules.normalizer.normalize_str(text) if rules.normalizer else text
        return [w for w, _ in rules.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for part in self.split_special.split(text) if any(map(text.__contains__, self.special)) else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            out.extend(chain.from_iterable(map(self.memo.__getitem__, self.words(part))))
        return out

    def decode(self, ids) -> str:
        """Labels of the arcs, joined as the tokenizer without a decoder joins them."""
        return " ".join(map(self.label.__getitem__, ids))


def compile_file(path: str) -> MergeAutomaton:
    with open(path, encoding="utf-8") as f:
        return MergeAutomaton(json.load(f))


def encode(df: DataFrame, path: str, text: str = "text", into: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Add the token ids of each whole text; `decoded` also adds the text that these ids stand for."""
    model = share(df.sparkSession, compile_file(path))
    df = without(df, into, *([decoded] if decoded else []))
    fields = [T.StructField(into, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model()
        for batch in _slices(batches):
            ids = [automaton.encode(t) for t in batch.column(text).to_pylist()]
            offsets = np.cumsum([0, *map(len, ids)])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))]
            if decoded:
                columns.append(pa.array([automaton.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def decode(df: DataFrame, path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """Add the text that the token ids stand for."""
    model = share(df.sparkSession, compile_file(path))
    df = without(df, into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model()
        for batch in _slices(batches):
            texts = [automaton.decode(x or ()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.StringType())]))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that their tokens stay small in memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


by_value(__name__)
