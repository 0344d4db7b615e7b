"""Edit distances of many names at once: bit vectors of Myers and Hyyrö, shared by all names with the same beginning."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

#: Longest first name, the bits of a word; and distances that are worked out at once.
LONGEST = 64
_AT_ONCE = 1 << 17


def codes(names: list[str]) -> np.ndarray:
    """Code points of names, one row each, filled with zeros."""
    wide = max([1, *map(len, names)])
    return np.array(names, f"<U{wide}").view(np.uint32).reshape(len(names), wide)


def _tree(letters: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the distinct beginnings of sorted names: (beginning without the last letter, last letter, names of this length, their beginning)."""
    out, before, rows = [], np.zeros(len(letters), np.int64), np.arange(len(letters))
    for at in range(letters.shape[1]):
        rows = rows[sizes[rows] > at]
        if not len(rows):
            break
        up, last = before[rows], letters[rows, at]
        new = np.r_[True, (np.diff(up) != 0) | (np.diff(last.astype(np.int64)) != 0)]
        before[rows] = np.cumsum(new) - 1
        ends = rows[sizes[rows] == at + 1]
        out.append((up[new], last[new], ends, before[ends]))
    return out


def close_pairs(a: list[str], b: list[str], allowed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in `a` and `b`, and distance, of all pairs not further apart than `allowed` of the name in `b`.

    All of `a` have one length, of 1 to LONGEST letters; `b` is sorted, without empty names.
    """
    size, letters = len(a[0]), codes(b)
    alphabet, letters = np.unique(letters, return_inverse=True)
    tree = _tree(letters.reshape(len(b), -1), np.array([len(x) for x in b]))
    mine = codes(a)
    places = np.searchsorted(alphabet, mine)
    known = alphabet[np.minimum(places, len(alphabet) - 1)] == mine
    bits = np.zeros((len(a), len(alphabet)), np.uint64)  # where a name has each letter
    for at in range(size):
        here = np.flatnonzero(known[:, at])
        bits[here, places[here, at]] |= np.uint64(1 << at)
    one, top = np.uint64(1), np.uint64(size - 1)
    step = max(1, _AT_ONCE // max(len(x[0]) for x in tree))
    for low in range(0, len(a), step):
        equal_to = bits[low:low + step]
        n = len(equal_to)
        plus, minus, score = np.full((n, 1), ~np.uint64(0)), np.zeros((n, 1), np.uint64), np.full((n, 1), size, np.int16)
        for up, last, ends, at in tree:
            if len(up) != plus.shape[1] or (up != np.arange(len(up))).any():
                plus, minus, score = plus[:, up], minus[:, up], score[:, up]
            equal = equal_to[:, last]
            down = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            more, less = minus | ~(across | plus), plus & across
            score = score + ((more >> top) & one).astype(np.int16) - ((less >> top) & one).astype(np.int16)
            more, less = (more << one) | one, less << one
            plus, minus = less | ~(down | more), more & down
            if len(ends):
                found = score[:, at]
                i, k = np.nonzero(found <= allowed[ends])
                if len(i):
                    yield low + i, ends[k], found[i, k]


def segment(size: int, k: int, i: int) -> int:
    """Start of segment i when a name of this size is cut into k+1 nearly equal segments."""
    return size * i // (k + 1)


def met_before(a: np.ndarray, b: np.ndarray, size_a: int, sizes_b: np.ndarray, k: int, i: int) -> np.ndarray:
    """Whether pairs of letters in rows of `a` and `b` also share one of the segments before i, k edits allowed."""
    out = np.zeros(len(a), bool)
    wide = np.pad(b, ((0, 0), (0, max(0, size_a + k - b.shape[1]))))
    for j in range(i):
        start, stop = segment(size_a, k, j), segment(size_a, k, j + 1)
        for shift in range(-(k // 2), k + 1):
            at, gap = start + shift, sizes_b - size_a
            if at < 0:
                continue
            fits = (shift >= -((k - gap) // 2)) & (shift <= (k + gap) // 2) & (at + stop - start <= sizes_b) & ~out
            rows = np.flatnonzero(fits)
            if len(rows):
                out[rows] = (a[rows, start:stop] == wide[rows, at:at + stop - start]).all(1)
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
