"""Language of whole texts by bit-sliced Bloom filters over letter n-grams.

Each position of the filter holds one bit per language. A look-up ANDs the rows of the n-gram's hash positions and so returns all
languages that contain it, as one bitmask. Per text and language the set bits are counted (popcounts by slice), corrected for
the false positives that the fill of the slice makes likely and for the share of n-grams that own texts hit; the largest share decides.

An n-gram belongs to a language when its share there is at least `keep` of its largest share. Fitting reads at most `fit_rows` texts,
those with the smallest checksum of their id; every text is read in full when it is judged. A null text or one without a letter
is `und` with score 0 (columns with the names of results are replaced), and so is every text if nothing could be learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entiform.llm.common import by_value, checksum, share, without

UNKNOWN = "und"
#: Code points per letter n-gram: three of 21 bits fill a 63-bit number.
GRAM = 3
#: Code points that are worked on at once.
_PIECE = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Letters:
    """N-grams of texts: letters in lower case, every other run one blank."""

    def __init__(self):
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def grams(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Batches of (n-grams, index of their text, letters per text of the batch's texts by index)."""
        todo, size = [], 0
        for k, text in enumerate(texts):
            for at in range(0, len(text or ""), _PIECE):
                piece = text[max(0, at - GRAM + 1):at + _PIECE].lower()
                todo.append((k, piece))
                size += len(piece)
                if size >= _PIECE:
                    yield self._batch(todo, len(texts))
                    todo, size = [], 0
        if todo:
            yield self._batch(todo, len(texts))

    def _batch(self, pieces: list[tuple[int, str]], n: int):
        codes = np.frombuffer("".join(f" {p} " for _, p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.array([k for k, _ in pieces]), [len(p) + 2 for _, p in pieces])
        letter = self.is_letter[codes]
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        kept[0] = True
        codes = np.where(letter, codes, 32)[kept].astype(np.uint64)
        letters = np.bincount(owner[letter], minlength=n)
        owner, letter = owner[kept], letter[kept]
        gram = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
        whole = (owner[:-2] == owner[2:]) & letter[1:-1]  # the middle one is a letter
        return gram[whole], owner[:-2][whole], letters


@dataclass
class LanguageModel:
    languages: list[str]
    slices: np.ndarray  # rows: filter positions; columns: words of 64 languages
    hashes: int
    false_rate: np.ndarray
    own_rate: np.ndarray
    prior: np.ndarray

    def contains(self, grams: np.ndarray) -> np.ndarray:
        """Bitmask of the languages that contain each n-gram."""
        shift = np.uint64(64 - (len(self.slices).bit_length() - 1))
        out = None
        for m in _MULTIPLIERS[:self.hashes]:
            rows = self.slices[((grams ^ (grams >> np.uint64(31))) * m) >> shift]
            out = rows if out is None else out & rows
        return out

    def judge(self, texts: list[str | None], letters: Letters) -> tuple[list[str], list[float]]:
        n, k = len(texts), len(self.languages)
        hits, total, letter_count = np.zeros((n, k)), np.zeros(n), np.zeros(n)
        for grams, owner, seen in letters.grams(texts):
            letter_count += seen
            total += np.bincount(owner, minlength=n)
            masks = self.contains(grams)
            for i in range(k):
                bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                hits[:, i] += np.bincount(owner[bit.astype(bool)], minlength=n)
        real = np.maximum(0.0, hits - total[:, None] * self.false_rate) / (1 - self.false_rate) / self.own_rate
        real = (real + 1e-6 * self.prior) / np.maximum(total, 1)[:, None]
        best = real.argmax(1)
        share = real[np.arange(n), best] / real.sum(1)
        known = letter_count > 0
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)], np.where(known, share, 0.0).tolist()


def build(counts: list[tuple[str, int, int]], documents: dict[str, int], keep: float, min_count: int, bits_per_gram: int, hashes: int) -> LanguageModel:
    """Filters from (language, n-gram, count) rows."""
    languages = sorted(documents)
    index = {name: i for i, name in enumerate(languages)}
    gram = np.array([g for _, g, _ in counts], np.uint64)
    lang = np.array([index[x] for x, _, _ in counts])
    count = np.array([c for _, _, c in counts], float)
    total = np.bincount(lang, count, len(languages))
    grams, at = np.unique(gram, return_inverse=True)
    share, top = count / total[lang], np.zeros(len(grams))
    np.maximum.at(top, at, share)
    member = (share >= keep * top[at]) & (count >= min_count)
    size = 1 << max(10, int(np.ceil(np.log2(max(1, member.sum() * bits_per_gram)))))
    slices = np.zeros((size, (len(languages) + 63) // 64), np.uint64)
    shift = np.uint64(64 - (size.bit_length() - 1))
    for i in range(len(languages)):
        own = gram[member & (lang == i)]
        for m in _MULTIPLIERS[:hashes]:
            slices[((own ^ (own >> np.uint64(31))) * m) >> shift, i // 64] |= np.uint64(1) << np.uint64(i % 64)
    fill = np.array([((slices[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    own_rate = np.maximum(1e-3, np.bincount(lang[member], share[member], len(languages)))
    documents = np.array([documents[x] for x in languages], float)
    return LanguageModel(languages, slices, hashes, np.minimum(0.5, fill ** hashes), own_rate, documents / documents.sum())


def fit(docs: DataFrame, fit_rows: int = 12_000, folds: int = 4, held_out: int = 2, keep: float = 0.6, min_count: int = 3,
        bits_per_gram: int = 12, hashes: int = 3, max_grams: int = 100_000) -> LanguageModel | None:
    """Learn the filters from at most `fit_rows` texts with a language outside the held-out fold; of each language the `max_grams` commonest n-grams are kept."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & (checksum("doc_id") % folds != held_out))
    known = usable.select("doc_id").distinct().orderBy(checksum("doc_id"), "doc_id").limit(fit_rows)
    rows = usable.select("doc_id", "lang", "text").join(F.broadcast(known), "doc_id").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, seen = Letters(), {}
        for batch in batches:
            for name, group in batch.groupby("lang"):
                parts = [g for g, _, _ in letters.grams(group["text"].tolist())]
                gram, n = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_counts=True)
                docs_gram, docs_n = seen.get(name, (np.zeros(0, np.uint64), np.zeros(0)))
                both, at = np.unique(np.concatenate([docs_gram, gram, [np.uint64(0)]]), return_inverse=True)
                seen[name] = both, np.bincount(at, np.concatenate([docs_n, n, [len(group)]]))  # 0 counts the texts
        for name, (gram, n) in seen.items():
            yield pd.DataFrame({"lang": name, "gram": gram.astype("int64"), "n": n.astype("int64")})

    counts = (rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
              .where((F.col("n") >= min_count) | (F.col("gram") == 0)))
    order = Window.partitionBy("lang").orderBy((F.col("gram") != 0), F.desc("n"), "gram")
    counts = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_grams + 1).drop("rank").collect()
    documents = {r["lang"]: r["n"] for r in counts if r["gram"] == 0}
    counts = [(r["lang"], r["gram"], r["n"]) for r in counts if r["gram"] and r["lang"] in documents]
    return build(counts, documents, keep, min_count, bits_per_gram, hashes) if counts else None


def identify(df: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Add `lang_pred` and `score` (share of the best language) to each row."""
    df = without(df, "lang_pred", "score")
    if model is None:
        return df.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = share(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for batch in batches:
            names, scores = shared().judge(batch.column(text).to_pylist(), letters)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


by_value(__name__)
