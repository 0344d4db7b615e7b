"""How far the word use of the sources of one language lies apart, and which terms set a source off.

Every group (language, source) gives each kept term of its language a whole number p, its share in billionths with one occurrence added. Two
groups lie apart by the sum of floor((p - q)^2 / q) over all kept terms. Most terms occur in neither of them, so the sum starts from the
baselines (p of a term that does not occur) and is corrected where a term occurs:

    V f(a0, b0)  +  sum over terms of a: f(a, b0) - f(a0, b0)  +  sum over terms of b: f(a0, b) - f(a0, b0)
                 +  sum over terms of both: f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)

The first three follow from how many terms of a group have which p. The last one is Gustavson's row accumulation: kept counts are dealt out
by term, so that a part holds its terms' whole rows of the term-major index; in it, each group scatters its terms through that index into a
dense accumulator with one cell for each peer. What leaves the part is one number for each pair of groups that share a term, never a pair of
postings. All arithmetic is on whole numbers; shares are worked out as decimals, so counts may be of any size.

Null text, language and source count as ''. Each row is a document, also where ids repeat. A group without terms has only baselines; where a
language keeps no term, all pairs have the value 0. An empty table gives no rows. Only the three named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entiform.functions.storage import Scratch
from entiform.llm.common import by_value
from entiform.operators.lookups import lookup_join

SCALE = 1_000_000_000
#: Counts that one part of the term-major index holds, counts a task holds before it passes them on, peers in one block of baselines.
PART_ROWS, HELD_TERMS, PEERS = 300_000, 300_000, 4_096
#: ASCII letters and all bytes of other characters.
TERM = re.compile(rb"[a-z\x80-\xff]+")


def _counts(batches):
    """(lang, source, term, n, docs) of the documents of a task, combined as far as memory allows."""
    def passed(held):
        keys, terms, n, docs = [], [], [], []
        for key, (seen, on) in held.items():
            keys += [key] * len(seen)
            terms += [t.decode() for t in seen]
            n += seen.values()
            docs += [on[t] for t in seen]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
            ["lang", "source", "term", "n", "docs"])

    held: dict = defaultdict(lambda: (Counter(), Counter()))
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            # Lower case of bytes changes A-Z alone.
            found = TERM.findall(text.encode().lower())
            seen, on = held[lang, source]
            size -= len(seen)
            seen.update(found)
            on.update(set(found))
            size += len(seen)
            if size > HELD_TERMS:
                yield passed(held)
                held.clear()
                size = 0
    yield passed(held)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and documents of the group that have it."""
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c2) for c, c2 in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = given.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share_of(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms))."""
    wide = "decimal(19,0)"
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast(wide), (total + terms).cast(wide))


def _apart(p, q):
    return (p - q) * (p - q) // q


def _scatter(table: pa.Table) -> pa.Table:
    """(lang, source, item, value): the part of each pair's sum that comes from the terms both have, for one part of the index."""
    lang = table.column("lang")[0].as_py()
    terms = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    groups = table.column("source").combine_chunks().dictionary_encode()
    names, group = groups.dictionary, groups.indices.to_numpy()
    order = np.argsort(terms, kind="stable")
    terms, group = terms[order], group[order].astype(np.int64)
    p, zero = table.column("p").to_numpy()[order], table.column("p0").to_numpy()[order]
    row = np.append(0, np.cumsum(np.bincount(terms)))  # the index: postings of term t are row[t] to row[t + 1]
    base = np.zeros(len(names), np.int64)
    base[group] = zero
    by_group = np.argsort(group, kind="stable")
    first = np.append(0, np.cumsum(np.bincount(group, minlength=len(names))))
    out_a, out_b, out_v = [], [], []
    for a in range(len(names)):
        mine = by_group[first[a]:first[a + 1]]
        wide = row[terms[mine] + 1] - row[terms[mine]]
        at = np.repeat(row[terms[mine]] - np.append(0, np.cumsum(wide)[:-1]), wide) + np.arange(wide.sum())
        pa_, b, pb, b0 = np.repeat(p[mine], wide), group[at], p[at], zero[at]
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, b, _apart(pa_, pb) - _apart(pa_, b0) - _apart(base[a], pb) + _apart(base[a], base)[b])
        sums[a] = 0
        hit = np.flatnonzero(sums)
        out_a.append(np.full(len(hit), a))
        out_b.append(hit)
        out_v.append(sums[hit])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": names.take(pa.array(a)), "item": names.take(pa.array(b)), "value": pa.array(np.concatenate(out_v), pa.int64())})


def _baselines(batches):
    """The part of each pair's sum that baselines and the terms of one side alone give: group against a block of its peers."""
    for batch in batches:
        for g in batch.to_pylist():
            p, n = np.array(g["ps"], np.int64), np.array(g["ns"], np.int64)
            names, q = [x["source"] for x in g["peers"]], np.array([x["p0"] for x in g["peers"]], np.int64)
            a0 = np.int64(g["p0"])
            out, back = _apart(a0, q) * g["terms"], np.zeros(len(q), np.int64)
            for value, times in zip(p, n):
                out += times * (_apart(value, q) - _apart(a0, q))
                back += times * (_apart(q, value) - _apart(q, a0))
            keep = np.array([x != g["source"] for x in names], bool)
            mine, others = [g["source"]] * int(keep.sum()), [x for x, k in zip(names, keep) if k]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g["lang"]] * 2 * len(mine), pa.string()), pa.array(mine + others, pa.string()), pa.array(others + mine, pa.string()), pa.array(np.concatenate([out[keep], back[keep]]), pa.int64())],
                ["lang", "source", "item", "value"])


def audit(docs: DataFrame, min_docs: int = 3, top_terms: int = 200, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has how far each other source of the language lies from this one, part `term`
    the terms that the group uses more than its language does. Terms count that `min_docs` documents of the language have."""
    scratch = Scratch(docs.sparkSession, "divergence")
    of_term = Window.partitionBy("lang", "term")
    kept = scratch.write(
        term_counts(docs, text, lang, source).select(
            "lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("lang_n"), (F.min("source").over(of_term) == F.col("source")).alias("first"))
        .where(F.col("docs") >= min_docs).drop("docs"), "kept")
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c2) for c, c2 in ((lang, "lang"), (source, "source"))]).distinct()
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    zero = F.lit(0).cast("long")
    groups = named.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["total", "terms", "rows", "lang_total"])
    groups = scratch.write(groups.withColumn("p0", F.when(F.col("terms") > 0, share_of(zero, F.col("total"), F.col("terms"))).otherwise(1)), "groups")

    shares = scratch.write(
        lookup_join(kept, groups.where("rows > 0"), ["lang", "source"], weight="rows").select(
            "lang", "source", "term", "p0", share_of(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share_of(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")), "shares")

    parts = -(-shares.count() // PART_ROWS)
    both = (shares.select("lang", "source", "term", "p", "p0").withColumn("part", F.pmod(F.xxhash64("term"), F.lit(max(parts, 1))))
            .groupBy("lang", "part").applyInArrow(lambda t: _scatter(t), "lang string, source string, item string, value long"))
    used = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).groupBy("lang", "source").agg(
        F.collect_list(F.struct("p", "n")).alias("used"))
    blocks = groups.withColumn("size", F.count("*").over(Window.partitionBy("lang"))).withColumn(
        "block", F.pmod(F.xxhash64("source"), F.ceil(F.col("size") / PEERS))).groupBy("lang", "block").agg(F.collect_list(F.struct("source", "p0")).alias("peers"))
    sided = groups.join(used, ["lang", "source"], "left").select(
        "lang", "source", "p0", "terms", F.coalesce("used.p", F.array().cast("array<long>")).alias("ps"), F.coalesce("used.n", F.array().cast("array<long>")).alias("ns"))
    alone = sided.join(blocks.select("lang", "peers"), "lang").mapInArrow(_baselines, "lang string, source string, item string, value long")
    # A pair meets its baselines from both sides; the term V f(a0, b0) comes with the side of a alone.
    pairs = alone.unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    ahead = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = ahead.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", F.row_number().over(order)).select(names).unionByName(ranked.select(names))


by_value(__name__)
