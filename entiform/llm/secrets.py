"""Secrets in whole texts: a trigram inverted index picks the texts that each rule's regex has to look at.

From each regex a Boolean trigram query is derived: every match must contain the trigrams of one of its alternatives. The index
holds (trigram, document) postings of those trigrams of each text that a query asks for; there may be any number of rules and trigrams. A rule's candidates are found by intersecting
and uniting postings; only they are matched with the regex. A rule whose regex has no mandatory trigram, such as a run of hex digits, is
matched against every text.

All native. Postings of a trigram are spread by document, never gathered, so a trigram that occurs in a third of all texts is no hot group.
Matches are leftmost and do not overlap within a rule; positions are code points, ends exclusive. A null text counts as empty. Rows with the same
or a null id are kept and judged one by one. An empty table gives no rows; a column secrets is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiform.llm.common import each, settle, without


@dataclass(frozen=True)
class Rule:
    """`pattern` in the common part of Java's and Python's syntax; a match counts if its group `group` has `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False


#: Base rules first; spans are ordered by start, then by the place of their kind in this list.
RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
BASE = ("assign", "access", "hex")

#: A query is True (no condition), a trigram, or ("and" | "or", queries).
Query = object


def _all(parts: list) -> Query:
    flat = {q for p in parts if p is not True for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p])}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _any(parts: list) -> Query:
    if any(p is True for p in parts):
        return True
    flat = {q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "or" else [p])}
    needs = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in flat}
    flat = {q for q in flat if not any(needs[o] < needs[q] for o in flat)}  # what asks for less decides
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def trigrams_of(strings: list[str]) -> Query:
    """What a text must contain if it contains one of the strings."""
    return _any([_all([s[i:i + 3] for i in range(len(s) - 2)]) for s in strings])


_MOST = 64  # exact strings that are followed at once


def _exact(tree, ignore_case: bool) -> list[str] | None:
    """All strings that the tree matches, or None if there are too many."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            here = [chr(arg).lower() if ignore_case else chr(arg)]
        elif name == "SUBPATTERN":
            here = _exact(arg[3], ignore_case)
        elif name == "BRANCH":
            parts = [_exact(b, ignore_case) for b in arg[1]]
            here = None if any(p is None for p in parts) else [s for p in parts for s in p]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            here = [chr(a).lower() if ignore_case else chr(a) for _, a in arg]
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 1:
            inner = _exact(arg[2], ignore_case)
            here = None if inner is None else ([""] if arg[0] == 0 else []) + inner
        else:
            return None
        if here is None or len(out) * len(here) > _MOST:
            return None
        out = [a + b for a in out for b in here]
    return out


def trigram_query(pattern: str, ignore_case: bool = False) -> Query:
    """Boolean trigram query of a regex: true for every text with a match. Trigrams are in lower case if `ignore_case`."""
    return _query(list(parser.parse(pattern)), ignore_case)


def _query(items: list, ignore_case: bool) -> Query:
    conditions, run = [], []

    def finish():
        if run:
            conditions.append(trigrams_of(_exact(run, ignore_case)))
            run.clear()

    for item in items:
        op, arg = str(item[0]), item[1]
        if _exact([*run, item], ignore_case) is not None:
            run.append(item)
            continue
        finish()
        if _exact([item], ignore_case) is not None:
            run.append(item)
        elif op == "SUBPATTERN":
            conditions.append(_query(list(arg[3]), ignore_case))
        elif op == "BRANCH":
            conditions.append(_any([_query(list(b), ignore_case) for b in arg[1]]))
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            conditions.append(_query(list(arg[2]), ignore_case))
    finish()
    return _all(conditions)


def query_trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(query_trigrams, query[1]))


def holds(query: Query, has) -> Column:
    """The query as a condition over `has(trigram)`."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return has(query)
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, [holds(q, has) for q in sorted(query[1], key=str)])


#: Bits of one word of a document's trigrams.
_WORD = 63


def _class(letters: set[str]) -> str:
    """A character class of these letters."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(letters)) + "]"


def _wanted_in(body: Column, keys: dict[str, int]) -> Column:
    """Keys of the trigrams of a text that are wanted, each once: one pass over the text, however many are wanted."""
    spot = "".join(_class({t[i] for t in keys}) for i in range(3))
    seen = F.array_intersect(F.regexp_extract_all(body, F.lit(f"(?=({spot}))"), F.lit(1)), F.array(*map(F.lit, keys)))
    number = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    return F.transform(seen, lambda t: F.element_at(number, t))


def postings(docs: DataFrame, wanted: dict[tuple[str, bool], int], doc: str, text: str) -> DataFrame:
    """Inverted index of the wanted (trigram, in lower case) keys, from each text's own trigrams: rows (key, doc)."""
    body = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    parts = [F.array().cast("array<int>")]
    for low, form in ((False, F.col("body")), (True, F.lower("body"))):
        keys = {t: k for (t, is_low), k in wanted.items() if is_low == low}
        if keys:
            parts.append(_wanted_in(form, keys))
    return each(body, "doc", array=F.concat(*parts), into="key")


def candidates(docs: DataFrame, rules: tuple[Rule, ...], doc: str, text: str) -> tuple[DataFrame, set[int]]:
    """(doc, ruled): the rules, by place, that each document is a candidate of; and the places of all indexed rules."""
    queries = [trigram_query(r.pattern, r.ignore_case) for r in rules]
    keys = sorted({(t, r.ignore_case) for r, q in zip(rules, queries) for t in query_trigrams(q)})
    wanted = {key: k for k, key in enumerate(keys)}
    # The lists of all trigrams are intersected at once: one bit a trigram, in as many words as it takes, united by document.
    words = [f"has{w}" for w in range(-(-len(wanted) // _WORD))] or ["has0"]
    bit = F.expr(f"shiftleft(1L, key % {_WORD})")
    index = postings(docs, wanted, doc, text)
    found = index.groupBy("doc").agg(*[F.bit_or(F.when(F.floor(F.col("key") / _WORD) == w, bit).otherwise(F.lit(0).cast("long"))).alias(c) for w, c in enumerate(words)])

    def has(rule):
        def one(t):
            k = wanted[t, rule.ignore_case]
            return F.col(words[k // _WORD]).bitwiseAND(F.lit(1 << k % _WORD)) != 0
        return one

    ruled = [F.when(holds(q, has(r)), F.lit(k)) for k, (r, q) in enumerate(zip(rules, queries)) if q is not True]
    picked = found.select("doc", F.array_compact(F.array(*ruled, F.lit(None).cast("int"))).alias("ruled")).where(F.size("ruled") > 0)
    return picked, {k for k, q in enumerate(queries) if q is not True}


def _matches(body: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule's matches that are long enough: the gaps between all matches give their places."""
    pattern = ("(?i)" if rule.ignore_case else "") + rule.pattern
    gaps, found = F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(body, F.lit(pattern), F.lit(rule.group)) if rule.group else found
    pieces = F.arrays_zip(gaps.alias("gap"), found.alias("match"), kept.alias("kept"))
    spans = F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,end:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0))).alias("at"),
            F.when(F.length(p["kept"]) >= max(rule.least, 1), F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(p["gap"])).alias("start"), F.lit(order).alias("order"), (acc["at"] + F.length(p["gap"]) + F.length(p["match"])).alias("end")))))
            .otherwise(acc["spans"]).alias("spans")))
    return spans["spans"]


def _quick(rule: Rule) -> str:
    """A pattern that finds whether there is a match that is long enough at all."""
    if rule.group == 0 and rule.least and rule.pattern.endswith("]+") and rule.pattern.startswith("[") and rule.pattern.count("[") == 1:
        return f"{rule.pattern[:-1]}{{{rule.least}}}"
    return ("(?i)" if rule.ignore_case else "") + rule.pattern


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Add `secrets`, the sorted array of (kind, start, end) of each whole text."""
    docs = without(docs, "secrets")
    picked, indexed = candidates(docs, rules, doc, text)
    picked = settle(picked, "secret-candidates").select(F.col("doc").alias("__doc"), F.col("ruled").alias("__ruled"))
    joined = docs.join(picked, docs[doc].eqNullSafe(F.col("__doc")), "left").withColumn("__body", F.coalesce(F.col(text), F.lit("")))
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    found = []
    for k, rule in enumerate(rules):
        wanted = F.coalesce(F.array_contains("__ruled", k), F.lit(False)) if k in indexed else F.lit(True)
        found.append(F.when(wanted & F.rlike("__body", F.lit(_quick(rule))), _matches(F.col("__body"), rule, k)).otherwise(none))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return joined.withColumn("secrets", F.transform(F.array_sort(F.flatten(F.array(*found))), lambda s: F.struct(
        F.get(kinds, s["order"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).select(*docs.columns, "secrets")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
