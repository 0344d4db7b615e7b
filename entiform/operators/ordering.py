"""First-seen, last-seen, limits and ranks, always by an explicit order column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entiform import fixed
from entiform.functions.storage import tasks_for
from entiform.operators.lookups import row_salt


def _columns(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def keep_per_key(df: DataFrame, keys: str | Sequence[str], ord: str = "ord", keep: str = "first") -> DataFrame:
    """One row per key: the first or the last by `ord`. Each map task passes on one row per key."""
    order = F.col(ord).asc() if keep == "first" else F.col(ord).desc()
    w = Window.partitionBy(*_columns(keys)).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def top_n_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], n: int,
                    rank: str | None = None) -> DataFrame:
    """First n rows of each group; `rank` names a column that keeps the position from 1."""
    name = rank or "_rank"
    w = Window.partitionBy(*_columns(group)).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def limit_per_search(df: DataFrame, n: int, search: str = "search_id", ord: str = "ord") -> DataFrame:
    """At most n rows of each search; 0 means no limit."""
    return df if n <= 0 else top_n_per_group(df, search, [F.col(ord)], n)


def saturated_searches(df: DataFrame, search: str = "search_id", cap: int = fixed.SEARCH_SOURCE_CAP,
                       limit: int = 0) -> DataFrame:
    """Searches that reached the source's cap, so that results are probably missing; none under a limit."""
    counted = df.groupBy(search).agg(F.count("*").alias("rows_found"))
    return counted.filter(F.lit(limit <= 0) & (F.col("rows_found") >= cap))


def first_n(df: DataFrame, n: int, ord: str = "ord") -> DataFrame:
    return df.orderBy(ord).limit(n)


def distinct_first_seen(df: DataFrame, group: str | Sequence[str], value: str, ord: str = "ord",
                        n: int = 0) -> DataFrame:
    """Distinct values of each group with their first position; at most n per group when n > 0."""
    groups = _columns(group)
    seen = df.groupBy(*groups, value).agg(F.min(ord).alias("first_ord"))
    return seen if n <= 0 else top_n_per_group(seen, groups, [F.col("first_ord")], n)


def cited_sources(df: DataFrame, group: str | Sequence[str], url: str = "url", ord: str = "ord",
                  most: int | None = fixed.MAX_CITED) -> DataFrame:
    """Distinct sources of each group, at most `most` (None: all)."""
    return distinct_first_seen(df, group, url, ord, most or 0)


def dedup_by_slug(records: DataFrame, force: bool = False, ord: str = "task_ord") -> DataFrame:
    """One record per slug: the first task, or the last one with `force`."""
    return keep_per_key(records, "slug", ord, "last" if force else "first")


def page_budget(pages: DataFrame, site: str = "site", rank: str = "path_rank", ok: str = "ok",
                max_pages: int = fixed.MAX_PAGES, extra: int = fixed.EXTRA_ATTEMPTS, parts: int | None = None) -> DataFrame:
    """Pages read within a site's budget.

    Attempts follow `rank` (0 is the home page). They stop after `max_pages` reachable pages or `extra`
    more attempts than that; of several visits of one path a reachable one counts, the first by url and page_id; a site whose home page was not reached is dropped. Only reachable pages are returned.
    `parts`: tasks of the two shuffles, by default as many as the rows need; with long texts, see `tasks_for`.
    """
    max_pages = max(1, max_pages)
    tie = [F.col(c) for c in ("url", "page_id") if c in pages.columns]
    known = pages.filter(F.col(rank).isNotNull()).withColumn("_unread", (~F.col(ok)).cast("int"))
    parts = parts or tasks_for(known)
    first = [F.col("_unread"), *tie]
    # Visits of one path are cut in spread parts before the rows of a site meet. Both shuffles have a given number of tasks,
    # since Spark's own number does not follow the rows.
    dealt = known.withColumn("_salt", row_salt(known)).repartition(parts, site, rank, "_salt")
    tried = top_n_per_group(dealt, [site, rank, "_salt"], first, 1).drop("_salt").repartition(parts, site)
    tried = top_n_per_group(tried, [site, rank], first, 1)
    tried = top_n_per_group(tried, site, [F.col(rank)], max_pages + extra)
    before = Window.partitionBy(site).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(site)
    return (
        tried.withColumn("_seen", F.coalesce(F.sum(F.col(ok).cast("int")).over(before), F.lit(0)))
        .withColumn("_home", F.max((F.col(rank) == 0) & F.col(ok)).over(whole))
        .filter(F.col("_home") & F.col(ok) & (F.col("_seen") < max_pages))
        .drop("_seen", "_home", "_unread")
    )
