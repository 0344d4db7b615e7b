"""Stored search-result pages to results, and results to a text context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiform import fixed
from entiform.functions import web
from entiform.functions.storage import settle
from entiform.functions.text import trim
from entiform.operators.lookups import lookup_join
from entiform.operators.ordering import top_n_per_group

_BLOCK = r"""(?is)<[a-z][a-z0-9]*(?![\w-])[^>]*?\sclass\s*=\s*["'][^"'>]*(?<![\w-])result__body(?![\w-])[^>]*>"""
_TITLE = r"""(?is)<a(?![\w-])([^>]*(?<![\w-])result__a(?![\w-])[^>]*)>(.*?)</a\s*>"""
_SNIPPET = r"""(?is)<([a-z][a-z0-9]*)(?![\w-])[^>]*(?<![\w-])result__snippet(?![\w-])[^>]*>(.*?)</\1\s*>"""
_HREF = r"""(?is)href\s*=\s*["']([^"']*)["']"""


def _decoded_twice(target: Column) -> Column:
    """The value of a query parameter (a plus is a blank), then once more as a part of a URL (a plus stays)."""
    return F.try_url_decode(F.replace(F.try_url_decode(target), F.lit("+"), F.lit("%2B")))


def parse_result_pages(pages: DataFrame, max_results: int = 6, key: str = "page_id", base: str = fixed.RESULT_BASE) -> DataFrame:
    """(key, rank, title, url, snippet): results with a title and an http target.

    Targets are resolved against `base`; the target of a redirect is decoded from its link.
    """
    blocks = F.split("html", _BLOCK)
    rows = pages.select(key, F.posexplode(blocks).alias("pos", "block")).filter("pos > 0")
    href = web.decode_entities(F.regexp_extract(F.regexp_extract("block", _TITLE, 1), _HREF, 1))
    target = F.regexp_extract(href, r"(?s)[?&]uddg=([^&#]*)", 1)
    read = rows.select(
        key, "pos",
        trim(web.decode_entities(web.strip_tags(F.regexp_extract("block", _TITLE, 2)))).alias("title"),
        F.when(target != "", F.coalesce(_decoded_twice(target), href)).otherwise(web.resolve_url(href, F.lit(base))).alias("url"),
        trim(web.decode_entities(web.strip_tags(F.regexp_extract("block", _SNIPPET, 2)))).alias("snippet"))
    good = read.filter((F.col("title") != "") & F.rlike("url", F.lit("^https?://")))
    return top_n_per_group(good, key, [F.col("pos")], max_results, rank="rank").drop("pos")


def web_context(results: DataFrame, page_texts: DataFrame | None = None, max_results: int = 6, fetch_pages: int = 1,
                key: str = "task_id") -> DataFrame:
    """(key, text, sources): numbered result blocks, then the full text of the first pages."""
    kept = top_n_per_group(results, key, [F.col("rank")], max_results, rank="_i")
    if page_texts is not None:
        # one text for each URL, so that a URL with several texts does not repeat its result
        texts = page_texts.filter("text <> ''").groupBy(F.col("url").alias("_fetched")).agg(F.min("text").alias("_page"))
        kept = settle(kept.withColumn("_fetched", F.when(F.col("_i") <= fetch_pages, F.col("url"))), "results")
        kept = lookup_join(kept, texts, ["_fetched"]).drop("_fetched")
    else:
        kept = kept.withColumn("_page", F.lit(None).cast("string"))
    snippet = F.coalesce(F.nullif("snippet", F.lit("")), F.lit(fixed.NO_SNIPPET))
    block = F.concat(
        F.lit(fixed.RESULT_LABEL), F.col("_i").cast("string"), F.lit("] "), F.col("title"),
        F.lit("\n" + fixed.URL_LABEL), F.col("url"), F.lit("\n" + fixed.SNIPPET_LABEL), snippet)
    page = F.concat(F.lit(fixed.PAGE_LABEL), F.col("url"), F.lit("]\n"), F.col("_page"))
    # at most max_results rows per task meet here
    rows = F.array_sort(F.collect_list(F.struct("_i", block.alias("block"), page.alias("page"), "url")))
    grouped = kept.groupBy(key).agg(rows.alias("rows"))
    return grouped.select(
        key, F.array_join(F.concat("rows.block", F.array_compact("rows.page")), "\n\n").alias("text"),
        F.array_distinct("rows.url").alias("sources"))
