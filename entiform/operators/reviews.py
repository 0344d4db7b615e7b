"""Review insight per lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiform import fixed, schemas
from entiform.functions import places
from entiform.functions.text import collapse, trim, truncate
from entiform.operators.ordering import top_n_per_group


def read_reviews(reviews: DataFrame, max_reviews: int = fixed.MAX_REVIEWS, read: int | None = fixed.REVIEWS_READ) -> DataFrame:
    """The reviews a run looks at: first `read` of a lead (None: all), without empty ones, then the first `max_reviews`.

    Adds `rank` from 1. Each map task passes on at most `read` rows per lead.
    """
    head = reviews.withColumns({"text": trim(F.col("text")), "rating_label": trim(F.col("rating_label"))})
    head = head if read is None else top_n_per_group(head, "lead_id", [F.col("pos")], read)
    return top_n_per_group(head.filter("text <> ''"), "lead_id", [F.col("pos")], max_reviews, rank="rank")


def review_corpus(reviews: DataFrame, max_reviews: int = fixed.MAX_REVIEWS, cut: int | None = fixed.REVIEW_TEXT_CUT,
                  read: int | None = fixed.REVIEWS_READ) -> DataFrame:
    """(lead_id, corpus): numbered lines with rating and text, shortened to `cut` characters (None: whole)."""
    flat = F.regexp_replace("text", "[\\s\\u00a0\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+", " ")
    line = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] ("),
        F.when(F.length("rating_label") > 0, F.col("rating_label")).otherwise(F.lit("?")), F.lit(") "),
        flat if cut is None else F.substring(flat, 1, cut))
    rows = read_reviews(reviews, max_reviews, read).select("lead_id", "rank", line.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return rows.groupBy("lead_id").agg(F.array_join(ordered["line"], "\n").alias("corpus"))


def review_insight(leads: DataFrame, reviews: DataFrame, summaries: DataFrame | None = None,
                   max_reviews: int = fixed.MAX_REVIEWS, excerpts: int = fixed.EXCERPTS, excerpt_cut: int | None = fixed.EXCERPT_CUT,
                   read: int | None = fixed.REVIEWS_READ) -> DataFrame:
    """Patch rows (ord, id, reviews). `summaries(id, summary, sentiment, highlights)` are parsed answers.

    A lead's own count and rating are preferred. Without an answer the highlights are the first `excerpts` texts, shortened to
    `excerpt_cut` characters (None: whole).
    """
    rows = read_reviews(reviews, max_reviews, read)
    excerpt = F.when(F.length("text") > fixed.EXCERPT_MIN, F.struct(
        "rank", (F.col("text") if excerpt_cut is None else truncate(F.col("text"), excerpt_cut)).alias("text")))
    per_lead = rows.groupBy(F.col("lead_id").alias("id")).agg(
        F.count("*").alias("n"),
        F.round(F.avg(places.rating_label(F.col("rating_label"))), 2).alias("avg"),
        F.slice(F.array_sort(F.collect_list(excerpt)), 1, excerpts)["text"].alias("excerpts"))
    joined = leads.select("ord", "id", "reviews_count", "google_rating").join(per_lead, "id")
    if summaries is None:
        summary, sentiment = F.lit(None).cast("string"), F.lit(None).cast("string")
        highlights: Column = F.col("excerpts")
    else:
        joined = joined.join(summaries.select("id", "summary", "sentiment", "highlights"), "id", "left")
        summary, sentiment = F.col("summary"), F.col("sentiment")
        highlights = F.when(sentiment.isNotNull(), F.col("highlights")).otherwise(F.col("excerpts"))
    insight = F.struct(
        F.coalesce("reviews_count", "n").alias("count"), F.coalesce("google_rating", "avg").alias("average"),
        summary.alias("summary"), sentiment.alias("sentiment"),
        F.coalesce(highlights, F.array().cast("array<string>")).alias("highlights"))
    return joined.select("ord", "id", insight.cast(schemas.REVIEWS).alias("reviews"))
