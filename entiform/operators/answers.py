"""Model answers: text to typed columns, with rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiform import fixed, schemas
from entiform.functions.text import trim


def json_text(answer: Column) -> Column:
    """The whole text when it is one JSON object, else the part from the first to the last brace; NULL if none."""
    body = trim(answer)
    inner = F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(_if_json(body), _if_json(inner))


def _if_json(text: Column) -> Column:
    # try_parse_json gives NULL on malformed text; the object test refuses bare values
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)


def _blank_number_to_null(text: Column) -> Column:
    return F.regexp_replace(text, '("(?:latitude|longitude|governance_confidence)"\\s*:\\s*)"\\s*"', "$1null")


def parse_record_answers(answers: DataFrame, answer: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(rows with a typed `parsed` struct, rows that hold no usable answer).

    A confidence outside 0..1 or a number that is none rejects the answer.
    """
    numbers = [n for n, t in schemas.ANSWER_FIELDS.items() if t == "double"]
    text_form = "struct<" + ",".join(f"{n}:string" for n in schemas.ANSWER_FIELDS) + ">"
    read = answers.withColumn("_json", json_text(F.col(answer))).withColumn(
        "_raw", F.from_json(_blank_number_to_null(F.col("_json")), text_form))
    parsed = F.struct(*[
        (F.col(f"_raw.{n}").try_cast("double") if n in numbers else F.col(f"_raw.{n}")).alias(n)
        for n in schemas.ANSWER_FIELDS])
    unreadable = F.lit(False)
    for n in numbers:
        unreadable = unreadable | (F.col(f"_raw.{n}").isNotNull() & F.col(f"_raw.{n}").try_cast("double").isNull())
    confidence = F.col("_raw.governance_confidence").try_cast("double")
    good = F.col("_json").isNotNull() & ~unreadable & F.coalesce(confidence.between(0, 1), F.lit(True))
    judged = read.withColumns({"parsed": parsed, "_good": good})
    extra = ["_json", "_raw", "_good"]
    return judged.filter("_good").drop(*extra), judged.filter(~F.col("_good")).drop(*extra, "parsed")


def parse_review_answers(answers: DataFrame, answer: str = "answer", most: int | None = fixed.MAX_HIGHLIGHTS) -> tuple[DataFrame, DataFrame]:
    """(rows with summary, sentiment, highlights; rows without JSON). An unknown sentiment becomes `mixed`.

    The first `most` highlights are kept (None: all).
    """
    listed = F.coalesce("_raw.highlights", F.array().cast("array<string>"))
    form = "struct<summary:string,sentiment:string,highlights:array<string>>"
    read = answers.withColumn("_json", json_text(F.col(answer))).withColumn("_raw", F.from_json("_json", form))
    known = F.col("_raw.sentiment").isin(*fixed.SENTIMENTS)
    good = read.filter(F.col("_json").isNotNull()).withColumns({
        "summary": F.coalesce(trim(F.col("_raw.summary")), F.lit("")),
        "sentiment": F.when(known, F.col("_raw.sentiment")).otherwise(F.lit("mixed")),
        "highlights": listed if most is None else F.slice(listed, 1, most),
    })
    return good.drop("_json", "_raw"), read.filter(F.col("_json").isNull()).drop("_json", "_raw")


def discovered_names(answers: DataFrame, city: str = "city", ord: str = "ord", answer: str = "answer") -> DataFrame:
    """(city, name, first_ord, first_pos): names listed under `hotels`, trimmed, longer than one character.

    Long form in first-seen order, so a city's list is never gathered in one place.
    """
    # a list item that is no string is skipped: each item is read as JSON text first
    items = F.from_json(json_text(F.col(answer)), "struct<hotels:array<variant>>")["hotels"]
    listed = answers.select(city, F.col(ord).alias("o"), F.posexplode(items).alias("p", "item"))
    text = F.when(F.schema_of_variant("item") == "STRING", F.try_variant_get("item", "$", "string"))
    named = listed.select(city, "o", "p", trim(text).alias("name")).filter(F.length("name") > 1)
    first = named.groupBy(city, "name").agg(F.min(F.struct("o", "p")).alias("first"))
    return first.select(city, "name", F.col("first.o").alias("first_ord"), F.col("first.p").alias("first_pos"))
