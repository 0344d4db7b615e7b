"""Conversations as training text: one string per conversation, with a loss mask over the assistant's texts.

All native: the turns of a conversation are collected as structs and sorted, runs of turns with one role are merged by array aggregation,
and the pieces are concatenated. Work and memory grow with the length of the longest conversation, which is one row of the result anyway.

Template, with roles taken as they are:

    <|turn|>user<|text|>Hello<|next|>are you there?<|end|><|turn|>assistant<|text|>Yes.<|end|>

`<|next|>` stands between merged turns, so reading back gives the turns that were put in. Inside texts and roles a backslash is
doubled, and one is set after the first character of each control string (those of the template and of `CONTROLS`), so no text can look like
markup and every text can be had back.

Null texts and roles count as empty. Turns are ordered by turn, role, text; null turns come first, repeated rows stay. Rows with a null
conversation id form one conversation. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: Control strings of well-known templates, which texts must not be able to imitate.
CONTROLS = (TURN, TEXT, NEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


def escape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """Reversible: backslashes doubled, one set after the first character of each control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), controls, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 learned: str = "assistant", controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(conv, formatted, loss_spans): the text of each conversation and the code point spans (start, length) that count for the loss.

    A span covers the escaped text of one turn of the role `learned`.
    """
    empty = F.lit("")
    rows = turns.select(F.col(conv).alias("conv"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    said = sorted_turns.select(
        "conv", F.transform("turns", lambda t: escape(t["role"], controls)).alias("roles"), F.transform("turns", lambda t: escape(t["text"], controls)).alias("texts"))
    starts = said.withColumn("starts", F.filter(
        F.sequence(F.lit(0), F.size("roles") - 1),
        lambda i: (i == 0) | (F.get("roles", i) != F.get("roles", i - 1))))
    runs = starts.select("conv", F.transform("starts", lambda s, k: F.struct(
        F.get("roles", s).alias("role"),
        F.slice("texts", s + 1, F.coalesce(F.get("starts", k + 1), F.size("texts")) - s).alias("texts"))).alias("runs"))
    pieces = runs.select("conv", F.flatten(F.transform("runs", lambda r: F.concat(
        F.array(F.struct(F.concat(F.lit(TURN), r["role"], F.lit(TEXT)).alias("piece"), F.lit(False).alias("loss"))),
        F.flatten(F.transform(r["texts"], lambda t, k: F.when(k == 0, F.array(F.struct(t.alias("piece"), (r["role"] == learned).alias("loss")))).otherwise(
            F.array(F.struct(F.lit(NEXT).alias("piece"), F.lit(False).alias("loss")), F.struct(t.alias("piece"), (r["role"] == learned).alias("loss")))))),
        F.array(F.struct(F.lit(END).alias("piece"), F.lit(False).alias("loss")))))).alias("pieces"))
    placed = pieces.select("conv", "pieces", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"))
    return placed.select(F.col("conv").alias(conv), "formatted", _spans(F.col("pieces")).alias("loss_spans"))


def _spans(pieces: Column) -> Column:
    """Spans of the pieces under the loss."""
    step = F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["piece"])).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.length(p["piece"]).alias("length")))))
            .otherwise(acc["spans"]).alias("spans")))
    return step["spans"]


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    runs = F.filter(F.split(formatted, r"<\|turn\|>"), lambda r: r != "")
    return F.flatten(F.transform(runs, lambda r: F.transform(
        F.split(F.substring_index(F.substring_index(r, END, 1), TEXT, -1), r"<\|next\|>"),
        lambda t: F.struct(unescape(F.substring_index(r, TEXT, 1)).alias("role"), unescape(t).alias("text")))))


def under_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, one for each span."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))
