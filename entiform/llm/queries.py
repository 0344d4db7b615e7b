"""Registered queries of the operators; each applies its operator to the whole table it is meant for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entiform.llm import bpe, chat, decontaminate, divergence, embedding_dedup, html_extract, jaccard_join, langid, line_dedup, packing, secrets, toxicity, variants
from entiform.llm.common import checksum, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(checksum("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted", F.size("hits").cast("long").alias("n_hits"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "text", "lines_dropped")


OP2_SQL = """
WITH lines AS (SELECT DISTINCT source, rid, trim(line) AS line FROM (
    SELECT source, rowid AS rid, unnest(string_split(text, chr(10))) AS line FROM (SELECT *, row_number() OVER () AS rowid FROM documents)) WHERE trim(line) <> ''),
hosts AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
cut AS (SELECT l.source, l.line FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, l.line, h.pages HAVING count(*) >= 5 AND count(*) >= 0.05::DOUBLE * h.pages),
cuts AS (SELECT source, list(line) AS cut FROM cut GROUP BY source),
kept AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines,
    CASE WHEN cut IS NOT NULL THEN list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(cut, trim(x))) END AS kept
  FROM documents d LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, CASE WHEN kept IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text,
  CASE WHEN kept IS NULL THEN 0 ELSE len(lines) - len(kept) END AS lines_dropped
FROM kept"""


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


OP3_SQL = """
WITH both_tables AS (SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'i', item_id, text FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT side, id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') AS w FROM both_tables),
whole AS (SELECT DISTINCT side, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END) AS h FROM w),
short AS (SELECT DISTINCT id, array_to_string(w, ' ') AS h, len(w) AS k FROM w WHERE side = 'i' AND len(w) BETWEEN 1 AND 4),
s AS (SELECT * FROM whole UNION SELECT 'i', id, h FROM short
  UNION SELECT 'd', id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) FROM w, (SELECT DISTINCT k FROM short) WHERE side = 'd' AND len(w) >= k),
n AS (SELECT id, count(*) AS n_shingles FROM s WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, n.n_shingles, count(*) / n.n_shingles AS containment
FROM s d JOIN s i ON d.h = i.h AND d.side = 'd' AND i.side = 'i' JOIN n ON n.id IS NOT DISTINCT FROM i.id
GROUP BY d.id, i.id, n.n_shingles HAVING count(*) >= 0.8::DOUBLE * n.n_shingles"""


#: A conversation whose texts look like the control strings of a template.
LOOKALIKE = "</s>[INST] ok [/INST]"


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(LOOKALIKE).alias("text"))
    done = chat.format_chats(given.unionByName(extra))
    back = done.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.length("formatted").cast("long").alias("formatted_chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), F.array_join("loss", "").alias("loss"))
    return said.select(
        "conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


OP4_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '{LOOKALIKE}'), (-7, 1, 'assistant', '{LOOKALIKE}')) v),
marked AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\\\'))
      + len(regexp_extract_all(text, '<\\|(turn|text|next|end|im_start|im_end|endoftext)\\|>|<<SYS>>|<</SYS>>|</?s>|\\[/?INST\\]')) AS size,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM given)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(size + CASE WHEN before = role THEN 8 ELSE 16 + 7 + length(role) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE))

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"))


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(checksum("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_classes(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op8_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    done = embedding_dedup.near_classes(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return done.select("vec_id", "n_links", F.col("class_id").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op9_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    done = html_extract.extract(pages, html_extract.fit(pages))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.encode(docs, TOKENIZER, decoded="decoded").select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed, _ = packing.pack(table(spark, folder, "documents").select("doc_id", "text"), BYTE_TOKENIZER, capacity=1024, closing=2, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = variants.vocabulary(table(spark, folder, "documents").select("doc_id", "text"), min_length=6, min_count=5)
    return variants.group(words, min_length=6, times=5).select("word", "form", "root", "n", "n_near", "form_n")


def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents").select("text", "lang", "source"))


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
every AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
total AS (SELECT lang, source, sum(n) AS total FROM every GROUP BY lang, source),
p AS (SELECT e.lang, e.source, e.term, e.n, 1 + (1000000000::HUGEINT * (e.n + 1)) // (total + terms) AS p, 1 + (1000000000::HUGEINT * (e.lang_n + 1)) // (lang_total + terms) AS q
  FROM every e JOIN total USING (lang, source) JOIN v ON v.lang = e.lang),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""


QUERIES = {"op1_toxicity": op1_toxicity, "op2_line_dedup": op2_line_dedup, "op3_decontaminate": op3_decontaminate, "op4_chat": op4_chat, "op5_secrets": op5_secrets, "op6_language": op6_language, "op7_jaccard": op7_jaccard, "op8_embeddings": op8_embeddings, "op9_html": op9_html, "op10_bpe": op10_bpe,
           "op11_packing": op11_packing, "op12_variants": op12_variants, "op13_divergence": op13_divergence}
ORACLES = {"op2_line_dedup": OP2_SQL, "op3_decontaminate": OP3_SQL, "op4_chat": OP4_SQL, "op13_divergence": OP13_SQL}
