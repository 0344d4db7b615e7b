"""Queries over researched records and name similarity, and the streaming intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from entiform.functions.storage import Scratch
from entiform.operators import answers, ordering, records, similarity
from entiform.plans import record_run
from registry.dialect import KEYS, LEADS, RAW, alnum, clean, e164, fold, lit, rounds, slug, trim, url, with_, words
from registry.views import view


def _tasks(spark, d):
    return view(spark, d, "tasks_v")


def _answered(spark, d):
    found = view(spark, d, "answers_v").select("task_ord", "answer", F.array("source").alias("sources"))
    return _tasks(spark, d).join(found, "task_ord")


def _parsed(spark, d):
    return answers.parse_record_answers(_answered(spark, d))[0]


def _records(spark, d):
    return records.to_records(_parsed(spark, d), "m1")


def parse_record_answers(spark, d):
    return _parsed(spark, d).select(
        "task_ord", "parsed.owner", "parsed.management", "parsed.phone", "parsed.email", "parsed.website", "parsed.governance_confidence")


def rejected_answers(spark, d):
    return answers.parse_record_answers(_answered(spark, d))[1].select("task_ord", "answer")


def to_records(spark, d):
    return _records(spark, d).withColumn("sources", F.array_join("sources", ",")).drop("enriched_at")


def delivery_view(spark, d):
    return records.delivery_view(_records(spark, d))


def dedup_by_slug(spark, d):
    rows = _records(spark, d).select("slug", "task_ord", "input_name")
    first = ordering.dedup_by_slug(rows).withColumn("mode", F.lit("first"))
    return first.unionByName(ordering.dedup_by_slug(rows, force=True).withColumn("mode", F.lit("force")))


def _stored(spark, d):
    rows = ordering.dedup_by_slug(_records(spark, d).filter("task_ord % 3 = 0"))
    return rows.drop("task_ord").withColumn("model", F.lit("m0"))


def upsert_by_key(spark, d):
    new = ordering.dedup_by_slug(_records(spark, d).filter("task_ord % 3 <> 0 OR task_ord % 2 = 0"), force=True)
    return records.upsert_by_key(_stored(spark, d), new.drop("task_ord")).select("slug", "input_name", "model", "outcome")


def match_existing(spark, d):
    return records.match_existing(_records(spark, d), _stored(spark, d)).select("task_ord", "slug", "outcome")


def run_summary(spark, d):
    found = _answered(spark, d).select("task_ord", "answer", "sources")
    return records.run_summary(record_run.task_outcomes(_tasks(spark, d), found, _stored(spark, d)))


def similar_names(spark, d):
    return similarity.similar_names(_tasks(spark, d))


def fuzzy_name_pairs(spark, d):
    return similarity.fuzzy_name_pairs(_tasks(spark, d))


def discovered_names(spark, d):
    out = answers.discovered_names(view(spark, d, "discovered_v"))
    return out.withColumn("first_pos", F.col("first_pos").cast("bigint"))


def _stream(spark, d):
    """The listings as ordered files, one micro-batch per file, through the streaming intake."""
    from entiform.streaming.leads import LeadIntake, stream_leads

    scratch = Scratch(spark, "stream")
    places = view(spark, d, "places_v")
    # growing order: each file holds a later range of the order column
    step = places.agg(F.max("ord")).first()[0] / 4
    ranged = places.withColumn("part", F.least(F.lit(3), F.floor(F.col("ord") / F.lit(step)).cast("int")))
    for i in range(4):
        ranged.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{scratch.path}/in")
    source = spark.readStream.schema(places.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch.path}/in")
    intake = LeadIntake(f"{scratch.path}/out")
    intake.start(stream_leads(source)).awaitTermination()
    return intake


def stream_dedup(spark, d):
    return _stream(spark, d).read(spark, "leads").select("ord", "id", "company_name", "city")


def stream_stats(spark, d):
    return _stream(spark, d).stats(spark)


QUERIES = {f.__name__: f for f in (
    parse_record_answers, rejected_answers, to_records, delivery_view, dedup_by_slug, upsert_by_key, match_existing,
    run_summary, similar_names, fuzzy_name_pairs, discovered_names, stream_dedup, stream_stats)}

# --- SQL ------------------------------------------------------------------------------------------------

_TASKS = ("tasks_v", "answers_v")
_JSON = r"regexp_extract(answer, '(?s)\{.*\}')"


def _field(name: str) -> str:
    return f"json_extract_string({_JSON}, '$.{name}')"


_PARSED = f"""parsed AS (SELECT t.*, source, {', '.join(f'{_field(n)} AS {n}' for n in ('owner', 'management', 'phone', 'email', 'website'))},
 CAST({_field('governance_confidence')} AS DOUBLE) AS own FROM tasks_v t JOIN answers_v a USING (task_ord)
 WHERE {_JSON} <> '' AND coalesce(CAST({_field('governance_confidence')} AS DOUBLE), 0) BETWEEN 0 AND 1)"""
_CODE = "CASE country WHEN 'Cameroun' THEN '237' ELSE '225' END"
_RECORDS = f"""scored AS (SELECT *, {clean('owner')} AS o, {clean('management')} AS m,
 coalesce(own, CASE WHEN {clean('owner')} IS NOT NULL OR {clean('management')} IS NOT NULL THEN 0.4 ELSE 0 END) AS conf FROM parsed),
records AS (SELECT task_ord, {slug('input_name', 'city')} AS slug, input_name, input_name AS name, city, country, NULL AS category, {clean('phone')} AS phone,
 {e164('phone', _CODE)} AS phone_e164, lower({clean('email')}) AS email, regexp_replace({url('website')}, '/$', '') AS website, NULL AS district, NULL AS address,
 CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude, o AS owner, m AS management, CAST(conf AS DOUBLE) AS governance_confidence,
 CASE WHEN source LIKE 'https://%' THEN source ELSE '' END AS sources,
 CASE WHEN (o IS NULL AND m IS NULL) OR conf < 0.6 THEN 'needs_review' ELSE 'auto' END AS status, 'm1' AS model FROM scored)"""
_STORED = "stored AS (SELECT slug, arg_min(input_name, task_ord) AS input_name, arg_min(status, task_ord) AS status FROM records WHERE task_ord % 3 = 0 GROUP BY slug)"
_TOKENS = f"array_to_string(list_sort(list_distinct({words('input_name')})), ' ')"
_FORM = "regexp_replace(regexp_replace(lower(strip_accents(input_name)), '\\b(hotel|l''hotel|les|residence|residences|spa|complex|sa|sarl|luxury)\\b', '', 'g'), '[^a-z0-9]', '', 'g')"


def _forms(expr: str, keep: str) -> str:
    return f"""forms AS MATERIALIZED (SELECT {alnum(fold('city'))} AS city_key, {expr} AS form, count(*) AS n, min(task_ord) AS first FROM tasks_v GROUP BY 1, 2 HAVING {keep}),
pairs AS (SELECT a.city_key, a.form AS form_a, b.form AS form_b, a.n AS n_a, b.n AS n_b, a.first AS first_a, b.first AS first_b FROM forms a JOIN forms b USING (city_key)
 WHERE (a.form = b.form AND a.n > 1) OR (a.form <> b.form))"""


ORACLES = {
    "parse_record_answers": with_(_PARSED, views=_TASKS) + "SELECT task_ord, owner, management, phone, email, website, own AS governance_confidence FROM parsed",
    "rejected_answers": with_(_PARSED, views=_TASKS) + "SELECT task_ord, answer FROM answers_v ANTI JOIN parsed USING (task_ord)",
    "to_records": with_(_PARSED, _RECORDS, views=_TASKS) + "SELECT * FROM records",
    "delivery_view": with_(_PARSED, _RECORDS, views=_TASKS) +
    "SELECT name, city, category, coalesce(phone_e164, phone) AS phone, coalesce(owner, 'Non identifié') AS owner, coalesce(management, 'Non identifié') AS management, "
    "round(governance_confidence, 2) AS confidence, district, CAST(NULL AS VARCHAR) AS geo, address, email, website, nullif(sources, '') AS sources, "
    "CASE status WHEN 'auto' THEN 'Auto' ELSE 'À vérifier' END AS status, slug FROM records",
    "dedup_by_slug": with_(_PARSED, _RECORDS, views=_TASKS) + "SELECT slug, min(task_ord) AS task_ord, arg_min(input_name, task_ord) AS input_name, 'first' AS mode FROM records GROUP BY slug "
    "UNION ALL SELECT slug, max(task_ord), arg_max(input_name, task_ord), 'force' FROM records GROUP BY slug",
    "upsert_by_key": with_(_PARSED, _RECORDS, _STORED, "fresh AS (SELECT slug, arg_max(input_name, task_ord) AS input_name FROM records WHERE task_ord % 3 <> 0 OR task_ord % 2 = 0 GROUP BY slug)", views=_TASKS) +
    "SELECT slug, coalesce(f.input_name, s.input_name) AS input_name, CASE WHEN f.slug IS NULL THEN 'm0' ELSE 'm1' END AS model, "
    "CASE WHEN f.slug IS NULL THEN 'kept' WHEN s.slug IS NULL THEN 'created' ELSE 'updated' END AS outcome FROM stored s FULL JOIN fresh f USING (slug)",
    "match_existing": with_(_PARSED, _RECORDS, _STORED, views=_TASKS) + "SELECT task_ord, slug, CASE WHEN slug IN (SELECT slug FROM stored) THEN 'updated' ELSE 'created' END AS outcome FROM records",
    "run_summary": with_(_PARSED, _RECORDS, _STORED, f"""slugged AS (SELECT task_ord, {slug('input_name', 'city')} AS slug FROM tasks_v),
tried AS (SELECT s.task_ord, s.slug, r.status, r.task_ord IS NOT NULL AS good, s.slug IN (SELECT slug FROM stored) AS known FROM slugged s LEFT JOIN records r USING (task_ord)),
told AS (SELECT *, (SELECT count(*) FROM tried p WHERE p.slug = t.slug AND p.good AND p.task_ord < t.task_ord) AS before FROM tried t)""", views=_TASKS) +
    "SELECT count(*) AS total, count(*) FILTER (good AND NOT known AND before = 0) AS enriched, count(*) FILTER (known OR before > 0) AS skipped, "
    "count(*) FILTER (NOT good AND NOT known AND before = 0) AS failed, count(*) FILTER (good AND NOT known AND before = 0 AND status = 'needs_review') AS needs_review, "
    "count(*) FILTER (good AND NOT known AND before = 0) AS created, CAST(0 AS BIGINT) AS updated FROM told",
    "similar_names": with_(_forms(_TOKENS, "form <> ''"), """sized AS (SELECT *, len(string_split(form_a, ' ')) AS sa, len(string_split(form_b, ' ')) AS sb,
 len(list_intersect(string_split(form_a, ' '), string_split(form_b, ' '))) AS i FROM pairs),
scored AS (SELECT *, CASE WHEN i = sa OR i = sb THEN 0.95 ELSE i / (sa + sb - i) END AS similarity FROM sized WHERE (sa, form_a) <= (sb, form_b))""", views=("tasks_v",)) +
    "SELECT city_key, form_a, form_b, n_a, n_b, first_a, first_b, CAST(similarity AS DOUBLE) AS similarity FROM scored WHERE similarity >= 0.6",
    "fuzzy_name_pairs": with_(_forms(_FORM, "TRUE"), """scored AS (SELECT *, CASE WHEN form_a = form_b OR (form_a <> '' AND contains(form_b, form_a)) THEN 1.0
 ELSE 1 - levenshtein(form_a, form_b) / length(form_b) END AS similarity FROM pairs WHERE (length(form_a), form_a) <= (length(form_b), form_b))""", views=("tasks_v",)) +
    "SELECT city_key, form_a, form_b, n_a, n_b, first_a, first_b, CAST(similarity AS DOUBLE) AS similarity FROM scored WHERE similarity >= 0.82 - 1e-9",
    "discovered_names": with_("""listed AS (SELECT city, ord, 'Hotel ' || (ord % 7) AS name, 0 AS p FROM discovered_v UNION ALL SELECT city, ord, 'Inn ' || (ord % 5), 1 FROM discovered_v),
firsts AS (SELECT city, name, min(ord * 10 + p) AS seen FROM listed GROUP BY 1, 2)""".replace("discovered_v", "(SELECT d.city, d.ord FROM discovered_v d)"), views=("discovered_v",)) +
    "SELECT city, name, seen // 10 AS first_ord, seen % 10 AS first_pos FROM firsts",
    "stream_dedup": with_(RAW, LEADS, KEYS, *rounds(), views=("places_v",)) + "SELECT ord, id, company_name, city FROM leads SEMI JOIN accepted USING (ord)",
    "stream_stats": with_(RAW, LEADS, KEYS, *rounds(), views=("places_v",)) +
    "SELECT (SELECT count(*) FROM leads) AS received, CAST(0 AS BIGINT) AS invalid, (SELECT count(*) FROM leads) - (SELECT count(*) FROM accepted) AS duplicates, (SELECT count(*) FROM accepted) AS accepted",
}
