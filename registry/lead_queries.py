"""Queries over listings and leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from entiform import fixed, schemas
from entiform.functions import names, text
from entiform.operators import chains, dedup, emails, leads as L, lookups, merge, ordering, phones, records
from entiform.plans import lead_run
from registry.dialect import (
    KEYS, LEADS, RAW, blank_null, brand, brand_key, city, city_key, collapse, company_key, e164, first_email, lit,
    rounds, trim, unaccented_title_role, url, with_,
)
from registry.views import view

_SEGMENTS = ("AUTOMOBILE", " BUILDING ", "", "MACHINERY", "FURNITURE", "HOUSEHOLD")
_LEAD_COLS = (
    "ord", "id", "source", "source_url", "company_name", "category", "city", "country", "address", "latitude",
    "longitude", "phone_raw", "phone_normalized", "website_url", "google_rating", "reviews_count", "phone_valid")
_COLS = ", ".join(_LEAD_COLS)


def _places(spark, d):
    return view(spark, d, "places_v")


def _raw(spark, d):
    return L.parse_places(_places(spark, d))


def _leads(spark, d):
    return L.normalize_leads(_raw(spark, d))


def _full_raw(spark, d):
    """Raw leads with an email and up to two contacts that follow from the order number."""
    o = F.col("ord").cast("string")
    none = F.lit(None).cast("string")
    jean = F.struct(
        F.when(F.col("ord") % 19 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" Jean "), o)).alias("full_name"),
        none.alias("role"), F.lit("Directeur Général").alias("title_raw"),
        F.concat(F.lit("Mail Jean"), o, F.lit("@X.cm now")).alias("email_direct"),
        F.lit("6 99 00 00 00").alias("phone_direct"), F.concat(F.lit("www.linkedin.com/in/jean"), o).alias("linkedin_url"),
        F.when(F.col("ord") % 17 == 0, F.lit(1.5)).otherwise((F.col("ord") % 10) / F.lit(10.0)).alias("confidence"))
    awa = F.struct(
        F.concat(F.lit("Awa "), o).alias("full_name"), none.alias("role"), F.lit("Responsable Ventes").alias("title_raw"),
        none.alias("email_direct"), none.alias("phone_direct"), none.alias("linkedin_url"), F.lit(0.5).alias("confidence"))
    contacts = F.when(F.col("ord") % 3 == 0, F.array(jean, awa)).otherwise(F.array(jean))
    return _raw(spark, d).withColumns({
        "email": F.when(F.col("ord") % 4 == 0, F.concat(F.lit("Write to Info@Site"), o, F.lit(".CM please"))),
        "contacts": contacts.cast(f"array<{schemas.CONTACT}>"),
        "company_name": F.when(F.col("ord") % 23 == 0, F.lit(" ")).otherwise(F.col("company_name")),
    })


_FULL = f"""full_raw AS (SELECT * REPLACE (CASE WHEN ord % 23 = 0 THEN ' ' ELSE company_name END AS company_name), CASE WHEN ord % 4 = 0 THEN 'info@site' || ord || '.cm' END AS email,
 CASE WHEN ord % 19 = 0 THEN '' ELSE 'Jean ' || ord END AS jean, CASE WHEN ord % 17 = 0 THEN 1.5 ELSE (ord % 10) / 10.0 END AS conf FROM raw)"""
_FULL_LEADS = LEADS.replace("leads AS (SELECT ord,", "leads AS (SELECT email, jean, conf, ord,").replace("FROM raw)", "FROM full_raw)")
_REASONS = """reasoned AS (SELECT *, CASE WHEN company_name = '' THEN 'company_name,' ELSE '' END || CASE WHEN jean = '' THEN 'contact_name,' ELSE '' END
 || CASE WHEN conf > 1 THEN 'contact_confidence,' ELSE '' END AS why FROM leads)"""


def _full_leads(spark, d):
    return L.normalize_leads(_full_raw(spark, d))


def _valid(spark, d):
    return L.validate_leads(_full_leads(spark, d))[0]


def search_grid(spark, d):
    cities = _raw(spark, d).select(F.col("city").alias("location")).distinct()
    return L.search_grid(_SEGMENTS, cities, "cm", 20)


def city_refs(spark, d):
    return L.city_refs(view(spark, d, "city_specs_v"))


def validate_leads(spark, d):
    valid = _valid(spark, d)
    return valid.select("ord", "id", "email", F.size("contacts").cast("bigint").alias("n_contacts"))


def rejected_leads(spark, d):
    return L.validate_leads(_full_leads(spark, d))[1].select(
        "ord", F.concat(F.array_join("reject_reasons", ","), F.lit(",")).alias("why"))


def contacts_table(spark, d):
    return L.contacts_table(_valid(spark, d)).withColumn("pos", F.col("pos").cast("bigint"))


def eligible(spark, d):
    leads = _valid(spark, d)
    out = None
    for stage in fixed.STAGES:
        rows = L.eligible(leads, stage).select("ord", F.lit(stage).alias("stage"))
        out = rows if out is None else out.unionByName(rows)
    return out


def skip_done(spark, d):
    leads = _leads(spark, d).select("ord", "id")
    return lookups.skip_done(leads, leads.filter("ord % 3 = 0"))


def union_restored(spark, d):
    leads = _leads(spark, d).select("ord", "id")
    return lookups.union_restored(leads.filter("ord % 3 = 0"), leads).withColumn(
        "export_rank", F.col("export_rank").cast("bigint"))


def lookup_city(spark, d):
    return records.lookup_city(_raw(spark, d).select("ord", "city"))


def lookup_country(spark, d):
    return records.lookup_country(view(spark, d, "tasks_v").select("task_ord", "country"))


def match_brand(spark, d):
    return chains.match_brand(_leads(spark, d)).select("ord", "company_name", "known_brand")


def _brand_table(spark, d):
    """A phrase for each customer: a brand with its number, or the number alone."""
    return view(spark, d, "brands_v")


def match_brand_table(spark, d):
    return chains.match_brand(_leads(spark, d), _brand_table(spark, d)).select("ord", "company_name", "known_brand")


def standardize_phone_table(spark, d):
    done = phones.standardize_phones(view(spark, d, "dialled_v"), view(spark, d, "plans_v"))
    return done.select("ord", "phone_raw", "phone.e164", "phone.valid", F.col("phone.country").alias("phone_country"))


def detect_chains(spark, d):
    return chains.detect_chains(_leads(spark, d)).select(
        "ord", "company_name", "city", F.col("chain.is_chain").alias("is_chain"), F.col("chain.name").alias("chain_name"))


def flatten_leads(spark, d):
    return L.flatten_leads(chains.detect_chains(_valid(spark, d)))


def lead_stats(spark, d):
    raw = _full_raw(spark, d)
    valid, rejects = L.validate_leads(L.normalize_leads(raw))
    return L.lead_stats(raw, rejects, dedup.dedup_decisions(valid))


def enrichment_summary(spark, d):
    leads = chains.detect_chains(_leads(spark, d)).withColumns({
        "restored": F.col("ord") % 5 == 0,
        "enriched_by": F.when(F.col("ord") % 3 == 0, F.array(F.lit("email"))).otherwise(F.col("enriched_by"))})
    return L.enrichment_summary(leads)


def keep_per_key(spark, d):
    rows = _leads(spark, d).select("city", "ord", "company_name")
    first = ordering.keep_per_key(rows, "city").withColumn("keep", F.lit("first"))
    return first.unionByName(ordering.keep_per_key(rows, "city", keep="last").withColumn("keep", F.lit("last")))


def limit_per_search(spark, d):
    return ordering.limit_per_search(_raw(spark, d), 20).select("search_id", "ord")


def saturated_searches(spark, d):
    return ordering.saturated_searches(_raw(spark, d), cap=300)


def first_n(spark, d):
    return ordering.first_n(_raw(spark, d).select("ord", "company_name"), 25)


def distinct_first_seen(spark, d):
    return ordering.distinct_first_seen(_raw(spark, d), "search_id", "website_url", n=8)


def _patch(spark, d):
    o = F.col("ord").cast("string")
    none = F.lit(None).cast("string")
    contact = F.struct(
        F.concat(F.lit("JEAN "), o).alias("full_name"), F.lit("OWNER").alias("role"), F.lit("").alias("title_raw"),
        none.alias("email_direct"), F.lit("+237611111111").alias("phone_direct"), none.alias("linkedin_url"),
        F.lit(0.55).alias("confidence"))
    social = F.struct(*[(F.concat(F.lit("https://facebook.com/"), o) if n == "facebook" else none).alias(n)
                        for n in fixed.SOCIAL_FIELDS])
    return _valid(spark, d).filter("ord % 2 = 0").dropDuplicates(["ord"]).select(
        "ord",
        F.array(F.concat(F.lit(" a"), o, F.lit("@x.cm")), F.lit(""), F.concat(F.lit("a"), o, F.lit("@x.cm"))).alias("emails"),
        social.alias("socials"), F.array(contact).cast(f"array<{schemas.CONTACT}>").alias("contacts"),
        F.concat(F.lit("new"), o, F.lit("@x.cm")).alias("email"), F.lit("risky").alias("email_status"))


def _patched(spark, d):
    return merge.apply_patch(_valid(spark, d), _patch(spark, d), "website")


def apply_patch(spark, d):
    return _patched(spark, d).select(
        "ord", "email", "email_status", F.array_join("emails", ",").alias("emails"), F.col("socials.facebook").alias("facebook"),
        F.array_join("enriched_by", ",").alias("enriched_by"), F.size("contacts").cast("bigint").alias("n_contacts"))


def merge_contacts(spark, d):
    return _patched(spark, d).select("ord", F.posexplode("contacts").alias("pos", "c")).select(
        "ord", F.col("pos").cast("bigint").alias("pos"), "c.*")


def ordered_union(spark, d):
    rows = _raw(spark, d)
    joined = text.ordered_union(F.array("city", "website_url"), F.array(F.concat(F.lit(" "), F.col("city")), F.lit("")))
    return rows.select("ord", F.array_join(joined, "|").alias("joined"))


def dedup_entities(spark, d):
    return dedup.dedup_entities(_leads(spark, d)).select("ord", "id", "company_name", "city")


def dedup_decisions(spark, d):
    return dedup.dedup_decisions(_leads(spark, d))


def lead_delivery(spark, d):
    return lead_run.lead_delivery(_places(spark, d))


def name_keys(spark, d):
    name, place = F.col("name"), F.col("address")
    return _places(spark, d).select(
        "ord", names.company_key(name).alias("company_key"), names.brand_key(name).alias("brand_key"),
        names.slug(name, place).alias("slug"), names.hyphen_slug(name, place).alias("hyphen_slug"),
        names.slug_hash(name, place).alias("slug_hash"), names.plain_form(name).alias("plain_form"))


def infer_role(spark, d):
    titles = F.get(F.array(*[F.lit(t) for t in _TITLES]), F.col("ord") % len(_TITLES))
    rows = _places(spark, d).select("ord", titles.alias("title_raw"))
    return rows.withColumn("role", names.infer_role(F.col("title_raw")))


_TITLES = (
    "Directeur Général", "Propriétaire & Fondateur", "Réceptionniste", "G.M", "Head of Sales", "Chef de cuisine",
    "Gérante", "dg adjoint", "Directrice commerciale", "Overhead office")


def clean_place_fields(spark, d):
    from entiform.operators.leads import clean_place_fields as op

    rows = _places(spark, d).select(
        "ord", F.concat(F.lit("Adresse: "), "address").alias("address"),
        F.concat(F.lit("phone:tel:"), "phone").alias("phone"),
        F.array(F.lit("Modifier la page"), F.lit(""), F.repeat("category", F.when(F.col("ord") % 2 == 0, 9).otherwise(1)),
                "category").alias("category_candidates"))
    return op(rows)


def standardize_phone(spark, d):
    from entiform.functions.phone import standardize_phone as op

    return _places(spark, d).select("ord", op(F.col("phone"), F.lit("CM")).alias("p")).select("ord", "p.*")


QUERIES = {f.__name__: f for f in (
    search_grid, city_refs, validate_leads, rejected_leads, contacts_table, eligible, skip_done, union_restored, lookup_city,
    lookup_country, match_brand, match_brand_table, standardize_phone_table, detect_chains, flatten_leads, lead_stats, enrichment_summary, keep_per_key, limit_per_search,
    saturated_searches, first_n, distinct_first_seen, apply_patch, merge_contacts, ordered_union, dedup_entities,
    dedup_decisions, lead_delivery, name_keys, infer_role, clean_place_fields, standardize_phone)}
QUERIES["parse_places"] = lambda spark, d: _raw(spark, d)
QUERIES["normalize_leads"] = lambda spark, d: _leads(spark, d).select(*_LEAD_COLS)


_P = ("places_v",)
_VALID = f"valid AS (SELECT * FROM reasoned WHERE why = '')"
_CHAINS = f"""brands AS (SELECT {brand_key('company_name')} AS bk, min(coalesce(nullif({city_key('city')}, ''), id)) AS lo,
 max(coalesce(nullif({city_key('city')}, ''), id)) AS hi, arg_min({trim('company_name')}, ord) AS label FROM {{leads}}
 WHERE {brand_key('company_name')} <> '' GROUP BY 1),
chained AS (SELECT l.*, coalesce({brand('l.company_name')}, b.label) AS chain_name FROM {{leads}} l
 LEFT JOIN brands b ON b.lo <> b.hi AND b.bk = {brand_key('l.company_name')})"""


def _num(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


def _flat(contact: bool, table: str) -> str:
    """The 28 delivery columns of a leads table with chain_name."""
    jean = "coalesce(conf >= 0.5 OR ord % 3 <> 0, FALSE)"
    person = (
        [f"CASE WHEN {jean} THEN jean ELSE 'Awa ' || ord END", f"CASE WHEN {jean} THEN 'GENERAL_MANAGER' ELSE 'DIRECTOR' END",
         f"CASE WHEN {jean} THEN 'jean' || ord || '@x.cm' ELSE '' END",
         f"CASE WHEN {jean} THEN 'https://www.linkedin.com/in/jean' || ord ELSE '' END"]
        if contact else ["''"] * 4)
    special = {
        "legal_name": "''", "chain": "coalesce(chain_name, '')", "phones": "''", "emails": "''", "email_status": "''",
        "email": "coalesce(email, '')" if contact else "''", "linkedin": "''", "facebook": "''", "instagram": "''",
        "whatsapp": "''", "google_rating": f"coalesce({_num('google_rating')}, '')",
        "reviews_count": "coalesce(CAST(reviews_count AS VARCHAR), '')", "reviews_sentiment": "''", "reviews_summary": "''",
        **dict(zip(("contact_name", "contact_role", "contact_email", "contact_linkedin"), person))}
    return "SELECT " + ", ".join(
        f"{special.get(k, f'coalesce({k}, {chr(39)*2})')} AS {k}" for k, _ in fixed.FLAT_COLUMNS) + f" FROM {table}"


_FORM = "regexp_replace(lower(strip_accents(name)), '\\b(" + "|".join(fixed.FORM_WORDS) .replace("'", "''") + ")\\b', '', 'g')"
_HYPHEN = f"regexp_replace(lower(strip_accents(address)), '[^a-z0-9]', '', 'g') || '-' || trim(regexp_replace({_FORM}, '[^a-z0-9]+', '-', 'g'), '-')"

from registry.dialect import CM_VALID, slug  # noqa: E402

ORACLES = {
    "search_grid": with_(RAW, views=_P) + "SELECT q AS query, location, 'CM' AS country, CAST(20 AS BIGINT) AS \"limit\" FROM "
    "(SELECT DISTINCT city AS location FROM raw), (VALUES ('AUTOMOBILE'), ('BUILDING'), ('MACHINERY'), ('FURNITURE'), ('HOUSEHOLD')) AS t(q)",
    "city_refs": with_(views=("city_specs_v",)) +
    "SELECT ord, trim(split_part(spec, ':', 1)) AS city, coalesce(nullif(trim(split_part(spec, ':', 2)), ''), 'Cameroun') AS country FROM city_specs_v",
    "parse_places": with_(RAW, views=_P) + "SELECT * FROM raw",
    "normalize_leads": with_(RAW, LEADS, views=_P) + f"SELECT {_COLS} FROM leads",
    "validate_leads": with_(RAW, _FULL, _FULL_LEADS, _REASONS, _VALID, views=_P) +
    "SELECT ord, id, email, CAST(CASE WHEN ord % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_contacts FROM valid",
    "rejected_leads": with_(RAW, _FULL, _FULL_LEADS, _REASONS, views=_P) + "SELECT ord, why FROM reasoned WHERE why <> ''",
    "contacts_table": with_(RAW, _FULL, _FULL_LEADS, _REASONS, _VALID, views=_P) +
    "SELECT company_name AS company, city, id, CAST(0 AS BIGINT) AS pos, jean AS full_name, 'GENERAL_MANAGER' AS role, 'Directeur Général' AS title_raw, "
    "'jean' || ord || '@x.cm' AS email_direct, '+237699000000' AS phone_direct, 'https://www.linkedin.com/in/jean' || ord AS linkedin_url, CAST(conf AS DOUBLE) AS confidence FROM valid "
    "UNION ALL SELECT company_name, city, id, 1, 'Awa ' || ord, 'DIRECTOR', 'Responsable Ventes', NULL, NULL, NULL, 0.5 FROM valid WHERE ord % 3 = 0",
    "eligible": with_(RAW, _FULL, _FULL_LEADS, _REASONS, _VALID, views=_P) +
    "SELECT ord, 'website' AS stage FROM valid WHERE website_url IS NOT NULL UNION ALL SELECT ord, 'email' FROM valid "
    "UNION ALL SELECT ord, 'reviews' FROM valid WHERE contains(source_url, 'google.com/maps/place/')",
    "skip_done": with_(RAW, LEADS, views=_P) + "SELECT ord, id FROM leads WHERE id NOT IN (SELECT id FROM leads WHERE ord % 3 = 0)",
    "union_restored": with_(RAW, LEADS, views=_P) + "SELECT ord, id, CAST(0 AS BIGINT) AS export_rank FROM leads WHERE ord % 3 = 0 UNION ALL "
    "SELECT ord, id, 1 FROM leads WHERE id NOT IN (SELECT id FROM leads WHERE ord % 3 = 0)",
    "lookup_city": with_(RAW, views=_P) + f"SELECT ord, city, {city('city')} AS city_name, {city_key('city')} AS city_key FROM raw",
    "lookup_country": with_(views=("tasks_v",)) + "SELECT task_ord, country, CASE country WHEN 'Cameroun' THEN 'CM' ELSE 'CI' END AS iso2, "
    "CASE country WHEN 'Cameroun' THEN '237' ELSE '225' END AS calling_code FROM tasks_v",
    "match_brand": with_(RAW, LEADS, views=_P) + f"SELECT ord, company_name, {brand('company_name')} AS known_brand FROM leads",
    "standardize_phone_table": with_(
        """given AS (SELECT d.*, regexp_replace(phone_raw, '[^+0-9]', '', 'g') AS c, h.idd FROM dialled_v d LEFT JOIN plans_v h ON h.iso2 = d.country_iso)""",
        """numbered AS (SELECT *, CASE WHEN regexp_matches(c, '^(' || idd || ')[1-9][0-9]*$') THEN '+' || substr(c, length(idd) + 1) ELSE c END AS num FROM given)""",
        """coded AS (SELECT n.*, num LIKE '+%' AS abroad, (SELECT arg_max(p.iso2, length(p.calling_code)) FROM plans_v p WHERE starts_with(n.num, '+' || p.calling_code)) AS met FROM numbered n)""",
        """located AS (SELECT x.ord, x.phone_raw, x.num, x.abroad, p.iso2, p.calling_code, p.trunk, p.nsn AS rule,
 CASE WHEN abroad THEN substr(num, length(coalesce(p.calling_code, '')) + 2) ELSE num END AS n FROM coded x LEFT JOIN plans_v p ON p.iso2 = CASE WHEN abroad THEN met ELSE country_iso END)""",
        """forms AS (SELECT *, CASE WHEN trunk <> '' AND starts_with(n, trunk) THEN nullif(substr(n, length(trunk) + 1), '') END AS short,
 CASE WHEN NOT abroad AND starts_with(n, calling_code) THEN nullif(substr(n, length(calling_code) + 1), '') END AS bare FROM located)""",
        """judged AS (SELECT *, coalesce(regexp_full_match(n, rule), false) AS n_ok, coalesce(regexp_full_match(short, rule), false) AS short_ok, coalesce(regexp_full_match(bare, rule), false) AS bare_ok FROM forms)""",
        """picked AS (SELECT *, CASE WHEN NOT n_ok AND bare_ok THEN bare WHEN short IS NOT NULL AND (short_ok OR NOT n_ok) THEN short ELSE n END AS body,
 CASE WHEN NOT n_ok AND bare_ok THEN true WHEN short IS NOT NULL AND (short_ok OR NOT n_ok) THEN short_ok ELSE n_ok END AS ok FROM judged)""",
        views=("dialled_v", "plans_v")) + """
SELECT ord, phone_raw, CASE WHEN iso2 IS NOT NULL AND length(body) BETWEEN 2 AND 17 THEN '+' || calling_code || body WHEN iso2 IS NULL AND abroad AND length(num) BETWEEN 4 AND 18 THEN num END AS e164,
 coalesce(iso2 IS NOT NULL AND length(body) BETWEEN 2 AND 17 AND ok, false) AS valid, CASE WHEN length(body) BETWEEN 2 AND 17 THEN iso2 END AS phone_country FROM picked""",
    "match_brand_table": with_(RAW, LEADS, views=("places_v", "brands_v")) + """
SELECT ord, company_name, (SELECT arg_min(b.name, (b.prio, b.name)) FROM brands_v b
  WHERE contains(' ' || regexp_replace(lower(l.company_name), '[^a-z0-9_]', ' ', 'g') || ' ', ' ' || lower(b.phrase) || ' ')) AS known_brand FROM leads l""",
    "detect_chains": with_(RAW, LEADS, _CHAINS.format(leads="leads"), views=_P) +
    "SELECT ord, company_name, city, chain_name IS NOT NULL AS is_chain, chain_name FROM chained",
    "flatten_leads": with_(RAW, _FULL, _FULL_LEADS, _REASONS, _VALID, _CHAINS.format(leads="valid"), views=_P) + _flat(True, "chained"),
    "lead_stats": with_(RAW, _FULL, _FULL_LEADS.replace("leads AS (", "every AS (", 1), _REASONS.replace("FROM leads", "FROM every"),
                        "leads AS (SELECT * FROM reasoned WHERE why = '')", KEYS, *rounds(), views=_P) +
    "SELECT (SELECT count(*) FROM raw) AS received, (SELECT count(*) FROM reasoned WHERE why <> '') AS invalid, "
    "(SELECT count(*) FROM keys) - (SELECT count(*) FROM accepted) AS duplicates, (SELECT count(*) FROM accepted) AS accepted",
    "enrichment_summary": with_(RAW, LEADS, _CHAINS.format(leads="leads"), views=_P) +
    "SELECT count(*) FILTER (ord % 3 = 0 AND ord % 5 <> 0) AS leads_enriched, count(chain_name) AS chains_detected, count(*) FILTER (ord % 5 = 0) AS resumed FROM chained",
    "keep_per_key": with_(RAW, LEADS, views=_P) +
    "SELECT city, min(ord) AS ord, arg_min(company_name, ord) AS company_name, 'first' AS keep FROM leads GROUP BY city UNION ALL "
    "SELECT city, max(ord), arg_max(company_name, ord), 'last' FROM leads GROUP BY city",
    "limit_per_search": with_(views=_P) + "SELECT search_id, ord FROM places_v QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY ord) <= 20",
    "saturated_searches": with_(views=_P) + "SELECT search_id, count(*) AS rows_found FROM places_v GROUP BY search_id HAVING count(*) >= 300",
    "first_n": with_(RAW, views=_P) + "SELECT ord, company_name FROM raw ORDER BY ord LIMIT 25",
    "distinct_first_seen": with_(RAW, views=_P) + "SELECT * FROM (SELECT search_id, website_url, min(ord) AS first_ord FROM raw GROUP BY ALL) "
    "QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY first_ord) <= 8",
    "apply_patch": with_(RAW, _FULL, _FULL_LEADS, _REASONS, _VALID, views=_P) +
    "SELECT ord, coalesce(email, CASE WHEN ord % 2 = 0 THEN 'new' || ord || '@x.cm' END) AS email, CASE WHEN ord % 2 = 0 THEN 'risky' END AS email_status, "
    "CASE WHEN ord % 2 = 0 THEN 'a' || ord || '@x.cm' ELSE '' END AS emails, CASE WHEN ord % 2 = 0 THEN 'https://facebook.com/' || ord END AS facebook, "
    "CASE WHEN ord % 2 = 0 THEN 'website' ELSE '' END AS enriched_by, CAST(CASE WHEN ord % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_contacts FROM valid",
    "merge_contacts": with_(RAW, _FULL, _FULL_LEADS, _REASONS, _VALID, views=_P) +
    "SELECT ord, CAST(0 AS BIGINT) AS pos, CASE WHEN ord % 2 = 0 THEN 'JEAN ' || ord ELSE jean END AS full_name, CASE WHEN ord % 2 = 0 THEN 'OWNER' ELSE 'GENERAL_MANAGER' END AS role, "
    "'Directeur Général' AS title_raw, 'jean' || ord || '@x.cm' AS email_direct, CASE WHEN ord % 2 = 0 THEN '+237611111111' ELSE '+237699000000' END AS phone_direct, "
    "'https://www.linkedin.com/in/jean' || ord AS linkedin_url, CAST(CASE WHEN ord % 2 = 0 THEN greatest(conf, 0.55) ELSE conf END AS DOUBLE) AS confidence FROM valid "
    "UNION ALL SELECT ord, 1, 'Awa ' || ord, 'DIRECTOR', 'Responsable Ventes', NULL, NULL, NULL, 0.5 FROM valid WHERE ord % 3 = 0",
    "ordered_union": with_(RAW, views=_P) + f"SELECT ord, concat_ws('|', {trim('city')}, {trim('website_url')}) AS joined FROM raw",
    "dedup_entities": with_(RAW, LEADS, KEYS, *rounds(), views=_P) +
    "SELECT ord, id, company_name, city FROM leads SEMI JOIN accepted USING (ord)",
    "dedup_decisions": with_(RAW, LEADS, KEYS, *rounds(), views=_P) +
    "SELECT ord, id, coalesce(h1, FALSE) OR coalesce(h2, FALSE) OR coalesce(h3, FALSE) AS duplicate, "
    "CASE WHEN h1 THEN 'name+city' WHEN h2 THEN 'phone' WHEN h3 THEN 'website' END AS reason, "
    "CASE WHEN h1 THEN i1 WHEN h2 THEN i2 WHEN h3 THEN i3 END AS matched_id FROM decisions",
    "lead_delivery": with_(RAW, LEADS, KEYS, *rounds(), "kept AS MATERIALIZED (SELECT * FROM leads SEMI JOIN accepted USING (ord))",
                           _CHAINS.format(leads="kept"), views=_P) + _flat(False, "chained"),
    "name_keys": with_(views=_P) + f"SELECT ord, {company_key('name')} AS company_key, {brand_key('name')} AS brand_key, {slug('name', 'address')} AS slug, "
    f"{_HYPHEN} AS hyphen_slug, substr(sha256({_HYPHEN}), 1, 12) AS slug_hash, regexp_replace({_FORM}, '[^a-z0-9]', '', 'g') AS plain_form FROM places_v",
    "infer_role": with_("titles AS (SELECT ord, [" + ", ".join(lit(t) for t in _TITLES) + f"][ord % {len(_TITLES)} + 1] AS title_raw FROM places_v)", views=_P)
    + f"SELECT ord, title_raw, {unaccented_title_role('title_raw')} AS role FROM titles",
    "clean_place_fields": with_(views=_P) + "SELECT ord, address, phone, CASE WHEN ord % 2 = 0 AND length(category) * 9 <= 40 THEN repeat(category, 9) ELSE category END AS category FROM places_v",
    "standardize_phone": with_("p AS (SELECT ord, " + e164('phone', lit('237')) + " AS e164 FROM places_v)", views=_P) +
    f"SELECT ord, e164, coalesce(regexp_full_match(e164, {lit(CM_VALID)}), FALSE) AS valid, CASE WHEN e164 IS NOT NULL THEN 'CM' END AS country FROM p",
}
