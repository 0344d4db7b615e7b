"""Queries over pages, documents, reviews and emails."""

from __future__ import annotations

from pyspark.sql import functions as F

from entiform import fixed, schemas
from entiform.functions import web
from entiform.functions.text import BLANKS
from entiform.operators import answers, emails, extract, ordering, results, reviews
from entiform.operators.leads import normalize_leads
from registry.dialect import collapse, lit, trim, with_
from registry.views import table, view


def extract_emails(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("html").alias("text"))
    docs = table(spark, d, "documents").select((-F.col("doc_id") - 1).alias("page_id"), "text")
    return extract.extract_emails(docs.unionByName(pages), "text").withColumn("pos", F.col("pos").cast("bigint"))


def _document_emails(spark, d):
    docs = table(spark, d, "documents")
    return extract.extract_emails(docs, "text", "doc_id")


def relevant_emails(spark, d):
    found = _document_emails(spark, d).withColumn("host", F.concat(F.lit("www.mail"), (F.col("doc_id") % 10).cast("string"), F.lit(".example.com")))
    return extract.relevant_emails(found).select("doc_id", "email")


def _domain_facts(spark, d):
    return view(spark, d, "domain_facts_v").select("domain", "has_mx", "catch_all", (F.col("k") % 5 != 0).alias("probed"))


def _address_facts(spark, d):
    found = _document_emails(spark, d).select("email").distinct()
    return found.filter(F.length("email") % 3 != 0).select("email", (F.length("email") % 2 == 0).alias("accepted"))


def attach_email_facts(spark, d):
    found = _document_emails(spark, d).select("doc_id", "email")
    return emails.attach_email_facts(found, _domain_facts(spark, d), _address_facts(spark, d))


def email_status(spark, d):
    found = _document_emails(spark, d)
    return emails.address_statuses(found, _domain_facts(spark, d), _address_facts(spark, d)).drop("uses")


def email_verdicts(spark, d):
    """Every tenth document is a lead that holds the addresses of its ten documents."""
    grouped = _document_emails(spark, d).groupBy(F.floor(F.col("doc_id") / 10).alias("g")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "pos", "email")))["email"].alias("emails"))
    leads = grouped.select(
        F.col("g").alias("ord"), F.col("g").cast("string").alias("id"), F.when(F.col("g") % 3 == 0, F.element_at("emails", -1)).alias("email"),
        F.array_distinct("emails").alias("emails"), F.array().cast(f"array<{schemas.CONTACT}>").alias("contacts"))
    out = emails.email_verdicts(leads, _domain_facts(spark, d), _address_facts(spark, d))
    return out.select("id", "email_status", "email_catch_all", F.size(F.map_keys("email_checks")).cast("bigint").alias("n_checked"))


def extract_phones(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return extract.extract_phones(docs, "US", "text", "doc_id").select("doc_id", "e164")


def visible_text(spark, d):
    return extract.visible_text(table(spark, d, "pages"))


def page_links(spark, d):
    return extract.page_links(table(spark, d, "pages")).withColumn("pos", F.col("pos").cast("bigint"))


def page_budget(spark, d):
    from pyspark.sql import Window

    pages = table(spark, d, "pages").select("page_id", web.url_host(F.col("url")).alias("site"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("page_id")) - 1
    ranked = pages.withColumns({"path_rank": rank, "ok": F.col("page_id") % 5 != 0})
    return ordering.page_budget(ranked).select("site", "page_id", F.col("path_rank").cast("bigint").alias("path_rank"))


def _site_leads(spark, d):
    places = view(spark, d, "places_v")
    site = F.concat(F.lit("www.site"), (F.col("ord") - F.col("ord") % 5).cast("string"), F.lit(".cm"))
    raw = places.select(
        "ord", F.lit("t").alias("source"), F.col("name").alias("company_name"),
        F.when(F.col("ord") % 4 != 3, F.regexp_replace(site, "^www[.]", "")).alias("website_url"))
    return normalize_leads(raw)


def pages_for_leads(spark, d):
    visited = extract.site_pages(view(spark, d, "site_pages_v"))
    return extract.pages_for_leads(_site_leads(spark, d), visited).drop("id")


def enrich_from_pages(spark, d):
    patch = extract.enrich_from_pages(_site_leads(spark, d), view(spark, d, "site_pages_v"))
    return patch.select(
        "ord", "email", "legal_name", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"),
        "socials.facebook", "socials.linkedin", "socials.whatsapp",
        F.array_join(F.transform("contacts", lambda c: F.concat_ws("/", c["full_name"], c["role"], c["email_direct"])), ",").alias("people"))


def site_contacts(spark, d):
    rows = view(spark, d, "site_pages_v").filter("html IS NOT NULL").select("page_id", web.body_text(F.col("html")).alias("text"))
    known = F.array(F.struct(*[
        (F.lit("JEAN-PIERRE MBARGA") if n == "full_name" else F.lit(1.0) if n == "confidence" else F.lit(None).cast("string")).alias(n)
        for n in ("full_name", "role", "title_raw", "email_direct", "phone_direct", "linkedin_url", "confidence")]))
    found = extract.site_contacts(known.cast(f"array<{schemas.CONTACT}>"), web.people_in(F.col("text")), F.array(
        F.lit("info@x.cm"), F.concat(F.lit("antsama@x"), F.col("page_id").cast("string"), F.lit(".cm"))))
    return rows.select("page_id", F.posexplode(found).alias("pos", "c")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "c.full_name", "c.role", "c.email_direct", "c.confidence")


def extract_socials(spark, d):
    pages = view(spark, d, "site_pages_v").filter("html IS NOT NULL").select(
        "page_id", web.raw_hrefs(F.col("html")).alias("links"))
    return extract.extract_socials(pages)


def extract_legal_names(spark, d):
    pages = view(spark, d, "site_pages_v").filter("html IS NOT NULL").select(
        web.url_host(F.col("url")).alias("site"), (F.col("page_id") % 4).alias("path_rank"), web.body_text(F.col("html")).alias("text"))
    return extract.extract_legal_names(pages)


def extract_people(spark, d):
    pages = view(spark, d, "site_pages_v").filter("html IS NOT NULL").select("page_id", web.body_text(F.col("html")).alias("text"))
    return extract.extract_people(pages).withColumn("pos", F.col("pos").cast("bigint"))


def extract_site_phones(spark, d):
    pages = view(spark, d, "site_pages_v").filter("html IS NOT NULL").select(
        "page_id", web.body_text(F.col("html")).alias("text"), web.raw_hrefs(F.col("html")).alias("links"))
    return extract.extract_phones(pages, links="links").withColumn("pos", F.col("pos").cast("bigint"))


def review_corpus(spark, d):
    return reviews.review_corpus(view(spark, d, "reviews_v"))


def top_n_per_group(spark, d):
    rows = view(spark, d, "reviews_v").select("lead_id", "pos", F.length("text").cast("bigint").alias("n"))
    return ordering.top_n_per_group(rows, "lead_id", [F.desc("n"), F.col("pos")], 3)


def _review_leads(spark, d):
    return view(spark, d, "reviews_v").select("lead_id").distinct().select(
        F.col("lead_id").alias("ord"), F.col("lead_id").alias("id"), F.when(F.col("lead_id") % 2 == 0, F.col("lead_id")).alias("reviews_count"),
        F.when(F.col("lead_id") % 3 == 0, F.lit(4.0)).alias("google_rating"))


def review_insight(spark, d):
    found, _ = answers.parse_review_answers(view(spark, d, "review_answers_v"))
    summaries = found.select(F.col("key").alias("id"), "summary", "sentiment", "highlights")
    out = reviews.review_insight(_review_leads(spark, d), view(spark, d, "reviews_v"), summaries)
    return out.select(
        "id", "reviews.count", "reviews.average", "reviews.summary", "reviews.sentiment",
        F.array_join("reviews.highlights", "|").alias("highlights"))


def parse_review_answers(spark, d):
    good, _ = answers.parse_review_answers(view(spark, d, "review_answers_v"))
    return good.select("key", "summary", "sentiment", F.array_join("highlights", ",").alias("highlights"))


def parse_result_pages(spark, d):
    return results.parse_result_pages(view(spark, d, "result_pages_v"), 2).withColumn("rank", F.col("rank").cast("bigint"))


def web_context(spark, d):
    found = results.parse_result_pages(view(spark, d, "result_pages_v"), 3).withColumnRenamed("page_id", "task_id")
    texts = found.filter("task_id % 2 = 0").select("url", F.concat(F.lit("Page of "), "title").alias("text")).dropDuplicates(["url"])
    out = results.web_context(found, texts.filter(F.contains("url", F.lit("hotel"))), 3, 1)
    return out.select("task_id", "text", F.array_join("sources", ",").alias("sources"))


QUERIES = {f.__name__: f for f in (
    extract_emails, relevant_emails, attach_email_facts, email_status, email_verdicts, extract_phones, visible_text, page_links,
    page_budget, pages_for_leads, enrich_from_pages, site_contacts, extract_socials, extract_legal_names, extract_people,
    extract_site_phones, review_corpus, top_n_per_group, review_insight, parse_review_answers, parse_result_pages, web_context)}

# --- SQL ------------------------------------------------------------------------------------------------

_BAD = " OR ".join(f"regexp_matches(e, {lit(p)})" for p in (
    fixed.EMAIL_ASSET, fixed.EMAIL_PLACEHOLDER, fixed.EMAIL_HASH, fixed.EMAIL_ESCAPED))


def _emails(name: str, key: str, text: str, source: str) -> str:
    return (f"{name} AS (SELECT {key}, unnest(es) AS email, generate_subscripts(es, 1) - 1 AS pos FROM (SELECT {key}, "
            f"list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'), lambda e: lower(e)), "
            f"lambda e: NOT ({_BAD}) AND length(e) <= 100) AS raw_es, "
            f"list_filter(raw_es, lambda e, i: list_position(raw_es, e) = i) AS es FROM {source}))")


_DOC_EMAILS = _emails("found", "doc_id", "text", "documents")
_FACTS = "facts AS (SELECT domain, has_mx, catch_all, k % 5 <> 0 AS probed FROM domain_facts_v)"
_ADDRESSES = "address_facts AS (SELECT DISTINCT email, length(email) % 2 = 0 AS accepted FROM found WHERE length(email) % 3 <> 0)"
_ATTACHED = """attached AS (SELECT f.*, split_part(email, '@', 2) AS domain, has_mx, probed, catch_all, accepted FROM found f
 LEFT JOIN facts ON facts.domain = split_part(email, '@', 2) LEFT JOIN address_facts USING (email))"""
_STATUS = """judged AS (SELECT doc_id, pos, email, CASE WHEN NOT coalesce(has_mx, FALSE) THEN 'invalid' WHEN NOT probed THEN 'unknown' WHEN catch_all THEN 'risky'
 WHEN accepted IS NULL THEN 'unknown' WHEN accepted THEN 'valid' ELSE 'invalid' END AS status, CASE WHEN has_mx AND probed THEN catch_all END AS known_catch_all FROM attached)"""
_MAIL = (_DOC_EMAILS, _FACTS, _ADDRESSES, _ATTACHED, _STATUS)


def _gone(x: str, tag: str) -> str:
    return f"regexp_replace({x}, '(?is)<{tag}([^>a-z0-9-][^>]*)?>.*?</{tag}\\s*>', '', 'g')"


def _visible() -> str:
    x = "html"
    for tag in ("script", "style"):
        x = _gone(x, tag)
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("nav", "footer", "noscript", "header", "svg", "head"):
        x = _gone(x, tag)
    x = f"regexp_replace({x}, '(?s)</?[A-Za-z][^>]*>|<![^>]*>', '', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"replace({x}, '&{name};', {lit(char)})"
    return f"substr(nullif({collapse(x)}, ''), 1, 3000)"


_VISITED = """ranked AS (SELECT page_id, html, regexp_extract(url, '//([^/]*)', 1) AS site, page_id % 4 AS i FROM site_pages_v),
homes AS (SELECT site FROM ranked WHERE i = 0 AND html IS NOT NULL),
visited AS (SELECT r.* FROM ranked r SEMI JOIN homes USING (site) WHERE html IS NOT NULL)"""
_SITE_LEADS = "site_leads AS (SELECT ord, 'site' || (ord - ord % 5) || '.cm' AS site FROM places_v WHERE ord % 4 <> 3)"
_PAD = "lpad(CAST({n} % 1000000 AS VARCHAR), 6, '0')"
_N = "(page_id - page_id % 4) // 4"
_READ = """picked AS (SELECT lead_id, pos, trim(rating_label) AS rating_label, """ + trim("text") + """ AS text FROM reviews_v
 QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY pos) <= 40),
chosen AS (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY pos) AS rank FROM picked WHERE text <> '' QUALIFY rank <= 25)"""
_RATE = "CASE rating_label WHEN '4,5 étoiles' THEN 4.5 WHEN '3 stars' THEN 3.0 WHEN '4,5' THEN 4.0 END"
_REVIEW_ANSWERS = """parsed AS (SELECT key, CASE key % 5 WHEN 0 THEN 'Good ' || key || '.' WHEN 1 THEN 'x' ELSE 'y' END AS summary,
 CASE key % 5 WHEN 0 THEN 'positive' ELSE 'mixed' END AS sentiment, CASE key % 5 WHEN 0 THEN 'a,b,c,d,e' WHEN 1 THEN '' ELSE 'z' END AS highlights
 FROM review_answers_v WHERE key % 5 IN (0, 1, 4))"""
_RESULTS = """found AS (SELECT page_id, 1 AS rank, 'Hotel ' || page_id || ' & Spa' AS title, 'https://hotel' || page_id || '.cm/contact' AS url, 'Rooms in town' AS snippet FROM result_pages_v
 UNION ALL SELECT page_id, 2, 'Two', 'https://two.example.org/' || (page_id % 3), '' FROM result_pages_v
 UNION ALL SELECT page_id, 3, 'Five', 'https://five.example.org/', 'last' FROM result_pages_v)"""

ORACLES = {
    "extract_emails": with_("texts AS (SELECT -doc_id - 1 AS page_id, text FROM documents UNION ALL SELECT page_id, html FROM pages)",
                            _emails("found", "page_id", "text", "texts")) + "SELECT page_id, pos, email FROM found",
    "relevant_emails": with_(_DOC_EMAILS) + "SELECT doc_id, email FROM found WHERE split_part(email, '@', 2) = 'mail' || (doc_id % 10) || '.example.com' "
    "OR regexp_matches(email, '@(.*[.])?(gmail|yahoo|hotmail|outlook|icloud)[.][a-z]+$')",
    "attach_email_facts": with_(*_MAIL, views=("domain_facts_v",)) + "SELECT doc_id, email, domain, has_mx, probed, catch_all, accepted FROM attached",
    "email_status": with_(*_MAIL, views=("domain_facts_v",)) + "SELECT DISTINCT email, status, known_catch_all FROM judged",
    "email_verdicts": with_(*_MAIL, """firsts AS (SELECT doc_id // 10 AS g, email, min(doc_id * 1000 + pos) AS seen, max(doc_id * 1000 + pos) AS latest,
 any_value(status) AS status, any_value(known_catch_all) AS known FROM judged GROUP BY 1, 2)""", views=("domain_facts_v",)) +
    "SELECT CAST(g AS VARCHAR) AS id, CASE WHEN g % 3 = 0 THEN arg_max(status, latest) ELSE ['valid', 'risky', 'unknown', 'invalid'][min(list_position(['valid', 'risky', 'unknown', 'invalid'], status))] END AS email_status, "
    "arg_max(known, CASE WHEN g % 3 = 0 AND latest = top THEN -1 ELSE seen END) FILTER (known IS NOT NULL) AS email_catch_all, count(*) AS n_checked "
    "FROM (SELECT *, max(latest) OVER (PARTITION BY g) AS top FROM firsts) GROUP BY g",
    "extract_phones": "SELECT DISTINCT doc_id, '+1' || regexp_extract(regexp_replace(n, '[^0-9]', '', 'g'), '^1?(.*)$', 1) AS e164 FROM (SELECT doc_id, c, regexp_extract(c, '^[^+0-9]*([+]?[0-9][0-9 ().-]*[0-9])[^0-9]*$', 1) AS n FROM "
    "(SELECT doc_id, unnest(regexp_split_to_array(text, " + lit("[,;/]|[" + BLANKS + "]{2,}") + ")) AS c FROM documents)) "
    "WHERE length(trim(c)) <= 250 AND regexp_full_match(regexp_replace(n, '[ ().-]', '', 'g'), '[+]1[2-9][0-9]{2}[2-9][0-9]{6}|1?[2-9][0-9]{2}[2-9][0-9]{6}')",
    "visible_text": f"SELECT page_id, {_visible()} AS text FROM pages",
    "page_links": "SELECT page_id, generate_subscripts(hs, 1) - 1 AS pos, unnest(hs) AS href, lower(regexp_extract(url, '^https?://[^/?#]*')) || "
    "replace(replace(url_encode(unnest(hs)), '%2F', '/'), '%2C', ',') AS url "
    "FROM (SELECT page_id, url, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS hs FROM pages)",
    "page_budget": "WITH r AS (SELECT page_id, lower(regexp_extract(url, '//([^/?#:]*)', 1)) AS site, page_id % 5 <> 0 AS ok, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS path_rank FROM pages), "
    "s AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY site ORDER BY path_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen, "
    "max(CASE WHEN path_rank = 0 AND ok THEN 1 ELSE 0 END) OVER (PARTITION BY site) AS home FROM r WHERE path_rank < 6) "
    "SELECT site, page_id, path_rank FROM s WHERE ok AND home = 1 AND seen < 4",
    "pages_for_leads": with_(_VISITED, _SITE_LEADS, views=("site_pages_v", "places_v")) + "SELECT ord, site, page_id FROM site_leads JOIN visited USING (site)",
    "enrich_from_pages": with_(_VISITED, _SITE_LEADS, "n AS (SELECT l.ord, l.site, l.ord - l.ord % 5 AS n, h.site IS NOT NULL AS up, EXISTS (SELECT 1 FROM visited v WHERE v.site = l.site AND i = 2) AS team "
                               "FROM site_leads l LEFT JOIN homes h USING (site))", views=("site_pages_v", "places_v")) +
    "SELECT ord, CASE WHEN up THEN 'contact@site' || n || '.cm' END AS email, CASE WHEN up THEN 'SITE ' || n || ' SARL' END AS legal_name, "
    "CASE WHEN up THEN 'contact@site' || n || '.cm,reservation@site' || n || '.cm,awa.ntsama@gmail.com' ELSE '' END AS emails, "
    f"CASE WHEN up AND n % 1000000 = 0 THEN '+237699000000,+237233420001' WHEN up THEN '+237699' || {_PAD.format(n='n')} || ',+237233420001,+237699000000' ELSE '' END AS phones, "
    "CASE WHEN up THEN 'https://www.facebook.com/site' || n END AS facebook, CASE WHEN up THEN 'https://www.linkedin.com/company/site' || n END AS linkedin, "
    f"CASE WHEN up THEN '+237699' || {_PAD.format(n='n')} END AS whatsapp, "
    "CASE WHEN up AND team THEN 'Jean-Pierre Mbarga/GENERAL_MANAGER,Awa Ntsama/DIRECTOR/awa.ntsama@gmail.com' ELSE '' END AS people FROM n",
    "site_contacts": with_(views=("site_pages_v",)) +
    "SELECT page_id, CAST(0 AS BIGINT) AS pos, CASE WHEN page_id % 4 = 2 THEN 'Jean-Pierre Mbarga' ELSE 'JEAN-PIERRE MBARGA' END AS full_name, "
    "CASE WHEN page_id % 4 = 2 THEN 'GENERAL_MANAGER' END AS role, NULL AS email_direct, CAST(1 AS DOUBLE) AS confidence FROM site_pages_v WHERE html IS NOT NULL "
    "UNION ALL SELECT page_id, 1, 'Awa Ntsama', 'DIRECTOR', 'antsama@x' || page_id || '.cm', 0.55 FROM site_pages_v WHERE html IS NOT NULL AND page_id % 4 = 2",
    "extract_socials": with_(views=("site_pages_v",)) + f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.linkedin.com/company/site' || {_N} END AS linkedin, "
    f"CASE page_id % 4 WHEN 0 THEN 'https://www.facebook.com/site' || {_N} END AS facebook, NULL AS instagram, NULL AS twitter, NULL AS youtube, NULL AS tiktok, "
    f"CASE page_id % 4 WHEN 1 THEN '+237699' || {_PAD.format(n=_N)} END AS whatsapp FROM site_pages_v WHERE html IS NOT NULL",
    "extract_legal_names": with_(views=("site_pages_v",)) + "SELECT regexp_extract(url, '//([^/]*)', 1) AS site, "
    "regexp_extract(html, '[0-9]{4} (SITE [0-9]+) S[.]A', 1) || ' SARL' AS legal_name FROM site_pages_v WHERE page_id % 4 = 3",
    "extract_people": with_(views=("site_pages_v",)) +
    "SELECT page_id, CAST(0 AS BIGINT) AS pos, 'Jean-Pierre Mbarga' AS full_name, 'Directeur Général' AS title_raw, 'GENERAL_MANAGER' AS role, CAST(0.55 AS DOUBLE) AS confidence FROM site_pages_v WHERE html IS NOT NULL AND page_id % 4 = 2 "
    "UNION ALL SELECT page_id, 1, 'Awa Ntsama', 'Responsable ventes', 'DIRECTOR', 0.55 FROM site_pages_v WHERE html IS NOT NULL AND page_id % 4 = 2",
    "extract_site_phones": with_(views=("site_pages_v",)) + f"SELECT page_id, min(pos) AS pos, e164 FROM (SELECT page_id, CAST(0 AS BIGINT) AS pos, '+237699' || {_PAD.format(n=_N)} AS e164 FROM site_pages_v WHERE page_id % 4 = 1 "
    "UNION ALL SELECT page_id, 1, '+237233420001' FROM site_pages_v WHERE page_id % 4 = 1 UNION ALL SELECT page_id, 2, '+237699000000' FROM site_pages_v WHERE page_id % 4 = 1) GROUP BY page_id, e164",
    "review_corpus": with_(_READ, views=("reviews_v",)) + "SELECT lead_id, string_agg('[' || rank || '] (' || coalesce(nullif(rating_label, ''), '?') || ') ' || "
    "substr(" + collapse("text") + ", 1, 500), chr(10) ORDER BY rank) AS corpus FROM chosen GROUP BY lead_id",
    "top_n_per_group": with_(views=("reviews_v",)) + "SELECT lead_id, pos, length(text) AS n FROM reviews_v QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY length(text) DESC, pos) <= 3",
    "review_insight": with_(_READ, _REVIEW_ANSWERS, f"""stats AS (SELECT lead_id AS id, count(*) AS n, round(avg({_RATE}::DOUBLE), 2) AS a,
 string_agg(CASE WHEN k <= 3 THEN CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 199) || '…' END END, '|' ORDER BY rank) AS excerpts
 FROM (SELECT *, CASE WHEN length(text) > 40 THEN row_number() OVER (PARTITION BY lead_id, length(text) > 40 ORDER BY rank) END AS k FROM chosen) GROUP BY lead_id)""",
                            views=("reviews_v", "review_answers_v")) +
    "SELECT id, CASE WHEN id % 2 = 0 THEN id ELSE n END AS count, CASE WHEN id % 3 = 0 THEN CAST(4 AS DOUBLE) ELSE a END AS average, p.summary, p.sentiment, "
    "CASE WHEN p.sentiment IS NULL THEN coalesce(excerpts, '') ELSE replace(p.highlights, ',', '|') END AS highlights FROM stats LEFT JOIN parsed p ON p.key = stats.id",
    "parse_review_answers": with_(_REVIEW_ANSWERS, views=("review_answers_v",)) + "SELECT key, summary, sentiment, highlights FROM parsed",
    "parse_result_pages": with_(_RESULTS, views=("result_pages_v",)) + "SELECT page_id, CAST(rank AS BIGINT) AS rank, title, url, snippet FROM found WHERE rank <= 2",
    "web_context": with_(_RESULTS, views=("result_pages_v",)) +
    "SELECT page_id AS task_id, string_agg('[Résultat ' || rank || '] ' || title || chr(10) || 'URL: ' || url || chr(10) || 'Extrait: ' || CASE WHEN snippet = '' THEN '(pas d’extrait)' ELSE snippet END, chr(10) || chr(10) ORDER BY rank) "
    "|| CASE WHEN page_id % 2 = 0 THEN chr(10) || chr(10) || '[Contenu complet de https://hotel' || page_id || '.cm/contact]' || chr(10) || 'Page of Hotel ' || page_id || ' & Spa' ELSE '' END AS text, "
    "string_agg(url, ',' ORDER BY rank) AS sources FROM found GROUP BY page_id",
}
