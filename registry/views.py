"""Derived input views: the same SQL text runs on Spark and on DuckDB."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from entiform.functions.storage import settle, spread

PLACES = """
SELECT c_custkey AS ord, c_mktsegment AS search_id,
 concat(CASE c_custkey % 4 WHEN 0 THEN 'Hôtel ' WHEN 1 THEN 'HOTEL ' WHEN 2 THEN 'Résidence ' ELSE '  ' END,
        CASE c_custkey % 11 WHEN 0 THEN 'Onomo ' WHEN 5 THEN 'Pullman ' ELSE 'Akwa ' END,
        CAST(c_custkey - c_custkey % 4 AS VARCHAR(20))) AS name,
 concat('https://www.google.com/maps/place/x/@', CAST(c_nationkey % 10 AS VARCHAR(20)), '.0511,9.7679,17z') AS place_url,
 c_mktsegment AS category,
 concat('BP ', CAST(1000 + c_custkey % 9000 AS VARCHAR(20)), ', ',
        CASE c_nationkey % 8 WHEN 0 THEN 'dla' WHEN 1 THEN 'DOUALA' WHEN 2 THEN 'Douala - Littoral' WHEN 3 THEN 'yaounde'
             WHEN 4 THEN 'Yaoundé' WHEN 5 THEN 'kribi' WHEN 6 THEN 'saint louis' ELSE 'Buéa' END, ', Cameroun') AS address,
 CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'N/A'
      WHEN c_custkey % 2 = 0 THEN concat('6 99 ', lpad(CAST(c_custkey - c_custkey % 3 AS VARCHAR(20)),
           CASE WHEN c_custkey < 1000000 THEN 6 ELSE 12 END, '0'))
      ELSE concat('+237 699', lpad(CAST(c_custkey - c_custkey % 3 AS VARCHAR(20)),
           CASE WHEN c_custkey < 1000000 THEN 6 ELSE 12 END, '0'), ' / 233 42 00 01') END AS phone,
 CASE WHEN c_custkey % 5 IN (1, 4) THEN concat('https://www.Site', CAST(c_custkey - c_custkey % 5 AS VARCHAR(20)), '.cm/accueil#top')
      WHEN c_custkey % 5 = 2 THEN concat('site', CAST(c_custkey - c_custkey % 5 AS VARCHAR(20)), '.cm') END AS website,
 concat(CAST(c_custkey % 6 AS VARCHAR(20)), ',', CAST(c_custkey % 10 AS VARCHAR(20)), ' étoiles') AS rating_text,
 CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat('(1 ', lpad(CAST(c_custkey % 1000 AS VARCHAR(20)), 3, '0'), ')') END AS reviews_text
FROM customer
"""

TASKS = """
SELECT s_suppkey AS task_ord,
 concat(CASE s_suppkey % 3 WHEN 0 THEN 'Hôtel La ' WHEN 1 THEN 'HOTEL ' ELSE 'Résidence ' END, 'Falaise ',
        CASE s_suppkey % 4 WHEN 0 THEN '(Bonapriso)' WHEN 1 THEN '- BONAPRISO' WHEN 2 THEN 'Akwa' ELSE 'Mont Fébé' END,
        ' ', CAST(100 + s_suppkey - s_suppkey % 6 AS VARCHAR(20))) AS input_name,
 CASE s_nationkey % 3 WHEN 0 THEN 'Douala' WHEN 1 THEN 'Yaoundé' ELSE 'Abidjan' END AS city,
 CASE s_nationkey % 3 WHEN 2 THEN 'Côte d''Ivoire' ELSE 'Cameroun' END AS country
FROM supplier
"""

ANSWERS = """
SELECT s_suppkey AS task_ord,
 concat(CASE s_suppkey % 5 WHEN 0 THEN 'Here is the result: ' ELSE '' END,
  CASE WHEN s_suppkey % 11 = 10 THEN 'no json here' ELSE concat('{"name": null, "owner": ',
    CASE s_suppkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"Groupe X"' ELSE '"N/A"' END,
    ', "management": ', CASE s_suppkey % 4 WHEN 0 THEN '"Jean Dupont"' ELSE 'null' END,
    ', "phone": "699 00 ', lpad(CAST(s_suppkey % 10000 AS VARCHAR(20)), 4, '0'), '", "email": "INFO@SITE', CAST(s_suppkey AS VARCHAR(20)),
    '.CM", "website": "www.site', CAST(s_suppkey AS VARCHAR(20)), '.cm/", "governance_confidence": ',
    CASE s_suppkey % 7 WHEN 0 THEN 'null' WHEN 1 THEN '1.5' ELSE concat('0.', CAST(s_suppkey % 10 AS VARCHAR(20))) END, '}') END) AS answer,
 CASE s_suppkey % 6 WHEN 0 THEN 'not-a-url' ELSE concat('https://press.example.org/', CAST(s_suppkey AS VARCHAR(20))) END AS source
FROM supplier
"""

REVIEWS = """
SELECT conv_id AS lead_id, turn AS pos, role AS author,
 CASE (conv_id + turn) % 5 WHEN 0 THEN '' WHEN 1 THEN '4,5 étoiles' WHEN 2 THEN '3 stars' WHEN 3 THEN '4,5' ELSE '9 étoiles' END AS rating_label, text
FROM conversations
"""

DOMAIN_FACTS = """
SELECT DISTINCT p_size AS k, concat('mail', CAST(p_size + 1 AS VARCHAR(20)), '.example.com') AS domain,
 p_size % 4 <> 0 AS has_mx, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 2 = 0 END AS catch_all FROM part
"""

# Four contact pages per customer's site; a visit fails where html is NULL.
SITE_PAGES = """
SELECT c_custkey * 4 + i AS page_id, concat('https://site', CAST(c_custkey AS VARCHAR(20)), '.cm', path) AS url,
 CASE WHEN i = 0 AND c_custkey % 35 = 0 THEN NULL WHEN i = 2 AND c_custkey % 15 = 0 THEN NULL
 WHEN i = 0 THEN concat('<html><head><title>x</title></head><body><a href="/contact">Contact</a>',
   '<a class="s" href="https://www.facebook.com/sharer/sharer.php?u=x">share</a>',
   '<a href="https://www.facebook.com/site', CAST(c_custkey AS VARCHAR(20)), '">f</a>',
   '<a href=''https://www.linkedin.com/company/site', CAST(c_custkey AS VARCHAR(20)), '/''>l</a><p>Welcome</p></body></html>')
 WHEN i = 1 THEN concat('<html><body><a href="mailto:Contact@Site', CAST(c_custkey AS VARCHAR(20)), '.CM">write</a> ',
   'reservation@site', CAST(c_custkey AS VARCHAR(20)), '.cm logo@2x.png press@elsewhere.org awa.ntsama@gmail.com, ',
   '<a href="tel:+237%20699%20', lpad(CAST(c_custkey % 1000000 AS VARCHAR(20)), 6, '0'), '">call</a>',
   '<a href="https://wa.me/237699', lpad(CAST(c_custkey % 1000000 AS VARCHAR(20)), 6, '0'), '">wa</a>',
   '<p>Tel: 2 33 42 00 01 / 6 99 00 00 00</p></body></html>')
 WHEN i = 2 THEN '<html><body><p>Our team: Jean-Pierre Mbarga, Directeur Général. Responsable ventes: Awa Ntsama</p></body></html>'
 ELSE concat('<html><body><p>(c) 2024 SITE ', CAST(c_custkey AS VARCHAR(20)), ' S.A.R.L., all rights reserved</p></body></html>') END AS html
FROM customer CROSS JOIN (SELECT 0 AS i, '' AS path UNION ALL SELECT 1, '/contact' UNION ALL SELECT 2, '/equipe'
 UNION ALL SELECT 3, '/mentions-legales') AS p
"""

# A stored search-result page per supplier: three usable results and one without a title.
RESULT_PAGES = """
SELECT s_suppkey AS page_id, concat('<div><div class="links result__body">',
 '<a rel="nofollow" class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fhotel', CAST(s_suppkey AS VARCHAR(20)),
 '.cm%2Fcontact&amp;rut=1">Hotel <b>', CAST(s_suppkey AS VARCHAR(20)), '</b> &amp; Spa</a>',
 '<a class="result__snippet" href="x">Rooms in town</a></div>',
 '<div class="result__body"><a class="result__a" href="https://two.example.org/', CAST(s_suppkey % 3 AS VARCHAR(20)), '">Two</a></div>',
 '<div class="result__body"><a class="result__a" href="https://three.example.org/"> </a></div>',
 '<div class="result__body"><a class="result__a" href="ftp://four.example.org/">Four</a></div>',
 '<div class="result__body"><a class="result__a" href="https://five.example.org/">Five</a><div class="result__snippet"> last </div></div></div>') AS html
FROM supplier
"""

REVIEW_ANSWERS = """
SELECT c_custkey AS key, CASE c_custkey % 5
 WHEN 0 THEN concat('Result: {"summary": " Good ', CAST(c_custkey AS VARCHAR(20)), '. ", "sentiment": "positive", "highlights": ["a", "b", "c", "d", "e", "f"]} Thanks.')
 WHEN 1 THEN '{"summary": "x", "highlights": []}'
 WHEN 2 THEN 'no json here'
 WHEN 3 THEN '{"summary": "cut'
 ELSE '{"summary": "y", "sentiment": "great", "highlights": ["z"]}' END AS answer
FROM customer
"""

DISCOVERED = """
SELECT s_suppkey AS ord, CASE s_nationkey % 3 WHEN 0 THEN 'Douala' WHEN 1 THEN 'Yaoundé' ELSE 'Abidjan' END AS city,
 concat('List: {"hotels": ["Hotel ', CAST(s_suppkey % 7 AS VARCHAR(20)), '", " Inn ', CAST(s_suppkey % 5 AS VARCHAR(20)),
  ' ", "A", 12, "Hotel ', CAST(s_suppkey % 7 AS VARCHAR(20)), '"]}') AS answer
FROM supplier
"""

CITY_SPECS = """
SELECT c_custkey AS ord, CASE c_custkey % 3 WHEN 0 THEN concat(' City', CAST(c_custkey AS VARCHAR(20)), ' : Gabon ')
 WHEN 1 THEN concat('City', CAST(c_custkey AS VARCHAR(20))) ELSE concat('City', CAST(c_custkey AS VARCHAR(20)), ': ') END AS spec
FROM customer
"""

BRANDS = """
SELECT c_custkey AS prio, concat('Brand ', CAST(c_custkey AS VARCHAR(20))) AS name,
 CASE c_custkey % 3 WHEN 0 THEN concat('Onomo ', CAST(c_custkey - c_custkey % 4 AS VARCHAR(20)))
  WHEN 1 THEN concat('akwa ', CAST(c_custkey - c_custkey % 4 AS VARCHAR(20))) ELSE CAST(c_custkey * 4 AS VARCHAR(20)) END AS phrase
FROM customer
"""

# A numbering plan per nation: codes of two or three digits, with and without a national prefix.
PLANS = """
SELECT n_nationkey AS prio, concat('N', CAST(n_nationkey AS VARCHAR(20))) AS iso2,
 concat(CAST(n_nationkey + 10 AS VARCHAR(20)), CASE WHEN n_nationkey % 5 = 0 THEN '9' ELSE '' END) AS calling_code,
 CASE WHEN n_nationkey % 3 = 0 THEN '011' ELSE '00' END AS idd, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '0' END AS trunk,
 CASE n_nationkey % 4 WHEN 0 THEN '[1-5][0-9]{9}' WHEN 1 THEN '[1-9][0-9]{6,8}' ELSE '[1-9][0-9]{9}' END AS nsn
FROM nation
"""

DIALLED = """
SELECT ord, country_iso, CASE ord % 5 WHEN 0 THEN concat('+', code, '-', number) WHEN 1 THEN concat('00', code, ' ', number) WHEN 2 THEN concat('0', number)
  WHEN 3 THEN concat(code, number) ELSE number END AS phone_raw
FROM (SELECT c_custkey AS ord, concat('N', CAST(c_nationkey AS VARCHAR(20))) AS country_iso, CAST(c_nationkey + 10 AS VARCHAR(20)) AS code,
  concat(CAST(1 + c_custkey % 9 AS VARCHAR(20)), '-', lpad(CAST(c_custkey * 37 AS VARCHAR(20)), CASE WHEN c_custkey % 3 = 0 THEN 7 ELSE 9 END, '0')) AS number FROM customer) AS c
"""

VIEWS = {
    "places_v": PLACES, "tasks_v": TASKS, "answers_v": ANSWERS, "reviews_v": REVIEWS, "domain_facts_v": DOMAIN_FACTS,
    "site_pages_v": SITE_PAGES, "result_pages_v": RESULT_PAGES, "review_answers_v": REVIEW_ANSWERS,
    "discovered_v": DISCOVERED, "city_specs_v": CITY_SPECS, "brands_v": BRANDS, "plans_v": PLANS, "dialled_v": DIALLED,
}
_TABLES = {
    "places_v": "customer", "tasks_v": "supplier", "answers_v": "supplier", "reviews_v": "conversations",
    "domain_facts_v": "part", "site_pages_v": "customer", "result_pages_v": "supplier",
    "review_answers_v": "customer", "discovered_v": "supplier", "city_specs_v": "customer", "brands_v": "customer", "plans_v": "nation", "dialled_v": "customer",
}
# Views that cost much for each row, and the rows they make of one.
_COSTLY = {"places_v": 1, "site_pages_v": 4}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The derived view over the tables of this folder; listings and pages, which cost much for each row, are dealt out and stored first."""
    source = _TABLES[name]
    alias = f"{source}_{zlib.crc32(folder.encode())}"
    rows = table(spark, folder, source)
    (spread(rows, _COSTLY[name]) if name in _COSTLY else rows).createOrReplaceTempView(alias)
    out = spark.sql(VIEWS[name].replace(f"FROM {source}", f"FROM {alias}"))
    return settle(out, name) if name in _COSTLY else out
