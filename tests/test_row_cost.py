"""Steps that every row goes through: same answers as the plain forms, each part worked out once."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from entiform import fixed
from entiform.functions import names, phone, text, web


def test_blank_class_is_the_list_of_blanks(spark):
    codes = spark.createDataFrame([(i, chr(i)) for i in range(1, 0x10000) if not 0xD800 <= i <= 0xDFFF], "id int, c string")
    for flags in ("", "(?iu)"):
        met = {r.id for r in codes.where(F.rlike("c", F.lit(f"{flags}{text.BLANK}"))).collect()}
        assert met == {ord(c) for c in text.BLANKS}


def test_first_chunk_needs_no_pattern_for_each_row(spark):
    given = ["a; b", "/x", "", " 699  700 ", "1 2/3\n4", None, "1 2", "7;\n8"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, raw string")
    chunk = phone.first_chunk(F.col("raw"))
    wanted = [None if v is None else re.split(f"[/;]|[{text.BLANKS}]{{2,}}", v, maxsplit=1)[0].strip(text.BLANKS) for v in given]
    assert [r.c for r in rows.select("i", chunk.alias("c")).orderBy("i").collect()] == wanted
    assert "split(" not in str(chunk)


def test_a_url_is_one_where_it_has_a_canonical_form(spark):
    given = ["https://a.cm", "http://a.cm:70000/", "http://1.2.3", "http://1.2.3.4/x?y#z", "ftp://a", "", None, "https://a b", "x\u0001y\u0001h\u0001",
             "x\u0001y\u0001h\u0001\u0001p\u0001", "http://u@h:8/../a\\b", "HTTPS://[::1]/"]
    rows = spark.createDataFrame([(v,) for v in given], "url string")
    for r in rows.select("url", web.canonical_url(F.col("url")).alias("c"), web.is_url(F.col("url")).alias("ok")).collect():
        assert r.ok == (r.c is not None), r


def test_words_and_brands_keep_their_edges(spark):
    given = ["sa hotel_sa l'hotel éhotel hotelé sa", "hôtel sa", "le", "", "la-la", "BEST WESTERN x", "xonomo", "onomo.", "Azalaï", "la  falaise", "STAR LAND", None]
    rows = spark.createDataFrame([(v,) for v in given], "name string")
    c = F.col("name")
    brand = F.coalesce(*[F.when(F.rlike(c, F.lit("(?iu)" + text.word(p.replace(" ", f"[{text.BLANKS}]")))), F.lit(b)) for b, p in fixed.KNOWN_BRANDS])
    for words in (fixed.COMPANY_WORDS, fixed.BRAND_WORDS, fixed.FORM_WORDS, ("é", "sa")):
        for r in rows.select("name", text.drop_words(c, words).alias("a"), F.regexp_replace(c, text.word("|".join(words)), "").alias("b")).collect():
            assert r.a == r.b, r
    for r in rows.select("name", names.known_brand(c).alias("a"), brand.alias("b")).collect():
        assert r.a == r.b, r


def test_legal_names_are_tried_at_capitals_only(spark):
    ahead = f"(?=[{web._UPPER}])"
    assert web._LEGAL.startswith(ahead)
    plain = web._LEGAL.removeprefix(ahead)
    given = ["(c) 2024 SITE 7 S.A.R.L., all", "xSITE A SARL", "Été Bleu SA", "the Sun  Inn GIE and Moon & Co S.A", "no form", "", None]
    rows = spark.createDataFrame([(v,) for v in given], "t string")
    flat = F.regexp_replace("t", f"[{text.BLANKS}]+", " ")
    form = F.upper(F.replace(F.regexp_extract(flat, plain, 2), F.lit("."), F.lit("")))
    wanted = F.when(form != "", text.trim(F.concat(text.trim(F.regexp_extract(flat, plain, 1)), F.lit(" "), form)))
    for r in rows.select("t", web.legal_name(F.col("t")).alias("a"), wanted.alias("b")).collect():
        assert r.a == r.b, r
