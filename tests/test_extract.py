from pyspark.sql import functions as F

from entiform import schemas
from entiform.functions import web
from entiform.operators import answers, emails, extract, ordering, results, reviews


def pages(spark, *html):
    return spark.createDataFrame([(i, f"https://www.hotel-x.cm/{i}", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")


def test_emails(spark):
    df = pages(spark, '<a href="mailto:Contact@Hotel-X.CM">write</a> reservation@hotel-x.cm et logo@2x.png sprite@sentry.io '
                      "0123456789abcdef0@x.cm u003ea@x.cm contact@hotel-x.cm")
    assert [r.email for r in extract.extract_emails(df).orderBy("pos").collect()] == ["contact@hotel-x.cm", "reservation@hotel-x.cm"]


def test_relevant(spark):
    df = spark.createDataFrame([("a@x.cm", "www.x.cm"), ("a@gmail.com", "x.cm"), ("a@y.cm", "x.cm")], "email string, host string")
    assert sorted(r.email for r in extract.relevant_emails(df).collect()) == ["a@gmail.com", "a@x.cm"]


def test_phones(spark):
    df = spark.createDataFrame([(1, "+237 699 00 00 00"), (2, "Tel: 6 99 00 00 00 / 233 42 00 01"), (3, "room 12, 3")], "page_id bigint, text string")
    got = extract.extract_phones(df).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.e164) for r in got] == [(1, "+237699000000"), (2, "+237699000000"), (2, "+237233420001")]


def test_socials(spark):
    links = ["https://www.facebook.com/sharer/sharer.php?u=x", "https://www.facebook.com/hotelx", "https://www.facebook.com/second",
             "https://www.linkedin.com/company/hotel-x/", "https://wa.me/237699000000", "https://example.cm", "instagram.com/no",
             "https://netflix.com/title"]
    df = spark.createDataFrame([(1, links)], "page_id bigint, links array<string>")
    row = extract.extract_socials(df).first()
    assert (row.facebook, row.linkedin, row.whatsapp, row.instagram, row.twitter) == (
        "https://www.facebook.com/hotelx", "https://www.linkedin.com/company/hotel-x", "+237699000000", None, "https://netflix.com/title")
    assert extract.extract_socials(df, strict_hosts=True).first().twitter is None


def test_legal_name(value):
    assert value(web.legal_name, "© 2024 AKWA PALACE SARL, all rights reserved", "Nice hotel with no legal notice",
                 "Société Hôtelière S.A.R.L. au capital") == ["AKWA PALACE SARL", None, "ère SARL"]


def test_people(spark):
    df = spark.createDataFrame([(1, "Our team: Jean-Pierre Mbarga, Directeur Général. Awa Ntsama, Responsable Réservations")], "page_id bigint, text string")
    got = {r.full_name: r for r in extract.extract_people(df).collect()}
    assert got["Jean-Pierre Mbarga"].role == "GENERAL_MANAGER" and "Awa Ntsama" in got
    assert got["Awa Ntsama"].confidence == 0.55


def test_guess(value):
    def guess(c):
        return web.guess_email(c, F.array(F.lit("info@x.cm"), F.lit("j.mbarga@x.cm"), F.lit("awantsama@x.cm")))

    assert value(guess, "Jean Mbarga", "Awa Ntsama", "Luc Owona") == ["j.mbarga@x.cm", "awantsama@x.cm", None]


def test_page_budget(spark):
    rows = [("a", i, i != 1) for i in range(8)] + [("b", 0, False), ("b", 1, True), ("c", 1, True)] + [("d", i, i == 0 or i > 5) for i in range(9)]
    df = spark.createDataFrame(rows, "site string, path_rank int, ok boolean")
    got = ordering.page_budget(df, max_pages=4).orderBy("site", "path_rank").collect()
    # a: ranks 0 2 3 4; b: home page failed; c: no home page; d: only six attempts, one reachable
    assert [(r.site, r.path_rank) for r in got] == [("a", 0), ("a", 2), ("a", 3), ("a", 4), ("d", 0)]


def test_result_pages(spark):
    html = ('<div class="result results_links result__body"><h2><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.cm%2Fa%3Fb%3D1&amp;rut=9">'
            "The <b>X</b></a></h2><a class=\"result__snippet\">a <b>b</b></a></div><div class='result__body'><a class=\"result__a\" href=\"ftp://y\">Y</a></div>")
    rows = results.parse_result_pages(pages(spark, html)).collect()
    assert [(r.rank, r.title, r.url, r.snippet) for r in rows] == [(1, "The X", "https://x.cm/a?b=1", "a b")]


def test_answers(spark):
    df = spark.createDataFrame([
        (1, 'Here is:\n{"summary": " Friendly. ", "sentiment": "positive", "highlights": ["staff", "wifi"]}\nThanks.'),
        (2, '{"summary": "x", "highlights": []}'), (3, "no json here"), (4, '{"a": '), (5, "[1]")], "key int, answer string")
    good, bad = answers.parse_review_answers(df)
    assert {r.key: (r.summary, r.sentiment, r.highlights) for r in good.collect()} == {
        1: ("Friendly.", "positive", ["staff", "wifi"]), 2: ("x", "mixed", [])}
    assert sorted(r.key for r in bad.collect()) == [3, 4, 5]


def test_record_answer_rejects(spark):
    df = spark.createDataFrame([
        (1, '{"governance_confidence": 1.5}'), (2, '{"latitude": "", "governance_confidence": "0.5"}'), (3, '{"latitude": "north"}'),
        (4, '{"owner": "X", "latitude": 4.05}')], "key int, answer string")
    good, bad = answers.parse_record_answers(df)
    rows = {r.key: r.parsed for r in good.collect()}
    assert set(rows) == {2, 4} and rows[2].latitude is None and rows[2].governance_confidence == 0.5 and rows[4].latitude == 4.05
    assert sorted(r.key for r in bad.collect()) == [1, 3]


def test_discovered(spark):
    df = spark.createDataFrame([(1, "D", '{"hotels": ["A1", " B1 ", "x", 5, null]}'), (2, "D", '{"hotels": ["B1", "C1"]}'), (3, "K", "none")],
                               "ord int, city string, answer string")
    got = answers.discovered_names(df).orderBy("first_ord", "first_pos").collect()
    assert [(r.city, r.name) for r in got] == [("D", "A1"), ("D", "B1"), ("D", "C1")]


def test_email_verdicts(spark):
    contact = ("Jo", "OTHER", None, "c@trap.cm", None, None, 0.9)
    leads = spark.createDataFrame([
        (1, "1", "a@ok.cm", ["b@gone.cm", "a@ok.cm"], [contact]), (2, "2", None, ["x@yopmail.com", "y@shut.cm"], []), (3, "3", None, [], []),
        (4, "1", "a@ok.cm", ["b@gone.cm"], [])],
        f"ord bigint, id string, email string, emails array<string>, contacts array<{schemas.CONTACT}>")
    domains = spark.createDataFrame([("ok.cm", True, True, False), ("gone.cm", False, True, None), ("trap.cm", True, True, True), ("shut.cm", True, False, None)],
                                    "domain string, has_mx boolean, probed boolean, catch_all boolean")
    accepted = spark.createDataFrame([("a@ok.cm", True)], "email string, accepted boolean")
    found = {r.ord: r for r in emails.email_verdicts(leads, domains, accepted).collect()}
    assert set(found) == {1, 2, 4} and found[4].id == "1" and found[4].email_status == "valid"
    rows = {"1": found[1], "2": found[2]}
    assert (rows["1"].email_status, rows["1"].email_catch_all) == ("valid", True)
    assert rows["1"].email_checks == {"a@ok.cm": "valid", "b@gone.cm": "invalid", "c@trap.cm": "risky"}
    assert rows["1"].contacts[0].confidence == 0.9 and rows["2"].email_status == "unknown"


def test_review_insight(spark):
    rows = [("1", i, "4,5 étoiles" if i % 2 else "3 stars", ("long " * 30 + str(i)) if i < 6 else "" if i < 20 else "short") for i in range(60)]
    df = spark.createDataFrame([(a, b, "me", c, d) for a, b, c, d in rows], "lead_id string, pos int, author string, rating_label string, text string")
    leads = spark.createDataFrame([(1, "1", None, 4.2), (2, "2", 5, None)], "ord bigint, id string, reviews_count bigint, google_rating double")
    got = reviews.review_insight(leads, df).collect()
    assert len(got) == 1 and got[0].reviews["count"] == 25 and got[0].reviews.average == 4.2
    assert len(got[0].reviews.highlights) == 3 and got[0].reviews.sentiment is None


def test_website_patch(spark):
    from entiform.operators.leads import normalize_leads
    from entiform.operators.merge import apply_patch

    raw = spark.createDataFrame([(1, "s", "X", "http://www.hotel-x.cm"), (2, "s", "Y", "http://hotel-y.cm"), (3, "s", "Z", None)],
                                "ord bigint, source string, company_name string, website_url string")
    leads = normalize_leads(raw)
    site = spark.createDataFrame([
        (1, "https://www.hotel-x.cm/", '<body><a href="https://x.com/first">t</a></body>'),
        (2, "https://www.hotel-x.cm/contact", '<body><a href="https://x.com/second">t</a> jean@hotel-x.cm a@other.cm info@hotel-x.cm '
            '<a href="tel:+237699000000">c</a><p>Jean Kamga, Directeur</p></body>'),
        (3, "https://www.hotel-x.cm/rooms", "<body>z@hotel-x.cm</body>")], "page_id bigint, url string, html string")
    out = {r.ord: r for r in apply_patch(leads, extract.enrich_from_pages(leads, site), "website").collect()}
    x = out[1]
    assert x.email == "info@hotel-x.cm" and x.emails == ["jean@hotel-x.cm", "info@hotel-x.cm"]
    assert x.phones == ["+237699000000"] and x.socials.twitter == "https://x.com/first"
    assert [(c.full_name, c.role, c.email_direct) for c in x.contacts] == [("Jean Kamga", "DIRECTOR", "jean@hotel-x.cm")]
    assert out[2].enriched_by == ["website"] and out[2].emails == [] and out[3].enriched_by == []
