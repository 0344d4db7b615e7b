from pyspark.sql import functions as F

from entiform.functions import names, phone, places, text, web


def test_city(value):
    assert value(names.normalize_city, "DOUALA", "dla", "  yaounde ", "Douala, Littoral", "kaélé", None, "Saint-Louis",
                 "l'hay les roses") == ["Douala", "Douala", "Yaoundé", "Douala", "Kaélé", "", "Saint", "L'hay Les Roses"]
    assert value(names.city_key, "Yaoundé", "yaounde", "Douala ", "DLA") == ["yaounde", "yaounde", "douala", "douala"]


def test_phone(value):
    def read(c):
        return phone.standardize_phone(c, F.lit("CM"))

    got = value(read, "6 99 12 34 56", "+237 233 42 00 01", "00 237 6 99 00 00 00", "+237 699 00 00 00 / 233 00 00 00", "",
                "N/A", None, "237 699 00 00 00", "+44 20 7946 0958", "12 rue 34", "  699000000", "12345")
    assert [(r.e164, r.valid, r.country) if r else None for r in got] == [
        ("+237699123456", True, "CM"), ("+237233420001", True, "CM"), ("+237699000000", True, "CM"),
        ("+237699000000", True, "CM"), (None, False, None), (None, False, None), (None, False, None),
        ("+237699000000", True, "CM"), ("+442079460958", False, None), (None, False, None), (None, False, None),
        ("+23712345", False, "CM")]
    other = [("27 20 30 40 50", "CI", "+2252720304050"), ("0803 123 4567", "NG", "+2348031234567"),
             ("1 743 555 3824", "US", "+17435553824"), ("+1 (743) 555-3824", "CM", "+17435553824"),
             ("699000000", "ZZ", None), ("699 00 00 00", None, None), ("699000000 ext. 12", "CM", "+237699000000")]
    for raw, iso, want in other:
        assert value(lambda c, iso=iso: phone.standardize_phone(c, F.lit(iso).cast("string")), raw)[0].e164 == want


def test_user_supplied_plan(value):
    plans = phone.PLANS + (phone.Plan("FR", "33", "00", "0", "[1-9][0-9]{8}"),)
    got = value(lambda c: phone.standardize_phone(c, F.lit("FR"), plans), "01 42 68 53 00")[0]
    assert (got.e164, got.valid, got.country) == ("+33142685300", True, "FR")


def test_url(value):
    assert value(web.clean_url, "exemple.cm/contact", "https://WWW.Site.CM:443/a b?q='x'#top", "pas une url", "", None,
                 "http://x.cm:80", "https://x.cm?a=1", "x.cm/für", "https://x.cm:99999/") == [
        "https://exemple.cm/contact", "https://www.site.cm/a%20b?q=%27x%27", None, None, None, "http://x.cm/",
        "https://x.cm/?a=1", "https://x.cm/f%C3%BCr", None]
    assert value(web.clean_record_url, "www.akwa-palace.com/", "pas une url", " n/a ") == [
        "https://www.akwa-palace.com", None, None]
    assert value(web.domain_of, "https://www.hotel-x.cm/accueil", "http://hotel-x.cm", None) == ["hotel-x.cm", "hotel-x.cm", None]


def test_resolve(value):
    def at(c):
        return web.resolve_url(c, F.lit("https://x.cm/a/b?z#f"))

    assert value(at, "/p?q=1", "c", "../d", "./e", "//y.cm/k", "https://Z.cm", "tel:+237", "#t", "", "?n=2") == [
        "https://x.cm/p?q=1", "https://x.cm/a/c", "https://x.cm/d", "https://x.cm/a/e", "https://y.cm/k", "https://z.cm/",
        "tel:+237", "https://x.cm/a/b?z#t", "https://x.cm/a/b?z", "https://x.cm/a/b?n=2"]


def test_email(value):
    assert value(web.clean_email, "Write to Contact@Exemple.CM please", "none", None) == ["contact@exemple.cm", None, None]
    assert value(web.email_ok, "a@b.cm", "a..b@c.cm", ".a@b.cm", "a%b@c.cm", "a@b") == [True, False, False, False, False]


def test_roles_and_brands(value):
    assert value(names.infer_role, "Directeur Général", "Propriétaire & Fondateur", "Réceptionniste", None, "dgé", "Head of X") == [
        "GENERAL_MANAGER", "OWNER", "OTHER", "OTHER", "GENERAL_MANAGER", "DIRECTOR"]
    assert value(names.known_brand, "Hilton Yaoundé", "Azalaï Hotel", "Hotel Azalai", "Starland", "Hiltonia") == [
        "Hilton", None, "Azalaï", "Star Land", None]


def test_slug(value):
    def in_douala(c):
        return names.slug(c, F.lit("Douala"))

    assert value(in_douala, "Hôtel La Falaise (Bonapriso)", "HOTEL LA FALAISE - BONAPRISO", "la falaise bonapriso", "Hôtel", None) == [
        "douala-falaisebonapriso"] * 3 + ["douala-inconnu"] * 2
    assert value(names.canonical_name, "Hôtel Le Nsimeyong", "Résidence Akwa") == ["nsimeyong", "akwa"]
    assert value(names.tokens, "L'Hôtel de la Paix 12 x") == [["paix", "12"]]
    assert value(lambda c: names.hyphen_slug(c, F.lit("Douala")), "Hôtel La Falaise (Bonapriso)") == ["douala-la-falaise-bonapriso"]
    assert value(names.company_key, "Hôtel Akwa Palace SARL", "Hotel", None) == ["akwapalace", "", ""]


def test_places(value):
    assert value(places.parse_rating, "4,3", "4.0 stars", "sans note", "7", None) == [4.3, 4.0, None, None, None]
    assert value(places.parse_review_count, "(1 234)", "1,234 avis", "", "(1 234)") == [1234, 1234, None, 1234]
    assert value(places.rating_label, "4,5 étoiles", "3 stars", "4,5", "9 étoiles", "") == [4.5, 3.0, 4.0, None, None]
    assert value(places.city_from_address, "123 Rue de la Joie, Akwa, Douala, Cameroun", "BP 1234, Yaoundé, Cameroun", "", None,
                 "12345, Cameroun") == ["Douala", "Yaoundé", None, None, None]
    url = "https://www.google.com/maps/place/Hotel/@4.0511,9.7679,17z/data=!3d4.1!4d9.2"
    assert [tuple(r) for r in value(places.lat_lng, url, "x/@4.05,9.76,17z", "none")] == [(4.1, 9.2), (4.05, 9.76), (None, None)]


def test_html(value):
    html = ('<html><head><title>T</title></head><body><nav>menu</nav><script>var a="</p>"</script><!-- c --><p>caf&eacute; &#233;'
            '&#x263A; &amp;lt; a < b</p><p>x&nbsp;y</p><footer>f</footer></body></html>')
    assert value(web.visible_text, html, "<p> </p>") == ["café é☺ &lt; a < bx y", None]
    assert value(web.raw_hrefs, """<a class=x href="/a?b&amp;c">t</a><A HREF='d'>u</A><a name=z>v</a><area href="n">""") == [
        ["/a?b&c", "d"]]


def test_truncate(value):
    assert value(lambda c: text.truncate(c, 5), "12345", "123456") == ["12345", "1234…"]
    assert value(text.clean, " x ", "NULL", "n/a", " ") == ["x", None, None, None]


def test_dot_segments_of_links(value):
    from pyspark.sql import functions as F

    got = value(lambda c: web.resolve_url(c, F.lit("https://x.cm/p/q/r.html")), "../../x", "a/../b", "./c", "../../../../y", "/a/./b/../c", "d/..", "e/.")
    assert got == ["https://x.cm/x", "https://x.cm/p/q/b", "https://x.cm/p/q/c", "https://x.cm/y", "https://x.cm/a/c", "https://x.cm/p/q/", "https://x.cm/p/q/e/"]
    assert value(web.clean_url, "x.cm/a/../b", "x.cm/./c", "x.cm/a/%2E%2e/d", "x.cm/..") == ["https://x.cm/b", "https://x.cm/c", "https://x.cm/d", "https://x.cm/"]
