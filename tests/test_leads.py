import random

import pytest
from pyspark.sql import functions as F

from entiform import fixed, schemas
from entiform.operators import chains, dedup, leads as L, merge
from entiform.functions.storage import Scratch

RAW = "ord bigint, source string, company_name string, city string, phone_raw string, website_url string, email string"


def raw(spark, *rows):
    fields = [f.split()[0] for f in RAW.split(", ")]
    data = [tuple({"ord": i, "source": "google-maps", "city": "Douala", **r}.get(f) for f in fields) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, RAW)


def test_normalise(spark):
    rows = L.normalize_leads(raw(
        spark, {"company_name": "Hôtel X", "city": "dla", "phone_raw": "699000000"}, {"company_name": "Hôtel X", "city": "DOUALA"},
        {"company_name": "Y", "city": "Kribi", "website_url": "exemple.cm/contact", "email": "Write to Contact@Exemple.CM please"},
    )).orderBy("ord").collect()
    assert rows[0].city == "Douala" and rows[0].phone_normalized == "+237699000000" and rows[0].phone_valid
    assert rows[0].id == rows[1].id == "google-maps_" + rows[0].id.split("_")[1] and len(rows[0].id.split("_")[1]) == 16
    assert rows[2].website_url == "https://exemple.cm/contact" and rows[2].email == "contact@exemple.cm"
    assert rows[0].emails == [] and rows[0].contacts == [] and rows[0].reviews is None


def test_lead_id_is_the_published_hash(spark):
    import hashlib

    row = L.normalize_leads(raw(spark, {"company_name": " Hôtel  X ", "city": "Yaoundé"})).first()
    assert row.id == "google-maps_" + hashlib.sha1("google-maps|hôtel x|yaounde".encode()).hexdigest()[:16]


def test_fallback_city_per_row(spark):
    df = raw(spark, {"company_name": "A", "city": None}, {"company_name": "B", "city": " "}).withColumn("fallback_city", F.lit("dla"))
    assert [r.city for r in L.normalize_leads(df).collect()] == ["Douala", "Douala"]


def test_stats_and_rejects(spark):
    received = raw(spark, {"company_name": "Hôtel A"}, {"company_name": "HOTEL A", "city": "douala"}, {"company_name": ""},
                   {"company_name": "Hôtel B", "city": "Yaoundé"})
    valid, rejects = L.validate_leads(L.normalize_leads(received))
    assert [r.reject_reasons for r in rejects.collect()] == [["company_name"]]
    stats = L.lead_stats(received, rejects, dedup.dedup_decisions(valid)).first()
    assert tuple(stats) == (4, 1, 1, 2)
    assert sorted(r.company_name for r in dedup.dedup_entities(valid).collect()) == ["Hôtel A", "Hôtel B"]


def test_one_bad_contact_rejects(spark):
    contact = "struct<full_name:string,role:string,title_raw:string,email_direct:string,phone_direct:string,linkedin_url:string,confidence:double>"
    df = spark.sql(f"""SELECT * FROM VALUES
      (0L, 's', 'A', array(named_struct('full_name','Jo','role',null,'title_raw','DG','email_direct',null,'phone_direct',null,'linkedin_url',null,'confidence',null))),
      (1L, 's', 'B', array(named_struct('full_name',' ','role',null,'title_raw',null,'email_direct',null,'phone_direct',null,'linkedin_url',null,'confidence',null))),
      (2L, 's', 'C', array(named_struct('full_name','Jo','role','BOSS','title_raw',null,'email_direct',null,'phone_direct',null,'linkedin_url',null,'confidence',2.0D)))
      AS t(ord, source, company_name, contacts)""").withColumn("contacts", F.col("contacts").cast(f"array<{contact}>"))
    valid, rejects = L.validate_leads(L.normalize_leads(df))
    good = valid.first()
    assert good.contacts[0].role == "GENERAL_MANAGER" and good.contacts[0].confidence == 1.0
    assert {r.ord: r.reject_reasons for r in rejects.collect()} == {1: ["contact_name"], 2: ["contact_role", "contact_confidence"]}


@pytest.mark.parametrize("second, duplicate, reason", [
    ({"company_name": "HOTEL AKWA PALACE", "city": "DOUALA"}, True, "name+city"),
    ({"company_name": "Autre Nom", "city": "Kribi", "phone_raw": "+237 699 001 122"}, True, "phone"),
    ({"company_name": "Y", "city": "Limbé", "website_url": "http://hotel-x.cm"}, True, "website"),
    ({"company_name": "Hôtel B"}, False, None),
])
def test_dedup_signals(spark, second, duplicate, reason):
    first = {"company_name": "Hôtel Akwa Palace", "phone_raw": "6 99 00 11 22", "website_url": "https://www.hotel-x.cm/accueil"}
    rows = dedup.dedup_decisions(L.normalize_leads(raw(spark, first, second))).orderBy("ord").collect()
    assert (rows[1].duplicate, rows[1].reason) == (duplicate, reason)
    assert rows[1].matched_id == (rows[0].id if duplicate else None)


def model(keys):
    """Sequential rules, one row at a time."""
    owners, out = {}, {}
    for ord_, *ks in sorted(keys):
        hit = next(((s, owners[(s, k)]) for s, k in enumerate(ks) if k is not None and (s, k) in owners), None)
        out[ord_] = hit
        if hit is None:
            owners.update({(s, k): ord_ for s, k in enumerate(ks) if k is not None})
    return out


@pytest.mark.parametrize("seed, rows, values, hot", [(1, 60, 12, 0), (2, 400, 60, 0), (3, 400, 150, 0.4), (4, 40, 40, 0)])
def test_rounds_equal_the_sequential_rules(spark, seed, rows, values, hot):
    rng = random.Random(seed)

    def key():
        if rng.random() < 0.25:
            return None
        return "hot" if rng.random() < hot else str(rng.randrange(values))

    data = [(i, f"id{i}", key(), key(), key()) for i in rng.sample(range(rows * 3), rows)]
    if seed == 4:  # a chain: each row shares a key with the next
        data = [(i, f"id{i}", None, f"p{(i + 1) // 2}", f"d{i // 2}") for i in range(rows)]
    keys = spark.createDataFrame(data, "ord bigint, id string, k1 string, k2 string, k3 string").repartition(5)
    scratch = Scratch(spark, "test")
    owners = dedup.resolve_owners(keys, scratch, hot_keys=2)
    got = dedup.decide(keys, dedup.with_owner_ids(owners, keys)).collect()
    want = model([(o, a, b, c) for o, _, a, b, c in data])
    names = {None: None, **{o: f"id{o}" for o in want}}
    assert {r.ord: (r.duplicate, r.reason, r.matched_id) for r in got} == {
        o: (h is not None, dedup.SIGNALS[h[0]] if h else None, names[h[1] if h else None]) for o, h in want.items()}


def test_dedup_with_large_side_paths(spark, monkeypatch):
    """The paths for owners too large to broadcast give the same decisions."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_rounds_equal_the_sequential_rules(spark, 5, 200, 40, 0.4)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chains(spark):
    rows = chains.detect_chains(L.normalize_leads(raw(
        spark, {"company_name": "Hilton Yaoundé", "city": "Yaoundé"}, {"company_name": "Hôtel La Falaise"},
        {"company_name": "Auberge du Lac", "city": "Kribi"}, {"company_name": "Hôtel Zénith"}, {"company_name": "ZENITH Resort", "city": "Kribi"},
        {"company_name": "Hotel", "city": "Kribi"}))).orderBy("ord").collect()
    assert [(r.chain.is_chain, r.chain.name) for r in rows] == [
        (True, "Hilton"), (True, "La Falaise"), (False, None), (True, "Hôtel Zénith"), (True, "Hôtel Zénith"), (False, None)]


def test_patch(spark):
    base = L.normalize_leads(raw(spark, {"company_name": "Hôtel Test", "email": "contact@test.cm"}, {"company_name": "Other"}))
    lead = base.orderBy("ord").first()
    patch = spark.createDataFrame(
        [(lead.ord, ["contact@test.cm", "reservation@test.cm"], ["+237699000000"], {"facebook": "https://facebook.com/test"}, "valid",
          "autre@test.cm", {"a": "1"})],
        f"ord bigint, emails array<string>, phones array<string>, socials {schemas.SOCIALS}, email_status string, email string, metadata map<string,string>")
    first, other = merge.apply_patch(base, patch, "website").orderBy("ord").collect()
    assert first.email == "contact@test.cm" and first.emails == ["contact@test.cm", "reservation@test.cm"]
    assert first.socials.facebook == "https://facebook.com/test" and first.email_status == "valid"
    assert first.enriched_by == ["website"] and first.metadata == {"a": "1"} and other.enriched_by == []


def test_patches_do_not_multiply_leads_with_one_id(spark):
    base = L.normalize_leads(raw(spark, {"company_name": "Hotel"}, {"company_name": "Hotel"})).withColumn("id", F.lit("same"))
    for stage in ("website", "email"):
        patch = base.select("ord", F.concat(F.lit("n"), F.col("ord").cast("string")).alias("legal_name"))
        base = merge.apply_patch(base, patch, stage)
    assert sorted((r.ord, r.legal_name) for r in base.collect()) == [(r, f"n{r}") for r in sorted(x.ord for x in base.collect())]
    assert base.count() == 2


def test_merge_contacts(spark):
    def c(name, email=None, confidence=1.0, role="OTHER"):
        return (name, role, None, email, None, None, confidence)

    df = spark.createDataFrame([([c("Jean K", "j@x.cm", 0.9), c("Awa")], [c("JEAN K", "", 0.5, "OWNER"), c("Luc", "l@x.cm")])],
                               f"a array<{schemas.CONTACT}>, b array<{schemas.CONTACT}>")
    got = df.select(merge.merge_contacts(F.col("a"), F.col("b")).alias("m")).first().m
    assert [(m.full_name, m.role, m.email_direct, m.confidence) for m in got] == [
        ("JEAN K", "OWNER", "j@x.cm", 0.9), ("Awa", "OTHER", None, 1.0), ("Luc", "OTHER", "l@x.cm", 1.0)]


def test_delivery_columns(spark):
    df = L.normalize_leads(raw(spark, {"company_name": "Hôtel Akwa Palace"}))
    row = L.flatten_leads(df).first()
    assert row.asDict().keys() == {k for k, _ in fixed.FLAT_COLUMNS} and len(fixed.FLAT_COLUMNS) == 28
    assert row.contact_name == "" and row.google_rating == ""


def test_empty_options(spark):
    with pytest.raises(ValueError):
        L.search_grid([" "], spark.createDataFrame([("x",)], "location string"))
    with pytest.raises(Exception, match="no city in"):
        L.city_refs(spark.createDataFrame([(" :Gabon",)], "spec string")).collect()


def test_work_folder_comes_from_the_session(spark, tmp_path):
    from entiform.functions.storage import Scratch, work_dir

    named = str(tmp_path / "shared")

    class Conf:
        def get(self, key, default=None):
            return named if key == "spark.checkpoint.dir" else default

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    assert work_dir(Session()) == named and Scratch(Session(), "x").path.startswith(named)


def test_lookups_with_large_facts(spark):
    """Chains and email verdicts through the path for facts too large to broadcast."""
    import test_extract

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_chains(spark)
        test_extract.test_email_verdicts(spark)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("seed, group_rows", [(1, 15), (2, 60)])
def test_components_equal_the_sequential_rules(spark, seed, group_rows):
    """Rounds, then components that do not fit into one task."""
    rng = random.Random(seed)
    data = [(i, f"id{i}", *[rng.choice([None, "hot" if rng.random() < 0.2 else str(rng.randrange(60))]) for _ in range(3)]) for i in rng.sample(range(600), 120)]
    data += [(1000 + i, f"id{1000 + i}", None, f"p{(i + 1) // 2}", f"d{i // 2}") for i in range(24)]
    keys = spark.createDataFrame(data, "ord bigint, id string, k1 string, k2 string, k3 string").repartition(3)
    got = {(r.signal, r.key): r.ord for r in dedup.resolve_owners(keys, Scratch(spark, "test"), hot_keys=2, group_rows=group_rows).collect()}
    accepted = {o for o, hit in model([(o, a, b, c) for o, _, a, b, c in data]).items() if hit is None}
    assert got == {(s, k): o for o, _, *ks in data if o in accepted for s, k in enumerate(ks, 1) if k is not None}


def test_a_long_chain_takes_few_jobs(spark):
    """100,000 rows, each of which waits for the one before."""
    n = 100_000
    keys = spark.range(n).selectExpr("id AS ord", "concat('id', id) AS id", "CAST(NULL AS string) AS k1", "concat('p', floor((id + 1) / 2)) AS k2", "concat('d', floor(id / 2)) AS k3")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        owners = dedup.resolve_owners(keys, Scratch(spark, "test"))
        assert len(tracker.getJobIdsForGroup("chain")) < 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    accepted = owners.select("ord").distinct()
    assert accepted.count() == n // 2 and accepted.where("ord % 2 = 0").count() == n // 2
