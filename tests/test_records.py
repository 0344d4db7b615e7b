import itertools
import random

import pytest
from pyspark.sql import functions as F

from entiform import schemas
from entiform.operators import records, similarity


def answered(spark, **fields):
    fields = {**{n: None for n in schemas.ANSWER_FIELDS}, **fields}
    sources = fields.pop("sources", [])
    df = spark.createDataFrame([("Akwa Palace", "Douala", "Cameroun", tuple(fields[n] for n in schemas.ANSWER_FIELDS), sources)],
                               f"input_name string, city string, country string, parsed {schemas.ANSWER}, sources array<string>")
    return records.to_records(df, "m", 0.6).first()


def test_records(spark):
    r = answered(spark, name="Akwa Palace")
    assert r.status == "needs_review" and r.owner is None and r.slug == "douala-akwapalace" and r.governance_confidence == 0
    r = answered(spark, owner="Groupe X", management="M. Y", governance_confidence=0.3, sources=["https://example.cm"])
    assert r.status == "needs_review"
    r = answered(spark, name="Hôtel Akwa Palace", owner="État", management="Jean", governance_confidence=0.9, phone="+237 233 42 26 01",
                 email="INFO@AKWA-PALACE.COM", sources=["https://akwa-palace.com"])
    assert (r.status, r.phone_e164, r.email) == ("auto", "+237233422601", "info@akwa-palace.com")
    assert answered(spark, website="www.akwa-palace.com/").website == "https://www.akwa-palace.com"
    assert answered(spark, website="pas une url").website is None
    assert answered(spark, owner="X", governance_confidence=0.9, sources=["not-a-url", "https://ok.cm"]).sources == ["https://ok.cm"]
    r = answered(spark, owner="X", management="Y", governance_confidence=0.95)
    assert r.status == "needs_review" and r.governance_confidence == 0.4


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "slug string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "slug string, v int")
    assert sorted(tuple(r) for r in records.upsert_by_key(old, new).collect()) == [
        ("a", 1, "kept"), ("b", 3, "updated"), ("c", 4, "created")]


def test_target_schema(spark):
    df = spark.createDataFrame([(1,)], "a int")
    records.check_target_schema(df, ["a"])
    with pytest.raises(ValueError, match="b, c"):
        records.check_target_schema(df, ["a", "b", "c"])


WORDS = ["akwa", "palace", "mont", "febe", "lac", "bleu", "onomo", "rive", "jardin", "hotel", "de"]


def names_table(spark, seed, n, make):
    rng = random.Random(seed)
    rows = [(i, make(rng), rng.choice(["Douala", "Kribi"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "task_ord bigint, input_name string, city string").repartition(4)


def tokens(name):
    stop = {"hotel", "de"}
    return frozenset(t for t in name.split() if len(t) >= 2 and t not in stop)


@pytest.mark.parametrize("seed, threshold", [(1, 0.3), (2, 0.6), (3, 0.8), (4, 0.5), (5, 0.95)])
def test_similar_names_equals_brute_force(spark, seed, threshold, monkeypatch):
    monkeypatch.setattr(similarity, "ROWS_PER_SALT", 3)
    rows, df = names_table(spark, seed, 250, lambda r: " ".join(r.choices(WORDS, k=r.randint(1, 7))))
    groups = {}
    for _, name, city in rows:
        if tokens(name):
            key = (city.lower(), " ".join(sorted(tokens(name))))
            groups[key] = groups.get(key, 0) + 1
    want = {}
    for (c1, a), (c2, b) in itertools.combinations(groups, 2):
        if c1 == c2:
            x, y = set(a.split()), set(b.split())
            i = len(x & y)
            s = 0.95 if i in (len(x), len(y)) else i / len(x | y)
            if s >= threshold:
                want[(c1, *sorted([a, b]))] = round(s, 9)
    want.update({(c, a, a): 0.95 for (c, a), n in groups.items() if n > 1})
    got = [((r.city_key, *sorted([r.form_a, r.form_b])), round(r.similarity, 9)) for r in similarity.similar_names(df, threshold).collect()]
    assert len(got) == len(dict(got)) and dict(got) == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed, threshold", [(1, 0.82), (2, 0.6), (3, 0.75), (4, 1.0)])
def test_fuzzy_names_equals_brute_force(spark, seed, threshold, monkeypatch):
    monkeypatch.setattr(similarity, "ROWS_PER_SALT", 3)
    base = ["krystalpalace", "montfebe", "residenceverte", "akwa", "a", "ab", "lacbleudouala"]

    def make(r):
        s = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(s) + 1)
            s[at:at + r.randint(0, 1)] = r.choice(["", "x", "y", "a"])
        return "".join(s)

    rows, df = names_table(spark, seed, 200, make)
    groups = {}
    for _, name, city in rows:
        groups[(city.lower(), name)] = groups.get((city.lower(), name), 0) + 1
    want = {}
    for (c1, a), (c2, b) in itertools.combinations(groups, 2):
        if c1 == c2 and a and b:
            s = 1.0 if a in b or b in a else 1 - distance(a, b) / max(len(a), len(b))
            if s >= threshold - 1e-9:
                want[(c1, *sorted([a, b]))] = round(s, 9)
    want.update({(c, a, a): 1.0 for (c, a), n in groups.items() if n > 1})
    got = [((r.city_key, *sorted([r.form_a, r.form_b])), round(r.similarity, 9)) for r in similarity.fuzzy_name_pairs(df, threshold).collect()]
    assert len(got) == len(dict(got)) and dict(got) == want


def test_thresholds(spark):
    df = spark.createDataFrame([(1, "a", "b")], "task_ord bigint, input_name string, city string")
    with pytest.raises(ValueError):
        similarity.similar_names(df, 0)
    with pytest.raises(ValueError):
        similarity.fuzzy_name_pairs(df, 0.5)


def test_delivery_labels(spark):
    row = (("x", "X") + ("n", "Douala", "Cameroun", None, "699", None, None, None, None, None, 4.05, 9.0, None, None, 0.456, [], "auto", "m", None))
    df = spark.createDataFrame([row], schemas.RECORD)
    out = records.delivery_view(df).first()
    assert (out.phone, out.owner, out.geo, out.confidence, out.status) == ("699", "Non identifié", "4.05, 9", 0.46, "Auto")
    assert len(records.delivery_view(df, labels=True).columns) == 15


def _long_names(seed, count, longest):
    """Names of some lengths around a few bases, each with edits up to a fifth of its length."""
    r = random.Random(seed)
    bases = ["".join(r.choices("abcdefgh", k=n)) for n in (18, 23, 24, 25, 26, 31, 33, 47, 64, longest)]
    out = []
    for _ in range(count):
        s = list(r.choice(bases))
        for _ in range(r.randint(0, len(s) // 5)):
            at = r.randrange(len(s) + 1)
            s[at:at + r.randint(0, 1)] = r.choice(["", "x", "b", "a"])
        if r.random() < 0.2:
            cut = r.randint(0, len(s) // 6)
            s = s[cut:]
        out.append("".join(s))
    return out


@pytest.mark.parametrize("seed, threshold", [(1, 0.82), (2, 0.7), (3, 0.55), (4, 0.9)])
def test_long_fuzzy_names_over_all_cities(spark, seed, threshold):
    made = _long_names(seed, 90, 90)
    df = spark.createDataFrame([(k, n, f"city {k % 7}") for k, n in enumerate(made)], "task_ord bigint, input_name string, city string")
    got = {tuple(sorted([x.form_a, x.form_b])): round(x.similarity, 9) for x in similarity.fuzzy_name_pairs(df, threshold, city=None).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(set(made)), 2):
        s = 1.0 if a in b or b in a else 1 - distance(a, b) / max(len(a), len(b))
        if s >= threshold - 1e-9:
            want[(a, b)] = round(s, 9)
    want.update({(a, a): 1.0 for a in made if made.count(a) > 1})
    assert got == want


def test_rows_of_a_long_name_grow_with_its_length(spark):
    def parts(size):
        name = "".join(random.Random(size).choices("abcdefghijklmnop", k=size))
        df = spark.createDataFrame([("", name, 1, 1, size)], "city_key string, form string, n long, first_ord long, size int")
        edits = lambda c: F.floor(c * (1 - 0.82) + 1e-9).cast("int")
        return sum(x.count() for x in similarity._grams_in_cells(df, ("form", "n", "first_ord", "size"), edits, 0.82))

    assert parts(1_000) < 6_000 and parts(10_000) < 12 * parts(1_000)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85])
def test_similar_names_over_all_cities(spark, threshold):
    r = random.Random(9)
    made = [" ".join(r.choices([f"w{k}" for k in range(30)], k=r.choice((1, 2, 3, 4, 5, 9, 14)))) for _ in range(200)]
    made += [" ".join(r.sample(n.split(), max(1, len(n.split()) - 1))) + r.choice(("", " zz")) for n in made[:80]]
    df = spark.createDataFrame([(k, n, f"city {k}") for k, n in enumerate(made)], "task_ord bigint, input_name string, city string")
    got = [(tuple(sorted([x.form_a, x.form_b])), round(x.similarity, 9)) for x in similarity.similar_names(df, threshold, city=None).collect()]
    forms = [" ".join(sorted(set(n.split()))) for n in made]
    want = {(f, f): 0.95 for f in forms if forms.count(f) > 1}
    for a, b in itertools.combinations(sorted(set(forms)), 2):
        x, y = set(a.split()), set(b.split())
        s = 0.95 if x <= y or y <= x else len(x & y) / len(x | y)
        if s >= threshold - 1e-9:
            want[(a, b)] = round(s, 9)
    assert len(got) == len(dict(got)) and dict(got) == want
    assert similarity.similar_names(df, threshold).count() == 0
