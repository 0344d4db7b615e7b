from entiform.llm import langid as L
from entiform.llm.common import checksum, table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = L.identify(docs, L.fit(docs)).where(checksum("doc_id") % 4 == 2).select("lang", "lang_pred").collect()
    assert len(got) > 150 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97


def test_filters_return_languages():
    grams = [int.from_bytes(bytes([k % 251, k // 251, 7, 1]), "big") for k in range(3000)]
    counts = [("aa", g, 10) for g in grams[:2000]] + [("bb", g, 10) for g in grams[1000:]]
    model = L.build(counts, {"aa": 5, "bb": 5}, 0.6, 3, 12, 3)
    import numpy as np

    masks = model.contains(np.array(grams, np.uint64))[:, 0]
    assert (masks[:1000] & np.uint64(1)).all() and (masks[1000:2000] == 3).all() and (masks[2000:] & np.uint64(2)).all()
    assert (masks[:1000] == 3).mean() < 0.05 and (masks[2000:] == 3).mean() < 0.05


def test_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, "the words of one text and the words", "en", "s"), (2, "les mots de la langue et les mots", "fr", "s"), (3, None, None, None), (4, "", "en", "s"),
         (4, "123 ... !!", None, "s"), (None, "les mots " * 60_000, None, "s")], "doc_id long, text string, lang string, Score string")
    for frame in (docs, docs.limit(0)):
        model = L.fit(frame, folds=1, held_out=5)
        out = L.identify(docs, model)
        assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
        rows = out.collect()
        assert len(rows) == 6
        assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if not any(c.isalpha() for c in r["text"] or ""))
        if model is not None:
            assert {r["lang_pred"] for r in rows if r["text"] and "mots" in r["text"]} == {"fr"}
    assert L.identify(docs.limit(0), L.fit(docs, folds=1, held_out=5)).count() == 0


def test_fifty_languages_of_uneven_size(spark):
    """A made language is a set of syllables; the largest has a hundred times the texts of the smallest, and each keeps its own n-grams."""
    import random

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzàéîõüßøčžþ"
    rows, n = [], 0
    for k in range(50):
        own = ["".join(rng.choice(letters) for _ in range(3)) for _ in range(40)]
        for _ in range(2 + 4 * k):
            rows.append((n, " ".join("".join(rng.choices(own, k=2)) for _ in range(60)), f"l{k:02d}"))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs, folds=1, held_out=5, max_grams=300)
    got = L.identify(docs, model).collect()
    assert len(model.languages) == 50 and all(r["lang"] == r["lang_pred"] for r in got)
