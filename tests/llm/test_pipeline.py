import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as P
from entiform.llm.common import words

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before and after each stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        before = docs.collect()
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((before, docs.collect()))
        assert docs.columns == (COLUMNS if k < 4 else [*COLUMNS, "token_ids", "n_tokens"])
    return out


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_toxic_documents_go(spark, steps):
    before, after = steps[0]
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    assert kept <= {r["doc_id"] for r in before}
    judged = [(r["doc_id"] in kept) == (not toxic[r["doc_id"]]) for r in before if r["doc_id"] in toxic]
    assert sum(judged) / len(judged) > 0.9


def test_boilerplate_goes(steps):
    before, after = steps[1]
    pages, seen = Counter(r["source"] for r in before), Counter()
    for r in before:
        seen.update({(r["source"], x.strip(" ")) for x in r["text"].split("\n") if x.strip(" ")})
    want = {}
    for r in before:
        want[r["doc_id"]] = "\n".join(x for x in r["text"].split("\n") if seen[r["source"], x.strip(" ")] < max(5, 0.05 * pages[r["source"]]))
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] != next(b["text"] for b in before if b["doc_id"] == r["doc_id"]))


def test_one_of_near_copies_stays(steps):
    before, after = steps[2]
    sets, up = {r["doc_id"]: shingles(r["text"]) for r in before}, {r["doc_id"]: r["doc_id"] for r in before}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if b < a and both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and up[a] != up[b]:
                low, high = sorted((up[a], up[b]))
                up = {k: low if v == high else v for k, v in up.items()}
    assert sorted(r["doc_id"] for r in after) == sorted(i for i in sets if up[i] == i)
    assert {r["doc_id"]: r["text"] for r in after}.items() <= {r["doc_id"]: r["text"] for r in before}.items()


def test_contaminated_documents_go(spark, steps):
    before, after = steps[3]
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = [r["doc_id"] for r in before if not any(q and len(q & shingles(r["text"])) >= 0.8 * len(q) for q in items)]
    assert sorted(r["doc_id"] for r in after) == sorted(want) and len(want) < len(before)


def test_tokens(steps):
    before, after = steps[4]
    library = Tokenizer.from_file(P.TOKENIZER)
    library.no_truncation()
    assert len(before) == len(after)
    for r in after:
        assert r["token_ids"] == library.encode(r["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["token_ids"])


def test_run_equals_stages(spark, steps):
    assert sorted(map(str, P.run(spark, FOLDER).collect())) == sorted(map(str, steps[4][1]))


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "some words of a text that stay here", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS score", "2 AS key", "3 AS hits")
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() == 4, name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_contaminated_rows_without_or_with_shared_ids(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    rows = [(None, f"x {item} y", None, "a", 1), (None, "a clean text without an id", None, "a", 1), (7, item, "en", "b", 1), (7, "a clean text of the same id", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["text"] for r in P.drop_contaminated(spark, docs, FOLDER).collect()) == sorted([rows[1][1], rows[3][1]])


def test_all_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14)) and "pipeline" in entry.queries()
