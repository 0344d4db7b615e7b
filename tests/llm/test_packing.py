import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from entiform.functions.storage import Scratch
from entiform.llm import packing as K
from entiform.llm.queries import op11_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def fewest(sizes, capacity):
    """Fewest sequences, by trying all ways."""
    sizes, best = sorted(sizes, reverse=True), len(sizes)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for r in {x for x in rooms if x >= sizes[k]}:
            at = rooms.index(r)
            put(k + 1, rooms[:at] + [r - sizes[k]] + rooms[at + 1:])
        put(k + 1, [*rooms, capacity - sizes[k]])

    put(0, [])
    return best


def check_packing(rows, capacity):
    """rows: (sequence, offset, length); every sequence is gapless from 0 and within the capacity."""
    held = {}
    for s, o, n in rows:
        held.setdefault(s, []).append((o, n))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(held)


def test_bound_and_best_fit_against_all_packings():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        sizes = np.array([rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))])
        want = fewest(sizes.tolist(), capacity)
        seq, off, rooms = K.best_fit(sizes, capacity)
        used = check_packing(list(zip(seq.tolist(), off.tolist(), sizes.tolist())), capacity)
        assert K.bound(*np.unique(sizes, return_counts=True), capacity) <= want <= used == len(rooms)
        assert rooms.tolist() == [capacity - sizes[seq == k].sum() for k in range(len(rooms))]


def test_best_fit_is_best_fit():
    def plain(sizes, capacity):
        rooms = []
        for n in sorted(sizes, reverse=True):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms[rooms.index(min(fit))] -= n
            else:
                rooms.append(capacity - n)
        return sorted(rooms)

    rng = np.random.default_rng(5)
    for _ in range(40):
        sizes = rng.integers(1, 101, rng.integers(1, 400))
        assert sorted(K.best_fit(sizes, 100)[2].tolist()) == plain(sizes.tolist(), 100)


def test_ids_equal_the_library(library):
    encoder, rng = K.ByteEncoder(PATH), random.Random(8)
    marks = [chr(c) for c in range(1, 0x250)] + list("中文אبя‐‧€ \U0001f600՘") + ["the ", "  ", "\n", "'s", "<|endoftext|>", "12", "Don't"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(50))) for _ in range(1500)] + ["a" * 60_000, " " * 60_000, "\n\n x" * 20_000, "é" * 5_000]
    for t in texts:
        assert encoder(t).tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("part_rows, seed", [(40, 1), (1000, 2), (7, 3)])
def test_parts_exchange_until_certified(spark, part_rows, seed):
    rng = random.Random(seed)
    sizes = [(k, rng.choice([100, rng.randrange(1, 101), rng.randrange(30, 70)])) for k in range(600)]
    scratch = Scratch(spark, "test")
    stored = scratch.write(spark.createDataFrame(sizes, "pid long, length long").repartition(4), "sizes")
    placed, rounds = K.assign(stored, 100, scratch, part_rows)
    rows, length = placed.collect(), dict(sizes)
    assert sorted(r["pid"] for r in rows) == list(range(600))
    used = check_packing([(r["sequence_id"], r["offset"], length[r["pid"]]) for r in rows], 100)
    whole = sum(n == 100 for _, n in sizes)
    assert used == whole + rounds[-1]["sequences"] and all(r["sequences"] >= r["bound"] for r in rounds)
    one = K.best_fit(np.array([n for _, n in sizes if n < 100]), 100)[2]
    counts = [r["sequences"] for r in rounds]
    assert counts == sorted(counts, reverse=True) and (counts[-1] < counts[0] or rounds[0]["parts"] == 1)
    assert counts[-1] <= len(one) * (1.03 if part_rows > 7 else 1.2)


def test_query_on_a_table(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    rows = op11_packing(spark, FOLDER).collect()
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in docs}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for k, want in ids.items():
        parts = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts))) and len(parts) == -(-len(want) // 1024)
        at = 0
        for p in parts:
            assert p["start"] == at and (p["length"] == 1024 or p["piece"] == 0)
            part = np.array(want[at:at + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
            at += p["length"]
        assert at == len(want)
    used = check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 1024)
    sizes = np.array([r["length"] for r in rows])
    assert used <= K.bound(*np.unique(sizes, return_counts=True), 1024) + 1


def test_odd_rows_and_sequences(spark, library):
    rows = [(1, "a b c", 1), (1, "a b c", 1), (None, None, 2), (None, "", 3), (2, "word " * 5000, 4), (3, "x" * 30_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int").selectExpr("*", "1 AS pid", "2 AS Length", "3 AS offset", "4 AS sequence_id")
    packed, _ = K.pack(docs, PATH, 64)
    got = packed.collect()
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "token_ids", "sequence_id", "offset"]
    assert sum(r["length"] for r in got) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert sorted((r["length"], r["token_ids"]) for r in got if r["doc_id"] is None) == [(1, [2]), (1, [2])]
    joined = {r["sequence_id"]: r["token_ids"] for r in K.sequences(packed).collect()}
    assert all(joined[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["token_ids"] for r in got) and all(len(x) <= 64 for x in joined.values())
    empty, rounds = K.pack(docs.limit(0), PATH, 64)
    assert empty.count() == 0 and rounds == []


def test_texts_together_get_the_ids_of_the_library(library, monkeypatch):
    rng = random.Random(11)
    marks = ["'", "'s", "'re", "'ve", "'ll", "'LL", "x", "é", "1", "½", " ", "  ", "\n", "\t ", "\xa0", "\x1c", "!", "…", "-'d ", "\U0001f600", " ", "中", "<|endoftext|>", "word"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(3000)] + ["", " ", "'", "'r", "a" * 5_000, "b " * 40 + " " * 3_000, ""]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = K.ByteEncoder(PATH)
    assert [x.tolist() for x in encoder.many(texts)] == want
    with monkeypatch.context() as m:  # long texts in parts
        m.setattr(K, "TOGETHER", 5)
        assert [x.tolist() for x in encoder.many(texts)] == want
    plain = [k for k, t in enumerate(texts) if len(t) < 1_000]  # no word for the other library
    assert [x.tolist() for x in encoder.many([texts[k] for k in plain])] == [want[k] for k in plain]
    assert encoder.many([]) == []


def test_a_word_is_spelled_once_for_all_texts(library, monkeypatch):
    import tiktoken

    asked, given = [], tiktoken.Encoding.encode_to_numpy
    monkeypatch.setattr(tiktoken.Encoding, "encode_to_numpy", lambda self, text, **options: asked.append(len(text)) or given(self, text, **options))
    texts = ["Thlyouble onntshansh, Ndesat's öninganing ershnted 1234\n" * 20] * 50
    got = K.ByteEncoder(PATH).many(texts)
    want = library.encode(texts[0], add_special_tokens=False).ids
    assert all(x.tolist() == want for x in got)
    assert sum(asked) < 2 * len(texts[0]) // 20


def test_slices_hold_all_rows_and_few_bytes(monkeypatch):
    monkeypatch.setattr(K, "TOGETHER", 100)
    texts = [None, "", "é" * 30, "a" * 500, None, *["b" * 30] * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = list(K._together([batch, batch.slice(0, 0)]))
    assert [r for b in got for r in b.column(0).to_pylist()] == list(range(len(texts)))
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 130 for b in got if "a" * 500 not in b.column(1).to_pylist())
