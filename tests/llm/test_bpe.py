import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from entiform.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "aa", "th", "e", "'s", "'", "’", "!", "!!", "ß", "é", "Σ", "ΑΣ", "İ", " ", "\n", "\t", "\x85", "1", "½", "中", "😀", "<|endoftext|>", "<|", "ll", "'RE",
          "ſ", "ﬁ", "\x00", "_", "-", "...", "न", "́", "​", "\xa0", "　"]


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


def test_equals_library_on_random_texts(library):
    automaton, rng = bpe.compile_file(PATH), random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(25))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdehinorst") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["a" * k for k in range(1, 90)] + ["ab" * k for k in range(40)] + ["!" * k for k in range(60)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        got = automaton.encode(text)
        assert got == want.ids
        assert automaton.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_every_character_as_in_the_library(library):
    automaton = bpe.compile_file(PATH)
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000] + sorted(automaton.odd)
    assert automaton.odd.isdisjoint(map(chr, range(0x250)))
    texts = [" ".join(f"a{c}b{c}{c}1" for c in points[k:k + 40]) for k in range(0, len(points), 40)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        got = automaton.encode(text)
        assert got == want.ids
        assert automaton.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_one_state_at_each_place(library):
    """Each beginning of a word is spelled by one path, and encoding never leaves it."""
    automaton, rng = bpe.compile_file(PATH), random.Random(8)
    for _ in range(300):
        word = "".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 7)))
        paths = [[]]
        for at in range(1, len(word) + 1):
            found = []
            for start in range(at):
                t = (automaton.ending if at == len(word) else automaton.arc).get(word[start:at])
                if t is not None and (not start or automaton.follows(paths[start][-1], t)):
                    found.append([*paths[start], t])
            assert len(found) == 1
            paths += found
        assert automaton.walk(word) == tuple(paths[-1]) == tuple(library.encode(word, add_special_tokens=False).ids)


def test_long_text_takes_linear_time(library):
    automaton, text = bpe.compile_file(PATH), "x" * 30_000 + " " + "word " * 30_000
    assert automaton.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_tables(spark, library):
    rows = [(1, "Hello world's", "x"), (1, "Hello world's", "x"), (None, None, None), (2, "", "y"), (3, "<|endoftext|>", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Decoded string")
    out = bpe.encode(df, PATH, decoded="decoded")
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    for r in out.collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    again = bpe.decode(out.select("doc_id", "token_ids", "decoded"), PATH, into="decoded")
    assert sorted(r["decoded"] for r in again.collect()) == sorted(r["decoded"] for r in out.collect())
    assert bpe.encode(df.limit(0), PATH).count() == 0
