import random
import time

import numpy as np
import pytest

from entiform.llm import html_extract as H

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name</h1><nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav></header>
<div id="cookie-banner"><p>We use cookies to make this site better, please accept all of them.</p><button>Accept</button></div>
<div class="wrap"><div class="post-body"><h2>The headline</h2><p>First paragraph of the story with <a href=x>one link</a>&nbsp;&amp; more
words, many   of them.</p><div class="ad-slot"><p>Buy our new shoes today, now cheaper than ever before!</p></div><p>Second paragraph, long enough to be
main text of the page, and so on.</p></div><aside class="sidebar"><h3>Related</h3><ul><li><a href=1>Other story one</a></li></ul></aside></div>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this story at all, because it is wrong in many ways.</p></div></section>
<form><label>Your mail</label><input><p>Subscribe to our newsletter for more.</p></form><footer><p>&copy; 2024 Site.</p></footer></body></html>"""
STORY = ("The headline\nFirst paragraph of the story with one link & more words, many of them.\n"
         "Second paragraph, long enough to be main text of the page, and so on.")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return H.fit(pages)


def test_strange_layout(model):
    assert model.texts([PAGE]) == [STORY]


def test_marked_pages(pages, model):
    raw = [r["html"] for r in pages.orderBy("page_id").limit(120).collect()]
    for text, got in zip(raw, model.texts(raw)):
        page = H.Page(text)
        assert got == "\n".join(t for t, v in zip(page.text, H.marked(page)) if t and v)


def test_layouts_not_seen(pages, model):
    rng = random.Random(99)
    texts = [[t for t, v in zip(p.text, H.marked(p)) if t and v] for p in (H.Page(r["html"]) for r in pages.orderBy("page_id").limit(60).collect())]
    layouts, missed, extra, total = H.Layouts(rng, [t for ts in texts for t in ts]), 0, 0, 0
    for k in range(150):
        page, y = layouts.labelled(texts[k % 60][:rng.randint(1, 9)])
        x, parent, _ = H.features([page], model.worth)
        size, kept = np.array([len(t) for t in page.text]), H.decode(parent, model.trees.log_odds(x))
        missed, extra, total = missed + (size * (~kept & (y > 0))).sum(), extra + (size * (kept & (y == 0))).sum(), total + (size * (y > 0)).sum()
    assert missed / total < 0.03 and extra / total < 0.03


def test_decoding_never_contradicts():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        parent = np.array([-1] + [int(rng.integers(0, k)) for k in range(1, n)])
        odds = rng.normal(size=n)
        kept = H.decode(parent, odds)
        assert all(parent[k] < 0 or kept[parent[k]] for k in np.flatnonzero(kept))
        best = max(sum(odds[k] for k in range(n) if m >> k & 1) for m in range(1 << n) if all(not m >> k & 1 or parent[k] < 0 or m >> int(parent[k]) & 1 for k in range(n)))
        assert abs(odds[kept].sum() - best) < 1e-9


def test_odd_pages(spark, model):
    df = spark.createDataFrame(
        [(1, "u", None), (2, "u", ""), (2, "u", ""), (None, None, "no tags at all, but a sentence of some length."), (3, "v", "<p>" * 3000 + "deep"), (4, "w", "<div class='"), (5, "x", "&#x110000;&bogus;<!-- ")],
        "page_id long, url string, html string").selectExpr("*", "'old' AS Text")
    out = H.extract(df, model)
    assert out.columns == ["page_id", "url", "html", "text"]
    got = out.collect()
    assert len(got) == 7 and all(r["text"] is not None for r in got)
    assert [r["text"] for r in got if not r["html"]] == ["", "", ""]
    empty = H.extract(df.limit(0), H.fit(df.limit(0)))
    assert empty.count() == 0


@pytest.mark.parametrize("mark, inside", [
    ('<svg viewBox="0 0 1 1"/>', ""), ("<math/>", ""), ("<svg><path/><title/><style/></svg>", ""), ("<svg><path/>", ""), ("<canvas></canvas>", ""),
    ("<math><mi>E</mi><mo>=</mo><mi>m</mi></math>", "E=m"), ("<object data=x>fallback text of it</object>", "fallback text of it"), ("<object data=x>", ""),
    ("<select><option>A choice", "A choice"), ("<select><option>A choice</select>", "A choice"), ("<canvas>drawn words</canvas>", "drawn words"),
    ("<svg><text>label of it</text></svg>", "label of it"), ("<template><p>inert</p><template>x</template><p>inert</p></template>", ""), ("<template>", ""),
    ("<svg><foreignObject><p>foreign words</p></foreignObject></svg>", "foreign words"), ("<script>no()</script>", ""), ("<textarea>typed</textarea>", "")])
def test_embedded_elements(mark, inside):
    page = H.Page(f"<article><p>One {mark}</p><p>Two</p><p>Three</p></article>")
    assert "".join(page.text).replace(" ", "") == f"One{inside}TwoThree".replace(" ", "")
    assert [t for t in page.text if t][-2:] == ["Two", "Three"] and (inside or page.tag.count("#text") == 3)
    assert all(p < k for k, p in enumerate(page.parent))


def test_text_behind_embedded_elements(model):
    story = STORY.split("\n")
    for mark in ("<svg/>", "<math/>", "<object data=x>", "<svg><path/>", "<template>", "<math><mi></mi></math>"):
        got = model.texts([PAGE.replace('<h2>The headline</h2>', f'<h2>The headline</h2>{mark}')])[0]
        assert all(line in got for line in story), mark
    whole = PAGE.replace("words, many   of them.", "words, <math><mi>x</mi></math> many of <svg><path/></svg> them.")
    assert "more words, x many of them." in model.texts([whole])[0]


def test_tokens_and_marked_sample(spark, monkeypatch):
    names = " ".join(f"u-{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    assert "comments" in H.Page(f'<div class="{names} comments">x</div>').tokens[1]
    rows = [(k, "<article><p>Marked %d</p></article>" % k if k % 50 == 0 else f"<div><p>Plain {k}</p></div>") for k in range(1_000)]
    monkeypatch.setattr(H, "train", lambda pages: pages)
    got = H.fit(spark.createDataFrame(rows, "page_id long, html string"), fit_pages=12)
    assert len(got) == 12 and all("Marked" in p for p in got)
    assert len(H.fit(spark.createDataFrame(rows, "page_id long, html string").repartition(7), fit_pages=80)) == 20


@pytest.mark.parametrize("unit", [
    "<div>", "<div><p>x", "<template>", "<select><option>x", "<a b='", '<a b="x>', "<a ", "<a", "<object>t", "<object><math></math>", "<!--", "<script>x</script", "<table><tr><td>x",
    "<svg><p>", "<svg><foreignObject>", "<ul><li>x", "</div "])
def test_reading_takes_linear_time(unit):
    def seconds(n):
        start = time.process_time()
        H.Page(unit * n)
        return time.process_time() - start

    seconds(100)
    small = min(seconds(10_000) for _ in range(2))
    assert seconds(80_000) < 8 * small * 3 + 0.5


@pytest.mark.parametrize("page, texts", [
    ("<p>a</p><p title='no end>b</p><p>c</p>", ["a", "b", "c"]), ('<p title="5" tall">b</p>c', ["b", "c"]), ("<p x='a>b'>c</p>", ["c"]), ("<p x = \"a>b\" y>c", ["c"]),
    ("a<!-->b<!--->c<!-- x --!>d<!-- e", ["abcd"]), ("a <p b", ["a"]), ("1 < 2 <3 </ 4", ["1 < 2 <3 </ 4"]), ("<xmp>a <b>&amp;</b></xmp>c", ["a <b>&amp;</b>", "c"]),
    ("<script>x</script\n>a<style>b</style x>c", ["ac"]), ("&#" + "9" * 5000 + ";&#" + "0" * 5000 + "65;&#0;&#66;", ["�A�B"]),
    ("<template><p>a</template>b<template>c", ["bc"]), ("<DIV HIDDEN=''>a</DIV>", ["a"])])
def test_damaged_markup(page, texts):
    assert [t for t in H.Page(page).text if t] == texts


def test_hidden_marks():
    assert [H.Page(f"<div {a}>x</div>").hidden[1] for a in ("hidden", "hidden=''", "HIDDEN", "style='display: none'", "data-hidden", "title='hidden'", "")] == [True] * 4 + [False] * 3


def test_very_long_page(model):
    story = "".join(f"<p>Sentence number {k} of a very long article, with enough words to be main text.</p>" for k in range(20_000))
    got = model.texts([PAGE.replace('<div class="ad-slot">', story + '<div class="ad-slot">')])[0].split("\n")
    assert len(got) == 20_003 and got[2].startswith("Sentence number 0 ")
    assert model.texts(["<div>" * 50_000 + "deep" + "</div>" * 50_000])[0] in ("", "deep")
