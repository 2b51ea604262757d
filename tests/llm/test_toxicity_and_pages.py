"""Held-out accuracy of the toxicity classifier, and page extraction."""

import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tieout.llm import pages, toxicity
from tieout.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in QUERIES["op1_toxicity"](spark, folder).collect()}
    assert len(rows) == pq.read_table(f"{folder}/documents.parquet", columns=["doc_id"]).num_rows
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for k, r in rows.items())
    out = [(rows[k]["predicted"], y) for k, y in labels.items() if rows[k]["held_out"]]
    hit = sum(p == y == 1 for p, y in out)
    assert hit / sum(y for _, y in out) >= 0.8 and hit / sum(p for p, _ in out) >= 0.9


def test_fit_is_of_both_classes_or_the_share():
    texts = ["you are a moron and scum", "what a lovely day"] * 30
    model = toxicity.fit(texts, np.array([1, 0] * 30, bool), 0.5)
    z = toxicity.sums(model, pa.array(["such a moron", "a lovely garden", "", None])) + model.intercept
    assert z[0] > z[1] and z[2] == z[3]
    one = toxicity.fit(texts, np.zeros(60, bool), 0.01)
    assert not one.weights.any() and abs(1 / (1 + np.exp(-one.intercept)) - 0.01) < 1e-9


def test_toxicity_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "moron", "c"), (3, "x " * 100_000, None), (3, "x " * 100_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (77, 0)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    out = toxicity.score(df, model, whole=True, name="p").collect()
    assert len(out) == 5 and all(0 <= r["p"] <= 1 for r in out) and {r["score"] for r in out} == {"a", "b", "c", None}
    none = toxicity.train(df, labels.filter("false"))
    assert {r["score"] for r in toxicity.score(df.select("doc_id", "text"), none).collect()} == {0.5}
    assert toxicity.score(df.filter("false"), toxicity.train(df.filter("false"), labels)).count() == 0


def article(page):
    """What the marked article of a generated page holds."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", inner.replace("<br>", " "))
    return "\n\n".join(t for t in (" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in parts) if t)


def test_pages_query(spark):
    folder = "/root/testdata/sf0.01"
    want = {r["page_id"]: (r["url"], article(r["html"])) for r in pq.read_table(f"{folder}/pages.parquet").to_pylist()}
    rows = QUERIES["op3_main_text"](spark, folder).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r["url"], r["text"], r["n_chars"]) == (*want[r["page_id"]], len(want[r["page_id"]][1]))


def test_wrapper_without_marked_article():
    chance = random.Random(1)
    words = lambda n: " ".join(chance.choice("lorem ipsum dolor sit amet non est vero quod".split()) + str(chance.randint(0, 99)) for _ in range(n))
    made, want = [], []
    for i in range(12):
        title, body, extra = words(4), [words(20) for _ in range(1 + i % 4)], words(6)
        want.append("\n\n".join([title, *body]))
        made.append(
            f"<html><body><div class=top><p>Welcome to our site</p><ul><li><a href=/>Home</a><li><a href=/b>{words(1)}</a></ul></div>"
            f"<div class='x1'><h2>{title}</h2>{''.join(f'<p>{b}' for b in body)}<p>Share this story with your friends</p></div>"
            f"<div id=comments><p>{extra}</p></div><div class='site-footer footer'><p>{words(3)}</p></div><form><p>{words(3)}</p></form></body>"
        )
    assert pages.extract(made) == want


def test_details_of_pages():
    assert pages.extract([None, "", "plain &amp; text", "<p>a<p>b\n c&nbsp;d<br>e<b>f</b>g", "<script>x</script><style>p</style><!-- c --><p>1 &lt; 2 < 3"]) == ["", "", "plain & text", "a\n\nb c d efg", "1 < 2 < 3"]
    assert pages.extract(["<article><header><h1>T</h1></header><p>x</p><aside>no</aside><div class='comments'>no</div></article><p>out</p>"]) == ["T\n\nx"]
    assert pages.extract(["<div hidden>no</div><main><p>yes</p></main><p>out"]) == ["yes"]
    assert pages.extract(["<p>" * 3000 + "deep" + "<div>" * 300 + "x"]) == ["deep\n\nx"]
    same = "<article><h1>A</h1><p>copy of one article</p></article>"
    assert pages.extract([same] * 9) == ["A\n\ncopy of one article"] * 9


def test_links_of_an_article_stay():
    assert pages.extract(["<article><p>x</p><p><a href=/s>the source</a></p><ul><li><a href=/1>one</a><li><a href=/2>two</a></ul></article>"]) == ["x\n\nthe source\n\none\n\ntwo"]
    assert pages.extract(["<p>x<p><a href=/s>a linked quotation</a><p>y"]) == ["x\n\na linked quotation\n\ny"]
    assert pages.extract(["<ul><li><a href=/>Home</a><li><a href=/b>News</a></ul><p>y"]) == ["y"]
    few = "<a href=/s>&nbsp;&nbsp;&nbsp;&nbsp;&amp;        b</a> words"
    assert pages.extract([f"<p>{few}</p><p>{few}</p>"]) == ["& b words\n\n& b words"]
    assert pages.extract(["<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>"]) == ["so x=1 holds"]


def test_alignment_counts_the_largest_match():
    leaf = lambda n: (n, ())
    a = ("r", (leaf("a"), ("b", (pages.SLOT,)), leaf("c")))
    b = ("r", (leaf("x"), ("b", (leaf("q"), pages.SLOT)), leaf("c"), pages.SLOT))
    assert pages.align(a, b) == (4, ((0, 0),))
    assert pages.align(leaf("a"), leaf("b")) == (0, ())


def test_pages_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (2, "no host", "<p>x", "t"), (2, "no host", "<p>x", "t"), (None, "http://h/a", "", "t")], "page_id long, url string, html string, text string")
    out = pages.main_text(df).collect()
    assert sorted(r["text"] for r in out) == ["", "", "x", "x"]
    assert pages.main_text(df.filter("false")).count() == 0


def test_hot_hosts_are_dealt_out(spark):
    df = spark.range(700).select(F.col("id").alias("page_id"), F.lit("http://hot.example/").alias("url"), F.format_string("<article><p>t%d</p></article>", "id").alias("html"))
    assert {r["page_id"]: r["text"] for r in pages.main_text(df).collect()} == {i: f"t{i}" for i in range(700)}
