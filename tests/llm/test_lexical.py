"""Ranked lexical search against brute force and SQL."""

import math
import random
import re
from collections import Counter

import pytest

from oracle import compare, connect
from tieout.llm import lexical
from tieout.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def slow(docs, items, k):
    """{item: [(score, …)]} with every document scored by the formula as it stands."""
    counts = [(key, Counter(terms(t))) for key, t in docs if terms(t)]
    n_all, l_all = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for key, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_all) // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect()), key=str)


def test_query_agrees_with_sql(spark):
    ok, note, _ = compare(spark, connect(FOLDER), FOLDER, "op13_search", QUERIES, ORACLES)
    assert ok, note


@pytest.mark.parametrize("first, shard_docs, per_block", [(4096, 4096, 1024), (3, 2, 2)])
def test_random_texts(spark, monkeypatch, first, shard_docs, per_block):
    """Short words give many ties; small shards and first visits give more waves and pruning."""
    monkeypatch.setattr(lexical, "FIRST", first)
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(lexical, "QUERIES", per_block)
    chance = random.Random(11)
    vocabulary = ["the"] * 12 + [f"w{i}" for i in range(40)] + ["É", "é", "x1", "中"]
    docs = [(i * 7 % 101, " ".join(chance.choice(vocabulary) for _ in range(chance.choice([1, 2, 5, 5, 30, 90])))) for i in range(90)]
    items = [(f"i{j}", " ".join(chance.choice(vocabulary) for _ in range(chance.choice([1, 3, 8])))) for j in range(5)]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    for k in (1, 4):
        got = rows_of(lexical.search(index, spark.createDataFrame(items, "item_id string, text string"), k=k))
        assert got == slow(docs, items, k)


ODD = [
    (1, None, 1), (2, "", 2), (3, " .,! ", 3), (4, "apple pear", 4), (4, "apple pear", 4), (None, "apple pear", 5), (None, "pear APPLE", 6), (5, "apple " * 50_000, 7),
    (6, "ÄPFEL äpfel\u0000apple_pear", 8), (7, "plum", 9),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, m long").withColumnRenamed("m", "term")
    items = [("a", "Apple apple PEAR"), ("a", "plum"), (None, "äpfel"), ("e", None), ("f", ""), ("g", "nowhere"), ("h", "apple " * 3000 + "pear")]
    got = rows_of(lexical.search(lexical.build_index(docs), spark.createDataFrame(items, "item_id string, text string"), k=5))
    assert got == slow([r[:2] for r in ODD], items, 5)


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], "doc_id string, text string"), spark.createDataFrame([("a", "b")], "item_id string, text string")
    index = lexical.build_index(none)
    assert lexical.search(index, items).collect() == [] and lexical.search(index, items).columns == ["query_id", "rank", "id", "score"]
    full = lexical.build_index(spark.createDataFrame([("d", "b")], "doc_id string, text string"))
    assert [tuple(r) for r in lexical.search(full, items).collect()] == [("a", 1, "d", 1000000000 // 1800 * math.floor(1000 * math.log(4 / 3)))]
    assert lexical.search(full, items.limit(0)).collect() == []
