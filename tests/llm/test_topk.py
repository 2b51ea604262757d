"""Exact top-k search against brute force."""

import math
import random

import numpy as np
import pyarrow.parquet as pq

from tieout.llm import covertree
from tieout.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def brute(rows, asked, k=5):
    whole = {}
    for key, v in rows:
        if key is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(key, []).append(np.floor(np.array(v, float) * 256))
    out = {}
    for key in asked:
        if key in whole:
            scored = sorted((-int(whole[key][0] @ v), other) for other, vs in whole.items() if other != key for v in vs)
            out[key] = [(-s, other) for s, other in scored[:k]]
    return out


def as_lists(df, key="vec_id"):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        found = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(found) + 1
        found.append((r["score"], r[key]))
    return out


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()]
    assert as_lists(QUERIES["op7_top_k"](spark, FOLDER)) == brute(rows, [k for k, _ in rows if k % 50 == 0])


def test_pruned_search_is_exact(spark, monkeypatch):
    """Clustered vectors over many blocks, with ties, copies and vectors that take no part."""
    monkeypatch.setattr(covertree, "BLOCK", 64)
    monkeypatch.setattr(covertree, "CENTRES", 12)
    chance = random.Random(11)
    centres = [[chance.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = [(k, [x + chance.gauss(0, 0.05) for x in chance.choice(centres)]) for k in range(900)]
    rows += [(k, list(rows[3][1])) for k in range(900, 1200)]
    rows += [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [math.nan] * 6), (2003, [math.inf] * 6), (2004, []), (2005, [9.0]), (None, [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = as_lists(covertree.top_k(df, df.filter("vec_id % 7 = 0")))
    assert got == brute([r for r in rows if r[0] != 2005], [k for k in range(0, 1200, 7)])


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 3), (50, [2.0], 4)], "vec_id long, embedding array<float>, score int")
    assert as_lists(covertree.top_k(df, df)) == {0: [(131072, 50)], 50: [(131072, 0)]}
    assert covertree.top_k(df.filter("false"), df.filter("false")).count() == 0
    assert covertree.top_k(df, df.filter("false")).count() == 0


def test_tree_covers_its_points():
    points = np.random.default_rng(2).normal(size=(500, 3))
    tree = covertree.build(points, leaf=4)
    for n in range(len(tree.begin)):
        own = tree.order[tree.begin[n] : tree.end[n]]
        away = np.linalg.norm(points[own] - points[tree.centre[n]], axis=1)
        assert away.max() <= tree.radius[n] + 1e-9
        if tree.children[n]:
            assert sorted(x for c in tree.children[n] for x in tree.order[tree.begin[c] : tree.end[c]]) == sorted(own)


def test_repeated_ids_are_searched(spark, monkeypatch):
    """A centre's vectors of one id may all lie in one part, which need not be part 0."""
    monkeypatch.setattr(covertree, "BLOCK", 64)
    monkeypatch.setattr(covertree, "CENTRES", 1)
    rows = [(7, [float(i), 1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = as_lists(covertree.top_k(df, asked))
    assert got[1] == [(256 * 256 * i, 7) for i in range(299, 294, -1)] and got[2] == [(65536, 7)] * 5


def test_leaves_are_scored_together():
    """Many small leaves: the products taken are far fewer than the pairs of leaves, and the result is exact."""
    rng = np.random.default_rng(5)
    q, d = (np.floor(rng.normal(size=(n, 32)) * 256) for n in (600, 900))
    queries, data, taken = covertree.build(q), covertree.build(d), []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            taken.append(1)
            return np.asarray(self) @ np.asarray(other)

    queries.points = queries.points.view(Counted)
    best = covertree.Best(len(q), 5)
    covertree.search(queries, np.arange(len(q)), data, np.arange(1000, 1000 + len(d)), best)
    scores = q @ d.T
    for i in range(len(q)):
        order = np.lexsort((np.arange(len(d)), -scores[i]))[:5]
        assert best.ids[i].tolist() == (1000 + order).tolist() and best.scores[i].tolist() == scores[i, order].tolist()
    leaves = [sum(not c for c in t.children) for t in (queries, data)]
    assert leaves[0] * leaves[1] > 1000 and len(taken) < 200
