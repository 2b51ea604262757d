"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tieout.llm import spelling
from tieout.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
LETTERS = "A-Za-zÀ-ÿ"


def counted(rows, least_length=6, least_count=5, thinned=199):
    """The contract's words, run by run."""
    found = Counter()
    for key, text in rows:
        for run in re.findall(f"[{LETTERS}]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if thinned and h % thinned == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow(known):
    """Near words by deleting each code point of every word; forms and roots one by one."""
    by = {}
    for w in known:
        for i in range(len(w)):
            by.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        by.setdefault(w, set()).add(w)
    near = {w: {o for v in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))] for o in by.get(v, ()) if one_edit(w, o)} for w in known}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-known[o], o), default=None)
        form[w] = best if best is not None and known[best] >= 5 * known[w] else None
    out = {}
    for w in known:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (known[w], len(near[w]), form[w], known.get(form[w]), root)
    return out


def rows_of(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_query_agrees_with_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()]
    got = QUERIES["op11_spelling"](spark, FOLDER)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == slow(counted(docs))


@pytest.mark.parametrize("tile", [3, 1024])
@pytest.mark.parametrize("alphabet, lengths", [("ab", (1, 7)), ("abcé", (3, 6)), ("ax", (14, 17))])
def test_near_words_of_random_words(spark, tile, alphabet, lengths):
    """Short alphabets give runs of equal letters, where an edit has several places, and large tiles."""
    chance = random.Random(5)
    names = {"".join(chance.choice(alphabet) for _ in range(chance.randint(*lengths))) for _ in range(250)}
    known = {w: chance.choice([5, 6, 30, 31, 200]) for w in sorted(names)}
    got = spelling.near_words(spark.createDataFrame(list(known.items()), "word string, n long"), tile=tile)
    found = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in got.collect()}
    for w in known:
        near = [o for o in known if one_edit(w, o)]
        best = min(near, key=lambda o: (-known[o], o), default=None)
        assert found[w] == (len(near), known.get(best), best), w


def test_long_words_and_many_in_one_tile(spark):
    long = "q" * 3000
    known = {long: 9, long + "q": 50, "q" * 1500 + "r" + "q" * 1499: 7, "z" * 70: 5}
    known |= {f"stem{chr(0xE0 + i % 24)}{chr(97 + i // 24)}end": 5 + i for i in range(480)}
    got = spelling.near_words(spark.createDataFrame(list(known.items()), "word string, n long"), tile=50)
    found = {r["word"]: r["n_near"] for r in got.collect()}
    for w in list(known)[:30]:
        assert found[w] == sum(one_edit(w, o) for o in known), w


def test_odd_documents(spark):
    text = "Straße Ärger colour colour. COLOUR color9color"
    rows = [(1, None, 1), (2, "", 2), (3, "a bb ccc \n", 3), (None, text * 3, 4), (5, text * 30, 5), (5, text * 30, 5), (6, "x" * 200_000, 6), (7, "ÄÄÄÄÄÄ ääääää " * 9, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumn("word", F.col("n"))
    assert rows_of(spelling.variants(docs)) == slow(counted([r[:2] for r in rows]))


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def test_chains_end_at_their_root(spark):
    text = "abcdef " * 3125 + "abcdeg " * 625 + "abcdhg " * 125 + "abcihg " * 25 + "abjihg " * 5
    got = rows_of(spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), thinned=0))
    assert got["abjihg"] == (5, 1, "abcihg", 25, "abcdef") and got["abcdef"][2] is None
