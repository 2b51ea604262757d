"""Line-first cleaning: counts against brute force, rules on planted lines, odd rows."""

import re

import pyarrow.parquet as pq
import pytest

from oracle import compare, connect
from tieout.llm import quality
from tieout.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"
PROSE = "\n".join(f"The {w} {w}ness of word{i} left place{i * 7} at dawn{i}, and number {i} followed it{i}." for i, w in enumerate("old new red big wet dry far sad shy odd raw mad".split()))


def slow(text):
    """The contract's counts, word by word."""
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in SPACES:
            words += [word] if word else []
            word = ""
        else:
            word += c
    inside = set()
    for i in range(len(words) - 2):
        if any(words[j : j + 3] == words[i : i + 3] for j in range(len(words) - 2) if j != i):
            inside |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(line in lines[:i] for i, line in enumerate(lines)),
        "n_repeat_words": len(inside),
        "base_failed": len(words) < 50 or 100 * len(inside) > 50 * len(words),
    }


ODD = [
    (1, None, 5), (2, "", 5), (3, " \n\t\r\x0b\x0c", 1), (4, PROSE, 2), (4, PROSE, 2), (None, PROSE, 2), (5, "a b c a b c a b c", 3), (6, "a\nb\na\n\na \na", 4),
    (7, "é ü x. \u0085y " * 60, 5), (8, "word " * 40_000, 6), (9, "#*$%&|<>" * 3, 7), (10, "x" * 300_000, 8), (11, "no \r\nend\r\nno \r\n" + PROSE, 9),
]


def test_counts_agree_with_brute_force():
    texts = [r["text"] for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()] + [t for _, t, _ in ODD if len(t or "") < 10_000]
    for text in texts:
        if len(text or "") > 6000:
            continue
        got = quality.judge(text)
        want = slow(text)
        assert {k: got[k] for k in want} == want, (text or "")[:80]


def test_rows_of_odd_documents(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, kept long").withColumnRenamed("kept", "n_words")
    rows = quality.clean(docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d) for d, _, _ in ODD)
    by = {r["doc_id"]: r for r in rows}
    for key in (1, 2, 3):
        assert by[key]["n_words"] == 0 and by[key]["base_failed"] and not by[key]["kept"] and by[key]["clean_text"] == ""
    assert by[4]["kept"] and by[4]["clean_text"] == PROSE and by[None]["kept"]
    assert by[8]["n_repeat_words"] == 40_000 and by[6]["n_dup_lines"] == 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert quality.clean(empty).collect() == []
    assert quality.clean(empty).columns[0] == "doc_id"


@pytest.mark.parametrize(
    "line, rule",
    [
        ("All Rights Reserved.", "boilerplate"),
        ("We value you. See our cookie policy.", "boilerplate"),
        ("Home | Shop | Blog", "navigation"),
        ("Home  About us Contact", "navigation"),
        ("Sport › Football › Results.", "navigation"),
        ("Click here", "punctuation"),
        ("BUY!! NOW!! AND!! SAVE!!", "punctuation"),
        ("The end.", None),
        ("“Who is it?” she asked.", None),
        ("He looked up the news.", None),
        ("Wait... what? Yes!", None),
    ],
)
def test_rules(line, rule):
    assert quality.failed_rule(line, len(re.findall(r"\S+", line))) == rule


def test_lines_go_before_documents_do():
    few = quality.judge(PROSE + "\nHome | Shop | Blog")
    assert few["kept"] and few["clean_text"] == PROSE and few["removed"] == [{"line": 12, "rule": "navigation"}]
    many = quality.judge(PROSE + "\n" + "\n".join(f"item {i} | offer {i * 7} | price {i * 13}" for i in range(40)))
    assert not many["base_failed"] and not many["kept"]
    assert many["clean_text"] == PROSE


def test_query_agrees_with_sql(spark):
    ok, note, _ = compare(spark, connect(FOLDER), FOLDER, "op12_quality", QUERIES, ORACLES)
    assert ok, note
