"""Token files and packing against the tokenizers library itself."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tieout.llm import packing, repair
from tieout.llm.queries import QUERIES
from tieout.llm.tokens import Encoder

FOLDER = "/root/testdata/sf0.001"
FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = [
    "", " ", "a", " a", "a ", "a  b", "a   b", "a\n\nb", "a\nb c", "x<|endoftext|>y z", "é  é a ́b", "a\tb c", "it's 'S 're we'll", " a b c d", "ΑΣ ΟΔΟΣ b", "<|startoftext|>", "\x1c a",
    "a \x85b", "İ I ı Ünïcode, naïve.", "word.,!? next... end)", "日本語 text 12 345", "A" * 3000 + " b", "don't. can't, I'm", "über-groß (sehr)", "﻿x ​ y", "a b c",
]


@pytest.mark.parametrize("name", FILES)
def test_encoder_agrees_with_the_library(name):
    path = public_tokenizers.path(name)
    texts = ODD + [r["text"] for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()][:150]
    coder, plain = Encoder(path), Tokenizer.from_file(path)
    for _ in range(2):  # the second time from what is remembered
        got = coder.encode(pa.array(texts + [None]))
        want = [e.ids for e in plain.encode_batch(texts + [""], add_special_tokens=False)]
        for text, a, b in zip(texts + [None], got, want):
            assert a.tolist() == b, text
    assert coder.encode(pa.array([], pa.string())) == []


def encoded(name, end, folder=FOLDER):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    rows = sorted(pq.read_table(f"{folder}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"])
    return {r["doc_id"]: np.array(plain.encode(r["text"] or "", add_special_tokens=False).ids + [end], "<u4") for r in rows}, {r["doc_id"]: r["source"] for r in rows}


def test_token_file_query(spark):
    ids, _ = encoded("word_bpe_49k.json", 2)
    rows = {r["doc_id"]: r for r in QUERIES["op8_token_files"](spark, FOLDER).collect()}
    at = 0
    assert rows.keys() == ids.keys()
    for key, own in ids.items():
        assert (rows[key]["start"], rows[key]["n_tokens"], rows[key]["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(4)
    parts = [rng.integers(3, 60, 5) for _ in range(40)]
    for ids in (np.concatenate([parts[i] for i in rng.integers(0, 40, 3000)]), np.full(1000, 7), np.array([2]), np.zeros(0, int), np.tile([5, 5, 5, 2], 500)):
        ids = ids.astype(np.uint32)
        g = repair.compress(ids, 2, rounds=6, least=4)
        assert (g.expand(g.symbols) == ids).all()
        assert int(g.sizes(g.symbols).sum()) == len(ids)
        for a, b in ((0, 1), (3, 90), (len(ids) - 5, len(ids) + 9), (10, 10)):
            assert (g.tokens(max(a, 0), b) == ids[max(a, 0) : b]).all()
        for left, right in zip(g.left.tolist(), g.right.tolist()):
            assert left != 2 and left < repair.FIRST + len(g.left) and right < repair.FIRST + len(g.left)
    assert len(repair.compress(np.tile([9, 8, 7, 6], 400).astype(np.uint32), 2).symbols) < 500


def odd_rows(spark):
    rows = [(3, None, "x", 1), (1, "", "x", 1), (2, "some words here", None, 1), (2, "some words here", None, 1), (None, "no id", "y", 1), (9, "long " * 4000, "z", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ids int")


def test_odd_rows_and_small_shards(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    file = repair.write_tokens(odd_rows(spark), path, end=2, shard_tokens=3).read(spark)
    rows = sorted(repair.read_tokens(file).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 2, 3, 9] and [r["n_tokens"] for r in rows] == [3, 1, 4, 4, 1, 4001]
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    none = odd_rows(spark).filter("false")
    assert repair.read_tokens(repair.write_tokens(none, path, end=2).read(spark)).count() == 0
    assert packing.pack(none, path).count() == 0


def check_pieces(pieces, ids, window):
    """Every id in one piece, sequences without gaps, all full but the last."""
    by = {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append(r)
        assert r["length"] > 0 and len(r["ids"]) == 4 * r["length"]
    assert by.keys() == ids.keys()
    for key, own in ids.items():
        found = sorted(by[key], key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in found) == own.tobytes()
        assert [r["start"] for r in found] == np.cumsum([0] + [r["length"] for r in found])[:-1].tolist()
    ends = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(ends) == list(range(len(ends)))
    assert all(e == window for s, e in ends.items() if s < len(ends) - 1) and max(ends.values()) <= window


def test_packing(spark):
    ids, source = encoded("byte_bpe_50k.json", 0)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    check_pieces(pieces, ids, 1024)
    total = sum(map(len, ids.values()))
    share, given, windows = {}, {}, {}
    for key, own in ids.items():
        share[source[key]] = share.get(source[key], 0) + len(own) / total
    for r in pieces:
        windows.setdefault(r["sequence_id"], []).append(r)
    for s in range(len(windows) - 4):  # at the end the queues' last parts follow
        for r in windows[s]:
            given[r["source"]] = given.get(r["source"], 0) + r["length"]
        for name, part in share.items():
            assert abs(given.get(name, 0) - part * 1024 * (s + 1)) <= packing.CELL + 2


def test_packing_query(spark):
    ids, _ = encoded("byte_bpe_50k.json", 0)
    for r in QUERIES["op4_packing"](spark, FOLDER).collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())


def test_packing_by_weights_and_small_windows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, "aa bb cc dd " * (5 + i % 7), "left" if i % 4 else "right") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(df, path, weights={"left": 1.0, "right": 1.0}, window=32, cell=8).collect()
    plain = Tokenizer.from_file(path)
    check_pieces(pieces, {i: np.array(plain.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t, _ in rows}, 32)
    early = [r for r in pieces if r["sequence_id"] < 10]
    assert sum(r["length"] for r in early if r["source"] == "right") == sum(r["length"] for r in early) / 2
    odd = packing.pack(odd_rows(spark), path, window=8, cell=4).collect()
    assert sum(r["length"] for r in odd if r["doc_id"] == 2) == 8 and sum(r["length"] for r in odd if r["doc_id"] is None) == 3


def test_ranks_are_a_permutation():
    places = packing.Places([70, 33, 5, 0, 129], [0.3, 0.1, 0.1, 0.2, 0.9], 4, 16)
    found = np.concatenate([places.rank(q, np.arange(n)) for q, n in enumerate(places.cells.tolist())])
    assert sorted(found.tolist()) == list(range(int(places.cells.sum())))


def test_small_sources_keep_their_weight(spark):
    """A named source below a token of a window has its target share too."""
    import public_tokenizers

    from tieout.llm.packing import pack

    for small in ("b", None):
        rows = [(i, "a", "word " * 2500) for i in range(200)] + [(1000, small, "other " * 300)]
        df = spark.createDataFrame(rows, "doc_id long, source string, text string")
        out = pack(df, public_tokenizers.path("byte_bpe_50k.json"), weights={"a": 0.5, small: 0.5})
        assert min(r["sequence_id"] for r in out.filter("doc_id = 1000").collect()) == 0
