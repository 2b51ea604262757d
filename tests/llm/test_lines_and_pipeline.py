"""Fuzzy line deduplication, components, and the pipeline as a whole against brute force."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import public_tokenizers
from test_scans import fingerprint, grouped, windows_of
from tokenizers import Tokenizer

import corpus_pipeline
from tieout.llm import lines
from tieout.llm.common import components
from tieout.llm.queries import QUERIES


def shingles(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} or {line}


def plain(line):
    return line.strip(" \t\r\f\v")


def brute(docs, similarity=0.8):
    """What is left of each text; ``docs`` are (id, text)."""
    known = sorted({plain(x) for _, t in docs for x in (t or "").split("\n") if plain(x)})
    root = {x: x for x in known}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(x) for x in known]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
                root[top(known[i])] = top(known[j])
    keeper = {}
    for key, text in docs:
        for x in text.split("\n") if text else []:
            if plain(x):
                keeper[top(plain(x))] = min(keeper.get(top(plain(x)), key), key)
    out = []
    for key, text in docs:
        seen, left = set(), []
        for x in text.split("\n") if text is not None else []:
            group = top(plain(x)) if plain(x) else None
            if group is None or keeper[group] == key and group not in seen:
                left.append(x)
            seen.add(group)
        out.append((key, "\n".join(left) if text is not None else None))
    return sorted(out)


def test_lines_against_brute_force(spark):
    chance = random.Random(9)
    words = ["".join(chance.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(chance.randint(2, 9))) for _ in range(400)]
    base = [" ".join(chance.choice(words) for _ in range(chance.randint(1, 40))) for _ in range(120)]

    def near(line):
        parts = line.split(" ")
        if len(parts) > 24:
            parts[chance.randrange(len(parts))] = chance.choice(words)
        return " ".join(parts)

    docs = []
    for key in range(150):
        made = [near(chance.choice(base)) if chance.random() < 0.6 else " ".join(chance.choice(words) for _ in range(chance.randint(1, 30))) for _ in range(chance.randint(0, 9))]
        docs.append((key, "\n".join(f" {x}\t" if chance.random() < 0.1 else x for x in made)))
    docs += [(500, None), (501, ""), (502, "\n\n \n"), (503, "x\nx\nx \n日本語の長い行です。日本語の長い行です。"), (504, "日本語の長い行です。日本語の長い行です。\nx"), (505, "ab " * 20_000)]
    df = spark.createDataFrame([(k, t, "z", k) for k, t in docs], "doc_id long, text string, removed string, id long")
    out = lines.deduplicate(df).collect()
    got, want = sorted((r["doc_id"], r["text"]) for r in out), brute(docs)
    assert len(got) == len(want) and sum(a == b for a, b in zip(got, want)) >= 0.95 * len(want)  # the bands' recall
    assert got[-6:] == want[-6:]
    assert all(r["removed"] == "z" and r["n_lines"] >= r["n_removed"] for r in out)


@pytest.mark.parametrize("few", [2, 256])
def test_similar_lines_of_one_template_meet(spark, monkeypatch, few):
    """Pairs at 0.8 or more among many different lines that share most of their text."""
    monkeypatch.setattr(lines, "FEW", few, raising=False)
    chance = random.Random(4)
    text = lambda n: "".join(chance.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)).strip().ljust(n, "q")
    head, docs = text(150), []
    for key in range(0, 600, 2):
        own = head + text(60)
        for at in range(200, 0, -1):  # a twin as far off as is still a pair
            twin = own[:at] + text(len(own) - at)
            if len(shingles(own) & shingles(twin)) < 0.8 * len(shingles(own) | shingles(twin)):
                break
            last = twin
        docs += [(key, own), (key + 1, last)]
    out = lines.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    gone = {r["doc_id"] for r in out if r["n_removed"]}
    want = {k for (k, t), (_, w) in zip(docs, brute(docs)) if t != w}
    assert len(want) == 300 and gone <= want and len(gone) >= 0.97 * len(want)  # the bands' recall


def test_line_query_on_a_small_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]
    got = sorted((r["doc_id"], r["text"]) for r in QUERIES["op6_line_dedup"](spark, folder).collect())
    want = brute(docs)
    same = sum(a == b for a, b in zip(got, want))
    assert len(got) == len(want) and same >= 0.97 * len(want)  # the bands' recall


def test_lines_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c\nd"), (1, "a b c\nd"), (None, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in lines.deduplicate(df).collect()) == [("1", "a b c\nd"), ("1", "a b c\nd"), ("2", ""), ("None", "a b c")]
    assert lines.deduplicate(df.filter("false")).count() == 0


def test_components_of_paths_and_stars(spark):
    chance = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 90)] + [(1000, k) for k in range(1001, 1060)] + [(7, 7), (None, 3), (200, 201), (201, 200), (203, 202), (-5, 300)]
    chance.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["component"] for r in components(df).read(spark).collect()}
    want = {**{i: 0 for i in range(91)}, **{k: 1000 for k in range(1000, 1060)}, 200: 200, 201: 200, 202: 202, 203: 202, -5: -5, 300: -5}
    assert found == want
    assert components(df.filter("false")).read(spark).count() == 0


def test_pipeline_stages(spark):
    """Every stage after the classifier against brute force on what it was given."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    clean = corpus_pipeline.drop_toxic(spark, docs, folder).cache()
    assert clean.columns == columns and 0 < clean.count() <= docs.count()
    slim = corpus_pipeline.dedup_lines(spark, clean, folder).cache()
    assert slim.columns == columns and slim.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    want = brute(pairs(clean))
    assert sum(a == b for a, b in zip(sorted(pairs(slim)), want)) >= 0.97 * len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in slim.collect())
    single = corpus_pipeline.dedup_documents(spark, slim, folder).cache()
    groups = grouped({k: fingerprint(t) for k, t in pairs(slim)})
    assert single.columns == columns and sorted(k for k, _ in pairs(single)) == sorted(set(groups.values()))
    fresh = corpus_pipeline.drop_contaminated(spark, single, folder).cache()
    items = [w for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist() for w in windows_of(r["text"])[1]]
    known = set(items)
    kept = []
    for key, text in pairs(single):
        found = windows_of(text)[0]
        hit = {j for i in range(len(found) - 12) if tuple(found[i : i + 13]) in known for j in range(i, i + 13)}
        if not hit or 20 * len(hit) < len(found):
            kept.append(key)
    assert fresh.columns == columns and sorted(k for k, _ in pairs(fresh)) == sorted(kept)
    packed = corpus_pipeline.pack(spark, fresh, folder).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for key, text in pairs(fresh):
        own = b"".join(r["ids"] for r in sorted((r for r in packed if r["doc_id"] == key), key=lambda r: r["start"]))
        assert own == np.array(coder.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
    for df in (clean, slim, single, fresh):
        df.unpersist()


def test_pipeline_of_odd_rows(spark, tmp_path):
    """NULLs, repeated rows, no rows, and columns with names that stages use."""
    folder = str(tmp_path)
    rows = [(1, None, "s", None, "p"), (2, "", None, 0, "q"), (2, "", None, 0, "q"), (None, "some text without an id", "s", 3, "r"), (4, "word " * 30_000, "s", 9, "t")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, n_words string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs, least in ((spark.read.parquet(f"{folder}/documents.parquet"), 1), (spark.read.parquet(f"{folder}/documents.parquet").filter("false"), 0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
            assert name == "packing" or docs.columns == columns
        found = docs.collect()
        assert len(found) >= least
        assert not least or {r["doc_id"] for r in found} >= {None, 4}


def test_entry_registers_all():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries() and len(corpus_pipeline.STAGES) == 5


def test_bands_are_read_whole(spark):
    """Bands that run over several batches are not cut; a band of two has one row, one of one none, equal ones count once."""
    import pyarrow as pa

    band, h = [1, 1, 1, 2, 3, 3, 3, 3, 3, 4, 4, 9], [5, 5, 6, 7, 1, 2, 2, 3, 4, 5, 6, 8]
    for size in (1, 2, 3, 5, 12):
        batches = [pa.RecordBatch.from_pydict({"band": pa.array(band[i : i + size]), "h": pa.array(h[i : i + size])}) for i in range(0, len(h), size)]
        got = [(int(x), int(y)) for found in lines._whole_bands(iter(batches)) for x, y in zip(*found)]
        assert got == sorted(set(zip(band, h)))
    made = [(1, *[k for k in range(8)]), (2, *[k for k in range(8)]), (3, *[100 + k for k in range(8)]), (4, 0, *[200 + k for k in range(7)])]
    df = spark.createDataFrame(made, "h long, " + ", ".join(f"b{k} long" for k in range(8)))
    assert sorted((r["h"], r["n"], r["low"]) for r in lines.shared(df).collect()) == [(1, 3, 1), (2, 2, 1), (2, 3, 1), (4, 3, 1)]


def test_lines_need_no_python(spark):
    """Signing, looking up, comparing and placing lines are plans of DataFrame functions alone."""
    df = spark.createDataFrame([(1, "a line of some length\nb"), (2, "a line of some length!")], "doc_id long, text string")
    texts = lines._texts(df, "doc_id", "text")
    signed = lines.signed(texts)
    known = lines.looked_up(texts, signed)
    pairs = signed.select(signed["h"].alias("a"), signed["h"].alias("b"))
    for plan in (signed, lines.shared(lines.banded(signed, 0, 8)), known, lines.verified(pairs, known), lines.places_of(texts, signed), lines.deduplicate(df)):
        assert not re.search("Python|Pandas|InArrow", plan._jdf.queryExecution().toString())
    assert lines.verified(pairs, known).count() == 3
