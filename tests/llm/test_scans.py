"""Secret scan, decontamination and SimHash against brute force."""

import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest
import xxhash

from tieout.llm import decontaminate, secrets, simhash
from tieout.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

BASE = (
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6),
    ("access", re.compile("(AKIA[A-Z0-9]+)"), 20),
    ("hex", re.compile("([0-9a-f]+)"), 24),
)


def base_spans(text):
    found = [(m.start(), i, m.end()) for i, (_, rx, least) in enumerate(BASE) for m in rx.finditer(text) if len(m[1]) >= least]
    return [(BASE[i][0], s, e) for s, i, e in sorted(found)]


def documents(folder=FOLDER):
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]


ODD = [
    (1, None, 5, "x"), (2, "", 5, "x"), (3, "a", 6, "y"), (3, "a", 6, "y"), (None, "password=abcdefgh1", 7, None),
    (4, "é" * 9000 + ' token: "abcdefghij" ' + "0a" * 40, 8, "z"), (5, "x " * 40_000 + "AKIA" + "Q" * 30, 8, "z"), (6, " \n\t ", 1, "q"),
]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, spans long, id string")


def test_secret_query(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op2_secrets"](spark, FOLDER).collect()}
    docs = documents()
    assert len(rows) == len(docs)
    for key, text in docs:
        want = base_spans(text or "")
        row = rows[key]
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex")]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(row["spans"].split(","))


def test_secret_automaton_agrees_with_expressions(spark):
    chance = random.Random(7)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "abcdef12", "AKIA", "ABCDEF0123456789", "é", "\n", "0123456789abcdef", "AK", "z"]
    texts = ["".join(chance.choice(parts) for _ in range(chance.randint(0, 50))) for _ in range(1500)] + ["a" * 5000, "password=" * 300 + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.find_secrets(df, rules=secrets.BASE).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == base_spans(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_secret_more_rules_and_redaction(spark):
    text = "é ghp_" + "z1" * 18 + " -----BEGIN RSA PRIVATE KEY----- AIza" + "b-" * 18 + " password=hunter22"
    df = spark.createDataFrame([(1, text), (2, None), (3, "clean")], "doc_id long, text string")
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.find_secrets(df).collect()}
    assert kinds == {1: ["code_host", "private_key", "cloud_key", "assign"], 2: [], 3: []}
    out = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert out == {1: "é [code_host] [private_key] [cloud_key] [assign]", 2: None, 3: "clean"}


def test_secret_rules_are_checked():
    for pattern in ("a.*?b", "é", r"(?=a)"):
        with pytest.raises(ValueError):
            secrets.compiled((secrets.Rule("x", pattern),))


def test_odd_rows(spark):
    found = secrets.find_secrets(odd(spark)).collect()
    assert sorted(len(r["spans"]) for r in found) == [0, 0, 0, 0, 0, 1, 1, 2]
    none = odd(spark).filter("false")
    bench = spark.createDataFrame([(1, None), (None, "a"), (7, "x x"), (7, "x x")], "item_id long, text string")
    assert secrets.find_secrets(none).count() == decontaminate.find_overlap(none, bench).count() == simhash.near_duplicates(none).count() == 0
    over = decontaminate.find_overlap(odd(spark), bench).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in over if r["doc_id"] in (1, 3, 5, 6)} == {
        1: (0, 0, []), 3: (1, 1, []), 5: (40_001, 40_000, ["7"]), 6: (0, 0, []),
    }
    assert decontaminate.find_overlap(odd(spark), bench.filter("false")).filter("n_hit > 0").count() == 0
    near = simhash.near_duplicates(odd(spark)).collect()
    assert len(near) == len(ODD)
    assert {(r["fingerprint"], r["component_id"]) for r in near if r["doc_id"] in (1, 2, 6)} == {(0, 1)}
    assert [r["component_id"] for r in near if r["doc_id"] is None] == [None]


def windows_of(text, size=13):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return words, [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [tuple(words)] if words else []


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_decontamination_query(spark, folder):
    items = {}
    for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist():
        for w in windows_of(r["text"])[1]:
            items.setdefault(w, set()).add(str(r["item_id"]))
    sizes = {len(w) for w in items}
    rows = {r["doc_id"]: r for r in QUERIES["op10_decontaminate"](spark, folder).collect()}
    bad = 0
    for key, text in documents(folder):
        words, hit, found = windows_of(text)[0], set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i : i + size])) in items:
                    hit |= set(range(i, i + size))
                    found |= items[w]
        r = rows[key]
        bad += r["contaminated"]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(words), len(hit), len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(words))
    assert bad


def test_decontamination_spans(spark):
    df = spark.createDataFrame([(1, "é one, TWO three. four é"), (2, "two three"), (3, "three two")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "two three")], "item_id long, text string")
    rows = decontaminate.find_overlap(df, bench).join(df, "doc_id")
    from pyspark.sql import functions as F

    out = {r[0]: r[1] for r in rows.select("doc_id", decontaminate.without_spans(F.col("text"), F.col("spans"))).collect()}
    assert out == {1: "é one, . four é", 2: "", 3: "three two"}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints):
    keys, root = sorted(prints), {k: k for k in prints}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in keys}


def test_simhash_query(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op9_simhash"](spark, FOLDER).collect()}
    prints = {key: fingerprint(text) for key, text in documents()}
    assert {k: r["fingerprint"] for k, r in rows.items()} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {k: r["component_id"] for k, r in rows.items()} == grouped(prints)


def test_simhash_links_are_whole(spark):
    chance = random.Random(3)
    prints, seeds = {}, [chance.getrandbits(64) for _ in range(6)]
    for k in range(400):
        fp = chance.choice(seeds)
        for _ in range(chance.randint(0, 5)):
            fp ^= 1 << chance.randrange(24)
        prints[k] = fp
    signed = {k: p - (1 << 64) if p >> 63 else p for k, p in prints.items()}
    df = spark.createDataFrame([(p,) for p in set(signed.values())], "fingerprint long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(df)).read(spark).collect()}
    least = {}
    for k in sorted(signed):
        least.setdefault(found.get(signed[k], signed[k]), k)
    assert {k: least[found.get(signed[k], signed[k])] for k in signed} == grouped(prints)
