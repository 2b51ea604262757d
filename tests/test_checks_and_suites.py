"""Check generators, suites, proposals, gates."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tieout.model import Measure, Side
from tieout.operators import checks as C
from tieout.plans import gate as G
from tieout.plans import propose as P
from tieout.plans import suite as S
from tieout.sources.catalogue import describe


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(1, 1, "a", date(2024, 1, 1)), (1, 2, "a", date(2024, 1, 1)), (1, 2, None, date(2024, 1, 5)), (12, 3, "b", None)]
    return spark.createDataFrame(rows, "o int, l int, v string, d date")


def one(df):
    return tuple(df.first())


def test_generators(spark, lines):
    assert one(C.row_count(lines)) == (4,)
    assert one(C.distinct_values(lines, "v")) == (2,)
    assert one(C.distinct_values(lines, "v", include_blank=True)) == (3,)
    assert one(C.null_count(lines, "v")) == (1,)
    assert one(C.duplicate_keys(lines, ["o", "l"])) == (1, 1)
    assert one(C.duplicate_keys(lines.limit(2), ["o", "l"])) == (0, 0)
    assert one(C.date_coverage(lines, "d")) == (date(2024, 1, 1), date(2024, 1, 5), 2)
    assert {tuple(r) for r in C.value_set(lines, "v").collect()} == {("a", 2), ("b", 1), (None, 1)}
    assert {tuple(r) for r in C.by_grain(lines, ["o"], F.col("l")).collect()} == {(1, 5), (12, 3)}
    assert {r["column"]: r["blanks"] for r in C.table_counts(lines).collect()} == {"o": 0, "l": 0, "v": 1, "d": 1}


def test_orphans_ignore_missing_keys_and_survive_a_hot_key(spark):
    fact = spark.createDataFrame([(1,), (2,), (9,), (9,), (9,), (8,), (None,)], "k int")
    dim = spark.createDataFrame([(1,), (2,)], "k int")
    assert one(C.orphan_keys(fact, "k", dim, "k")) == (4, 2)
    assert one(C.orphan_keys(fact.where("k < 3"), "k", dim, "k")) == (0, 0)


def test_set_operations_treat_null_as_a_value(spark):
    a = spark.createDataFrame([(1,), (1,), (None,), (3,)], "k int")
    b = spark.createDataFrame([(3,), (4,)], "j int")
    assert {r["k"] for r in C.only_left(a, b).collect()} == {1, None}
    assert {r["k"] for r in C.in_both(a, b).collect()} == {3}
    assert {r["k"] for r in C.in_both(a, a).collect()} == {1, None, 3}


def pair(spark, a, b):
    return spark.createDataFrame([(a,)], "n int"), spark.createDataFrame([(b,)], "n int")


def test_suite_outcomes_and_verdict(spark):
    broken = lambda: spark.table("no_such_table")
    checks = [
        S.Check("p", "t — pass", *pair(spark, 5, 5), values=("n",), table="t"),
        S.Check("f", "t — fail", *pair(spark, 5, 6), values=("n",), table="t"),
        S.Check("x", "wrong keys", *pair(spark, 1, 2), keys=("n",)),
        S.Check("e", "broken", broken, broken, values=("n",)),
        S.Check("m", "missing column", *pair(spark, 1, 1), values=("nope",)),
        S.Check("t", "cut short", Side(pair(spark, 1, 1)[0], truncated=True), pair(spark, 1, 1)[1], values=("n",)),
        S.Check("off", "off", *pair(spark, 5, 6), values=("n",), enabled=False),
    ]
    runs = S.run_suite(spark, checks)
    found = {r["check_id"]: r for r in runs.collect()}
    assert {k: r["status"] for k, r in found.items()} == {
        "p": "pass", "f": "fail", "x": "inconclusive", "e": "inconclusive", "m": "inconclusive", "t": "inconclusive"
    }
    assert "no_such_table" in found["e"]["error"] and "nope" in found["m"]["error"] and found["x"]["refusal_kind"] == "noKeyOverlap"
    assert found["f"]["metrics"][0]["delta"] == 1 and found["f"]["duration_ms"] >= 0
    summary = S.suite_summary(runs).first()
    assert summary["verdict"] == "1 passed · 1 failed · 4 could not run"
    assert S.suite_summary(runs.where("check_id = 'p'")).first()["verdict"] == "All clear — 1 check passed."
    assert S.suite_summary(runs.where("1 = 0")).first()["verdict"] == "No checks to run."
    assert {r["table_name"]: r["checks"] for r in S.by_table(runs).collect()} == {"t": 2, S.OTHER_GROUP: 4}


def test_evidence_quotes_numbers_of_single_rows_only(spark):
    many = spark.createDataFrame([(1, 1.0), (2, 1234567.25)], "k int, v double")
    other = many.withColumn("v", F.col("v") + F.when(F.col("k") == 2, 1).otherwise(0))
    checks = [
        S.Check("a", "t — total", *pair(spark, 19658, 19658), values=("n",), table="t"),
        S.Check("b", "t — grain", many, other, keys=("k",), values=("v",), table="t"),
        S.Check("c", "t — grain two", many, many, keys=("k",), values=("v",), table="t"),
    ]
    rows = {r["check"]: r for r in S.evidence(S.suite_frame(checks)).collect()}
    assert (rows["total"]["source_value"], rows["total"]["difference"], rows["total"]["detail"]) == ("19,658", "0", "n 19,658")
    assert (rows["grain"]["metric"], rows["grain"]["detail"], rows["grain"]["status"]) == ("", "1 mismatched", "Failed")
    assert rows["grain two"]["detail"] == "2 keys compared, all agree"


def test_rerun_replaces_and_freshness(spark):
    log = spark.createDataFrame(
        [("q1", "t1", datetime(2024, 1, 1), "fail"), ("q1", "t1", datetime(2024, 1, 2), "pass"), ("q2", "t1", datetime(2024, 1, 1), "pass")],
        "source_query string, target_query string, ran_at timestamp, status string",
    )
    kept = {r["source_query"]: r["status"] for r in S.latest_runs(log, ["source_query", "target_query"], "ran_at").collect()}
    assert kept == {"q1": "pass", "q2": "pass"}
    reads = spark.createDataFrame([("m", datetime(2024, 1, 2)), ("z", datetime(2024, 1, 2))], "model string, at timestamp")
    refreshed = spark.createDataFrame([("m", datetime(2024, 1, 1)), ("m", datetime(2023, 1, 1))], "model string, done timestamp")
    assert {r["model"]: r["age_seconds"] for r in S.freshness(reads, refreshed, "model", "at", "done").collect()} == {"m": 86400, "z": None}


def test_proposals(spark):
    fact = spark.createDataFrame([], "OrderID int, OrderLineNo int, OrderDate date, ShipDate date, DueDate date, ProductKey int, SalesAmount double")
    dim = spark.createDataFrame([], "ProductKey int, ProductName string")
    catalogue = describe(spark, {"Fact_Sales": fact, "Dim_Product": dim}, {"Fact_Sales": ["OrderLineNo", "OrderID"], "Dim_Product": ["ProductKey"]})
    targets = spark.createDataFrame(
        [("fact_sales", "query", None, False), ("Products", "query", "DIM_PRODUCT", True), ("Dates", "calculated", None, False), ("Nowhere", "query", None, False)],
        "table string, kind string, reads_from string, filtered boolean",
    )
    rels = spark.createDataFrame(
        [("fact_sales", "ProductKey", "Products", "ProductKey", True), ("fact_sales", "ProductKey", "Products", "ProductKey", False)],
        "from_table string, from_col string, to_table string, to_col string, active boolean",
    )
    found = P.propose_checks(targets, catalogue, rels).collect()
    by_kind = {}
    for r in found:
        by_kind.setdefault(r["kind"], []).append(r)
    assert sorted(r["table"] for r in by_kind["rowCount"]) == ["Products", "fact_sales"]
    assert sorted(r["columns"] for r in by_kind["dateRange"]) == ["OrderDate", "ShipDate"]
    assert sorted(r["columns"] for r in by_kind["duplicates"]) == ["OrderLineNo + OrderID", "ProductKey"]
    assert [(r["columns"], r["other"]) for r in by_kind["orphans"]] == [("ProductKey", "Products.ProductKey")]
    matched = {r["table"]: (r["matched_by"], r["caution"]) for r in by_kind["rowCount"]}
    assert matched["fact_sales"] == ("name", "matched by name only")
    assert matched["Products"][0] == "query" and "filters rows" in matched["Products"][1]
    assert {r["table"] for r in P.unmatched_tables(targets, catalogue).collect()} == {"Dates", "Nowhere"}


def test_gate(spark):
    df = spark.createDataFrame([(100.0,), (200.0,)], "v double")
    measures = [Measure("total", "sum", F.col("v")), Measure("rows", "count_rows")]
    recorded = spark.createDataFrame([("total", 300.9), ("rows", 2.0)], "measure string, expected double")
    assert G.gate(G.verify_totals(recorded, df, measures)).first()["gate"] == "green"
    moved = spark.createDataFrame([("total", 302.0), ("rows", 2.0), ("gone", 1.0)], "measure string, expected double")
    verdict = G.gate(G.verify_totals(moved, df, measures)).first()
    assert (verdict["gate"], verdict["reconciled"], verdict["checked"]) == ("red", 1, 3)
    assert G.gate(G.verify_totals(recorded.where("1 = 0"), df, measures)).first()["gate"] == "red"


def test_variants(spark):
    a = spark.createDataFrame([(1, 100.0, "x"), (2, None, "y"), (3, 3.0, None)], "k int, v double, t string")
    assert G.variants_agree(a, a.withColumn("v", F.col("v") * (1 + 1e-12)), ["k"]).count() == 0
    assert [r["k"] for r in G.variants_agree(a, a.withColumn("v", F.coalesce("v", F.lit(0.0))), ["k"]).collect()] == [2]
    assert [r["k"] for r in G.variants_agree(a, a.where("k < 3"), ["k"]).collect()] == [3]
    twice = a.unionByName(a.where("k = 1"))
    assert [r["k"] for r in G.variants_agree(twice, twice, ["k"]).collect()] == [1]  # repeated keys prove nothing
    assert Decimal("1") == 1
