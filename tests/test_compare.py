"""Comparison: statuses, trap-proof keys, exactness, refusals and the self-reconciliation property."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tieout.functions.cells import DEFAULT, Tolerance
from tieout.functions.normalize import Normalize, normalize_key
from tieout.model import Pair, Side
from tieout.operators.compare import compare
from tieout.operators.drill import drill_matrix, worst_first


def rows_by_key(result):
    return {r["composite_key"]: r for r in result.rows.collect()}


def summary(result):
    return result.summary.first().asDict()


@pytest.fixture(scope="module")
def classification(spark):
    source = spark.createDataFrame([(2023, 100), (2024, 200), (2025, 50)], "Yr bigint, Amt bigint")
    target = spark.createDataFrame([(2023, 100), (2024, 190), (2026, 70)], "Year bigint, Total bigint")
    return source, target


def test_every_status_is_found(classification):
    result = compare(*classification, keys=[("Yr", "Year")], values=[("Amt", "Total")])
    found = {r["Year"]: (r["status"], r["Total_delta"]) for r in result.rows.collect()}
    assert found == {
        "2023": ("match", 0),
        "2024": ("mismatch", -10),
        "2025": ("onlySource", -50),
        "2026": ("onlyTarget", 70),
    }
    s = summary(result)
    assert (s["matched"], s["mismatched"], s["only_source"], s["only_target"]) == (1, 1, 1, 1)
    assert (s["source_keys"], s["target_keys"], s["refusal_kind"]) == (3, 3, None)


def test_worst_first_and_cap_after_ordering(spark):
    source = spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    target = source.withColumn("v", F.when(F.col("k") == 42, 9).otherwise(F.col("v")))
    result = compare(source, target, ["k"], ["v"])
    capped = result.worst_first(5).collect()
    assert len(capped) == 5 and capped[0]["k"] == "42"
    s = result.capped_summary(5).first()
    assert (s["matched"], s["mismatched"], s["total_rows"], s["rows_capped"]) == (99, 1, 100, True)


@pytest.mark.parametrize(
    "left, right, expected",
    [
        ("9007199254740993", "9007199254740992", -1),
        ("10000000000000010", "10000000000000000", -10),
        ("0.000000001", "0.000000002", Decimal("0.000000001")),
    ],
)
def test_differences_are_exact(spark, left, right, expected):
    make = lambda v: spark.createDataFrame([(1, Decimal(v))], "k int, v decimal(38,9)")
    row = compare(make(left), make(right), ["k"], ["v"]).rows.first()
    assert row["status"] == "mismatch" and row["v_delta"] == expected


def test_ledger_of_small_rows_is_not_lost(spark):
    big = [(1, Decimal(10) ** 16)]
    source = spark.createDataFrame(big + [(1, Decimal(1))] * 10, "k int, v decimal(38,9)")
    target = spark.createDataFrame(big, "k int, v decimal(38,9)")
    row = compare(source, target, ["k"], ["v"]).rows.first()
    assert row["v_delta"] == -10 and row["source_row_count"] == 11


def test_overflowing_sum_is_an_error_not_a_match(spark):
    huge = spark.createDataFrame([(1, Decimal(9) * Decimal(10) ** 28)] * 3, "k int, v decimal(38,9)")
    with pytest.raises(Exception, match="(?i)out.of.range|overflow|cannot be represented"):
        compare(huge, huge, ["k"], ["v"]).rows.collect()


SHAPES = [
    (("ABC   ", "string"), ("abc", "string"), True),
    (("\tabc ", "string"), ("abc", "string"), True),
    (("2024-01-01", "string"), (datetime(2024, 1, 1), "timestamp"), True),
    (("2024-01-01T00:00:00", "string"), ("2024-01-01", "string"), True),
    (("2024-01-01T23:30:00-02:00", "string"), ("2024-01-02", "string"), True),
    (("2024-01-01 01:00:00+0200", "string"), ("2023-12-31", "string"), True),
    (("2024-99-01T00:00:00Z", "string"), ("2024-99-01t00:00:00z", "string"), True),
    ((1, "int"), ("1", "string"), True),
    ((1, "int"), ("1.0", "string"), True),
    ((1.5, "double"), ("1.50", "string"), True),
    ((12345678.5, "double"), ("12345678.5", "string"), True),
    ((-0.0, "double"), ("0", "string"), True),
    (("-0.00", "string"), (0, "int"), True),
    (("007", "string"), (7, "int"), False),
    (("-012", "string"), (-12, "int"), False),
    (("0.5", "string"), (Decimal("0.5"), "decimal(10,3)"), True),
    (("100", "string"), (100, "bigint"), True),
    ((1, "int"), (True, "boolean"), True),
    ((None, "string"), ("null", "string"), False),
    ((None, "string"), ("", "string"), False),
    ((None, "string"), (None, "int"), True),
    ((float("nan"), "double"), (None, "int"), True),
    ((float("inf"), "double"), (None, "int"), True),
    (("12345678901234567890", "string"), ("12345678901234567891", "string"), False),
    (("0.1234567890123", "string"), ("0.1234567890124", "string"), False),
]


@pytest.mark.parametrize("left, right, same", SHAPES)
def test_key_shapes(spark, left, right, same):
    s = spark.createDataFrame([(left[0],)], f"k {left[1]}")
    t = spark.createDataFrame([(right[0],)], f"k {right[1]}")
    result = compare(s, t, ["k"], min_overlap=0)
    assert [r["status"] for r in result.rows.collect()] == (["match"] if same else ["onlySource", "onlyTarget"]) or (
        not same and {r["status"] for r in result.rows.collect()} == {"onlySource", "onlyTarget"}
    )


def test_case_and_time_are_kept_when_asked(spark):
    df = spark.createDataFrame([("Ab", datetime(2024, 1, 1, 5, 6, 7))], "a string, t timestamp_ntz")
    opts = Normalize(case_insensitive=False, granularity="datetime")
    row = df.select(
        normalize_key(F.col("a"), df.schema["a"].dataType, opts), normalize_key(F.col("t"), df.schema["t"].dataType, opts)
    ).first()
    assert list(row) == ["s:Ab", "t:2024-01-01T05:06:07"]


def test_timestamps_with_zone_are_read_in_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        s = spark.sql("select timestamp'2024-01-01 02:00:00Z' as k")
        t = spark.sql("select '2024-01-01T02:00:00Z' as k")
        n = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as k")
        assert compare(s, t, ["k"]).rows.first()["status"] == "match"
        assert compare(s, n, ["k"]).rows.first()["status"] == "match"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_composite_keys_do_not_collide(spark):
    s = spark.createDataFrame([("1", "23"), ("a|3:s:b", "c")], "a string, b string")
    t = spark.createDataFrame([("12", "3"), ("a", "b|3:s:c")], "a string, b string")
    result = compare(s, t, ["a", "b"], min_overlap=0)
    assert len({r["composite_key"] for r in result.rows.collect()}) == 4


def test_text_cells(spark):
    s = spark.createDataFrame(
        [(1, "2023-01-01"), (2, "x"), (3, "x"), (3, "y"), (4, "5"), (5, ""), (6, "7"), (7, "  ")], "k int, v string"
    )
    t = spark.createDataFrame(
        [(1, "2024-12-31"), (2, " X "), (3, "x"), (3, "y"), (4, "5.0"), (5, None), (6, "seven"), (7, None)], "k int, v string"
    )
    found = {r["k"]: (r["status"], r["v_source"], r["v_target"], r["v_delta"]) for r in compare(s, t, ["k"], ["v"]).rows.collect()}
    assert found["1"] == ("mismatch", "2023-01-01", "2024-12-31", None)
    assert found["2"][0] == "match"
    assert found["3"] == ("mismatch", "(multiple values)", "(multiple values)", None)
    assert found["4"] == ("match", "5", "5", 0)
    assert found["5"] == ("match", None, None, None)
    assert found["6"] == ("mismatch", "7", "seven", None)
    assert found["7"][0] == "mismatch"


def test_blank_counts_as_zero_but_shows_blank(spark):
    s = spark.createDataFrame([(1, None), (2, 0), (3, None)], "k int, v int")
    t = spark.createDataFrame([(1, 5), (2, None), (3, None)], "k int, v int")
    found = {r["k"]: (r["status"], r["v_source"], r["v_delta"]) for r in compare(s, t, ["k"], ["v"]).rows.collect()}
    assert found == {"1": ("mismatch", None, 5), "2": ("match", "0", 0), "3": ("match", None, None)}


def test_dates_and_not_a_number_compare_as_text(spark):
    s = spark.createDataFrame([(1, datetime(2024, 1, 1), float("nan")), (2, datetime(2024, 1, 2), 1.0)], "k int, d timestamp_ntz, f double")
    t = spark.createDataFrame([(1, "2024-01-01", float("nan")), (2, "2024-01-03", float("nan"))], "k int, d string, f double")
    found = {r["k"]: (r["d_status"], r["f_status"], r["f_source"]) for r in compare(s, t, ["k"], ["d", "f"]).rows.collect()}
    assert found == {"1": ("match", "match", "(blank)"), "2": ("mismatch", "mismatch", "1")}


@pytest.mark.parametrize(
    "tol, status",
    [
        (Tolerance(), "mismatch"),
        (DEFAULT, "mismatch"),
        (Tolerance(absolute=10), "match"),
        (Tolerance(absolute=9), "mismatch"),
        (Tolerance(relative=0.05), "match"),
        (Tolerance(relative=0.04), "mismatch"),
    ],
)
def test_tolerance(classification, tol, status):
    result = compare(*classification, keys=[("Yr", "Year")], values=[("Amt", "Total")], tolerance=tol)
    assert result.rows.where("Year = '2024'").first()["status"] == status


def test_relative_tolerance_with_zero_source_never_hides(spark):
    s = spark.createDataFrame([(1, 0)], "k int, v int")
    t = spark.createDataFrame([(1, 1)], "k int, v int")
    assert compare(s, t, ["k"], ["v"], tolerance=Tolerance(relative=1.0)).rows.first()["status"] == "mismatch"


def test_collapse_to_grain_and_duplicates(spark):
    df = spark.range(50_000).select((F.col("id") % 12).alias("k"), F.lit(1).alias("v"))
    s = summary(compare(df, df, ["k"], ["v"]))
    assert (s["matched"], s["source_rows"], s["source_duplicate_keys"], s["target_duplicate_keys"]) == (12, 50_000, 12, 12)


def test_refusals(spark, classification):
    source, target = classification
    keys, values = [("Yr", "Year")], [("Amt", "Total")]
    empty_s, empty_t = source.where("1 = 0"), target.where("1 = 0")

    def outcome(s, t, **kw):
        result = compare(s, t, keys, values, **kw)
        row = result.summary.first()
        return row["refusal_kind"], row["refusal_side"], result.rows.count(), row["matched"] + row["only_source"]

    assert outcome(Side(source, truncated=True), target) == ("truncated", "source", 0, 0)
    assert outcome(Side(source, truncated=True), Side(target, truncated=True))[:2] == ("truncated", "both")
    assert outcome(empty_s, empty_t) == ("emptyBothSides", None, 0, 0)
    assert outcome(source, target, max_keys=2) == ("grainTooFine", "both", 0, 0)
    assert outcome(source, target, max_keys=3)[0] is None
    assert outcome(source, target.withColumn("Year", -F.col("Year"))) == ("noKeyOverlap", None, 0, 0)
    assert outcome(source, empty_t) == (None, None, 3, 3)  # one empty side is a finding
    refused = compare(source, target.withColumn("Year", -F.col("Year")), keys, values)
    assert sorted(r["sample"] for r in refused.sample_keys("source").collect()) == ["2023", "2024", "2025"]
    assert refused.summary.first()["refused_source_keys"] == 3
    with pytest.raises(ValueError, match="source Nope"):
        compare(source, target, [("Nope", "Year")], values)


def test_sample_keys_start_with_the_shortest(spark):
    """Keys whose tagged text has ten characters or more come after the shorter ones."""
    source = spark.createDataFrame([(k,) for k in (0, 1, 2, 999999, 1000000, 123456789)], "k long")
    refused = compare(source, source.select((-F.col("k") - 1).alias("k")), ["k"])
    assert [r["sample"] for r in refused.sample_keys("target").collect()] == ["-1", "-2", "-3"]
    assert [r["sample"] for r in refused.sample_keys("target", 9).collect()][3:] == ["-1000000", "-1000001", "-123456790"]


def test_bracketed_names_and_drift(classification):
    source, target = classification
    target = target.withColumnRenamed("Total", "[Total]")
    result = compare(
        Side(source, executed_at=datetime(2024, 1, 1, 0, 0, 0)),
        Side(target, executed_at=datetime(2024, 1, 1, 0, 0, 2)),
        [("Yr", "Year")],
        [Pair("Amt", "Total")],
    )
    assert result.rows.count() == 4 and result.summary.first()["drift_ms"] == 2000


def test_keyless(spark, classification):
    source, target = classification
    result = compare(source, target, [], [("Amt", "Total")])
    assert [r["Total_delta"] for r in result.rows.collect()] == [10]
    nothing = compare(source.where("1=0"), target.where("1=0"), [], [("Amt", "Total")])
    assert nothing.summary.first()["refusal_kind"] == "emptyBothSides"
    assert [r["depth"] for r in drill_matrix(result).collect()] == [0]


FACTS = [("East", "2024-01-01", "007", 1, "100"), ("West", "2024-01-02", "008", 0, "250.5"),
         ("East", "2024-01-03", "009", 1, "75"), ("North", "2024-01-04", "010", 0, "0")]


@pytest.mark.parametrize("keys", [["Region"], ["Day"], ["Code"], ["Flag"], ["Region", "Day"], ["Region", "Day", "Code", "Flag"], []])
def test_same_facts_in_two_shapes_reconcile_to_zero(spark, keys):
    s = spark.createDataFrame(
        [(r + "   ", d + "T00:00:00", c, f, a) for r, d, c, f, a in FACTS], "Region string, Day string, Code string, Flag int, Amount string"
    )
    t = spark.createDataFrame(
        [(r.upper(), datetime.fromisoformat(d), c, bool(f), float(a)) for r, d, c, f, a in FACTS],
        "Region string, Day timestamp, Code string, Flag boolean, Amount double",
    )
    clean = summary(compare(s, t, keys, ["Amount"]))
    assert clean["mismatched"] + clean["only_source"] + clean["only_target"] == 0 and clean["matched"] > 0
    broken = t.withColumn("Amount", F.when(F.col("Code") == "008", 999.0).otherwise(F.col("Amount")))
    found = summary(compare(s, broken, keys, ["Amount"]))
    assert (found["mismatched"], found["only_source"], found["only_target"]) == (1, 0, 0)


def test_drill_matrix(spark):
    s = spark.createDataFrame([("a", 1, "x", 10), ("a", 2, "y", 20), ("b", 1, "z", 5), ("1", 1, "q", 1)], "p string, q int, t string, v int")
    t = spark.createDataFrame([("a", 1, "x", 11), ("b", 1, "z", 5), ("b", 2, "w", 7), ("1", 1, "q", 1)], "p string, q int, t string, v int")
    result = compare(s, t, ["p", "q"], ["v", "t"])
    nodes = {(r["p"], r["q"]): r for r in drill_matrix(result).collect()}
    assert len(nodes) == 3 + 5
    top = nodes[("a", None)]
    assert (top["depth"], top["leaves"], top["status"], top["v_delta"], top["t_source"]) == (1, 2, "onlySource", -19, None)
    assert nodes[("1", None)]["t_source"] == "q" and nodes[("1", None)]["status"] == "match"
    assert nodes[("b", None)]["status"] == "onlyTarget"
    assert worst_first(drill_matrix(result), result).first()["p"] == "a"


def test_cells_array(classification):
    row = compare(*classification, keys=[("Yr", "Year")], values=[("Amt", "Total")]).cells().where("status = 'mismatch'").first()
    assert row["key"] == ["2024"] and row["cells"][0]["label"] == "Total" and row["cells"][0]["delta"] == -10


def test_materialized_comparison_is_the_same(classification):
    pairing = dict(keys=[("Yr", "Year")], values=[("Amt", "Total")])
    lazy, kept = compare(*classification, **pairing), compare(*classification, **pairing, materialize=True)
    assert sorted(map(str, lazy.rows.collect())) == sorted(map(str, kept.rows.collect()))
    assert lazy.summary.first() == kept.summary.first()


def test_labels_must_not_collide(classification):
    with pytest.raises(ValueError, match="collide"):
        compare(*classification, keys=[("Yr", "Year", "status")], values=[("Amt", "Total")])
    with pytest.raises(ValueError, match="collide"):
        compare(*classification, keys=[("Yr", "Year")], values=[("Amt", "Total"), ("Yr", "Total")])


def test_rows_and_verdict_share_one_read_of_each_side(spark, tmp_path):
    """The verdict reuses the shuffle of the rows: each file is scanned once."""
    path = str(tmp_path / "t")
    spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")).write.parquet(path)
    rows = compare(spark.read.parquet(path), spark.read.parquet(path), ["k"], ["v"]).rows
    rows.collect()
    assert "ReusedExchange" in rows._jdf.queryExecution().executedPlan().toString()


def test_a_third_of_all_rows_on_one_key(spark):
    df = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").cast("double").alias("v")
    )
    changed = df.withColumn("v", F.col("v") + F.when(F.col("v") == 3, 0.5).otherwise(0.0))
    s = summary(compare(df, changed, ["k"], ["v"]))
    assert (s["matched"], s["mismatched"], s["source_rows"], s["source_duplicate_keys"]) == (60_000, 1, 90_000, 1)


def test_skipped_hours_of_the_session_zone_are_kept(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    moment = "2024-03-10 02:30:15"  # does not exist in New York
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        opts = Normalize(granularity="datetime")
        typed = spark.sql(f"select timestamp_ntz'{moment}.25' as k")
        for other in (spark.sql(f"select '{moment}' as k"), spark.sql("select '2024-03-10T02:30:15Z' as k"), typed):
            row = compare(typed, other, ["k"], normalize=opts).rows.first()
            assert (row["status"], row["k"]) == ("match", "2024-03-10T02:30:15")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
