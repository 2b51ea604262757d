"""Measures, date dimension, time intelligence, ranking and patterns, against brute force where it is easy."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tieout.functions.dates import bucket_label, week_of_year
from tieout.functions.numbers import nearly_equal, safe_divide, truncate_number, uniqueness
from tieout.model import Measure, Model, Rel
from tieout.operators import measures as M
from tieout.operators import patterns as P
from tieout.operators import ranking as R
from tieout.operators import timeintel as TI
from tieout.operators.datedim import date_dimension
from tieout.operators.fuzzy import fuzzy_join, match_score, plain


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([(100.0, 1, "East"), (200.0, 2, "West"), (300.0, 3, "East")], "Amount double, Qty int, Region string")


def test_evaluate(sales):
    amount = Measure("total", "sum", F.col("Amount"))
    east = amount.refine(M.predicate(F.col("Region"), "=", "east"), "east")
    row = M.evaluate(
        sales,
        [amount, east, east.refine(F.col("Qty") > 1, "east_big"), Measure("regions", "distinct", F.col("Region")),
         Measure("mean", "avg", F.col("Amount")), Measure("rows", "count_rows"), Measure("sumx", "sum", F.col("Amount") * F.col("Qty"))],
        derived={"share": lambda c: safe_divide(c["east"], c["total"]), "twice": lambda c: c["share"] * 2},
    ).first()
    assert (row["total"], row["east"], row["east_big"], row["regions"], row["mean"], row["rows"], row["sumx"]) == (600, 400, 300, 2, 200.0, 3, 1400)
    assert row["twice"] == pytest.approx(4 / 3)


def test_blanks_in_predicates_and_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("", None)], "t string, v double")
    assert df.where(M.predicate(F.col("t"), "<>", "a")).count() == 1
    row = M.evaluate(df, [Measure("s", "sum", F.col("v")), Measure("m", "avg", F.col("v")), Measure("n", "count", F.col("v")), Measure("r", "count_rows"), Measure("lo", "min", F.col("v"))]).first()
    assert tuple(row) == (3, 1.5, 2, 3, 1.0)
    assert df.select(M.truthy(F.col("t"), df.schema["t"].dataType)).collect() == [(True,), (False,), (False,)]
    with pytest.raises(ValueError):
        M.predicate(F.col("t"), "~", 1)


def test_lookup_keeps_orphans_and_grouping_agrees(spark):
    fact = spark.createDataFrame([(1, 10.0), (1, 5.0), (2, 1.0), (None, 7.0), (9, 2.0)], "fk int, v double")
    dim = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "pk int, name string")
    wide = M.lookup(fact, "fk", dim, "pk", ["name"], M.BLANK)
    assert {tuple(r) for r in M.evaluate(wide, [Measure("v", "sum", F.col("v"))], by=["name"]).collect()} == {("one", 15), ("two", 1), ("(blank)", 9)}
    for kind, expected in (("sum", {"one": 15, "two": 1, "—": 9}), ("avg", {"one": 7.5, "two": 1.0, "—": 4.5}), ("count", {"one": 2, "two": 1, "—": 2}),
                           ("max", {"one": 10.0, "two": 1.0, "—": 7.0}), ("distinct", {"one": 2, "two": 1, "—": 2})):
        points = M.group_by_dimension(fact, "fk", dim, "pk", F.col("name"), Measure("m", kind, F.col("v")))
        assert {r["label"]: r["value"] for r in points.collect()} == expected
    model = Model({"f": fact, "d": dim}, (Rel("f", "fk", "d", "pk"), Rel("f", "other", "d", "pk", active=False)))
    assert M.star(model, "f", ["d"]).where("name is null").count() == 2
    with pytest.raises(ValueError):
        model.active("d", "f")


def test_group_order_limit_and_selected_value(spark, sales):
    points = M.group_measure(sales, Measure("v", "sum", F.col("Amount")), F.col("Region"), top_n=1).collect()
    assert [(r["label"], r["value"]) for r in points] == [("East", 400)]
    assert M.selected_value(sales.where("Region = 'West'"), "Region", alternate="?").first()["selected"] == "West"
    assert M.selected_value(sales, "Region", alternate="?").first()["selected"] == "?"


def test_scalar_functions(spark):
    row = spark.range(1).select(
        safe_divide(F.lit(1), F.lit(0)), safe_divide(F.lit(1), F.lit(0), 7.0), truncate_number(F.lit(-2.7)),
        M.switch(F.lit(3), [(1, "a"), (3, "b")], "c"), M.switch(None, [(F.lit(False), "a")], "c"), M.text_join(F.lit("a"), F.lit(None).cast("string")),
        nearly_equal(F.lit(1e12), F.lit(1e12 + 1)), nearly_equal(F.lit(0.0), F.lit(1e-6)), uniqueness(F.lit(9), F.lit(3)),
        bucket_label(F.lit("2024-05-06").cast("date"), "quarter"), bucket_label(F.lit(None).cast("date"), "month"),
    ).first()
    assert tuple(row) == (None, 7.0, -2, "b", "c", "a", True, False, 1.0, "2024-Q2", "—")


def test_date_dimension(spark):
    fact = spark.createDataFrame([(date(2024, 2, 27),), (date(2025, 1, 2),)], "d date")
    rows = {r["Date"]: r for r in date_dimension(fact, "d", fiscal_start=7).collect()}
    assert len(rows) == 311
    leap = rows[date(2024, 2, 29)]
    assert (leap["MonthName"], leap["MonthShort"], leap["WeekdayName"], leap["WeekdayNo"], leap["Quarter"], leap["YearMonth"]) == ("February", "Feb", "Thursday", 4, "Q1", "2024-02")
    assert (rows[date(2024, 12, 30)]["WeekOfYear"], rows[date(2025, 1, 1)]["WeekOfYear"]) == (53, 1)
    assert (rows[date(2024, 6, 30)]["FiscalYear"], rows[date(2024, 7, 1)]["FiscalYear"]) == (2024, 2025)
    assert date_dimension(fact, "d", ["Year"]).columns == ["Date", "Year"]
    whole = date_dimension(fact, "d", ["Year"], fiscal_start=7, whole_years=True).agg(F.min("Date"), F.max("Date")).first()
    assert tuple(whole) == (date(2023, 7, 1), date(2025, 6, 30))
    assert date_dimension(fact.where("1 = 0"), "d").count() == 0
    week = spark.range(1).select(week_of_year(F.lit("2023-01-01").cast("date")), week_of_year(F.lit("2023-01-02").cast("date"))).first()
    assert tuple(week) == (1, 2)


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(7)
    rows, start = [], date(2023, 1, 25)
    for group in ("a", "b"):
        for i in range(500):
            if rng.random() < 0.4:
                for _ in range(rng.randint(1, 3)):
                    rows.append((group, start + timedelta(days=i), rng.randint(1, 40), Decimal(rng.randint(-500, 2000))))
    return rows, spark.createDataFrame(rows, "g string, d date, e int, v decimal(10,0)")


def back(day, months):
    y, m = divmod(day.year * 12 + day.month - 1 - months, 12)
    for last in (day.day, 30, 29, 28):
        try:
            return date(y, m + 1, min(day.day, last))
        except ValueError:
            continue


@pytest.mark.parametrize("span", [TI.Span(5, "day"), TI.Span(2, "week"), TI.Span(1, "month"), TI.Span(3, "month"), TI.Span(1, "quarter"), TI.Span(1, "year")])
def test_rolling_and_moving_average_match_brute_force(history, span):
    rows, df = history
    daily = {}
    for g, d, _, v in rows:
        daily[g, d] = daily.get((g, d), 0) + v
    step = lambda d: d - timedelta(days=span.days) if span.days else back(d, span.n * {"month": 1, "quarter": 3, "year": 12}[span.unit])
    inside = lambda g, low, high: [v for (h, d), v in daily.items() if h == g and low < d <= high]
    base = TI.totals(df, "d", F.col("v"), "day", ["g"])
    found = {(r["g"], r["period"]): r for r in TI.rolling(base, span, ["g"]).collect()}
    means = {(r["g"], r["period"]): r["moving_avg"] for r in TI.moving_average(base, span, ["g"]).collect()}
    assert len(found) == len(daily) == len(means)
    for (g, d), r in found.items():
        now, before = inside(g, step(d), d), inside(g, step(step(d)), step(d))
        assert r["rolling"] == sum(now)
        assert r["rolling_prior"] == (sum(before) if before else None)
        assert means[g, d] == pytest.approx(float(sum(now)) / len(now))


def test_prior_by_day_clamps_and_shares(spark):
    days = spark.createDataFrame([(date(2024, 2, 28), 1), (date(2024, 2, 29), 2), (date(2024, 3, 29), 3), (date(2024, 3, 31), 4), (date(2025, 2, 28), 5)], "period date, value int")
    found = {r["period"]: r["prior"] for r in TI.prior(days, "day", "month").collect()}
    assert found[date(2024, 3, 31)] == found[date(2024, 3, 29)] == 2 and found[date(2024, 2, 28)] is None
    yearly = {r["period"]: r["prior"] for r in TI.prior(days, "day", "year").collect()}
    assert yearly[date(2025, 2, 28)] == 1


def test_prior_leaves_gaps(spark):
    months = spark.createDataFrame([(date(2023, 1, 1), 1), (date(2023, 3, 1), 3), (date(2024, 1, 1), 9), (date(2023, 12, 1), 12)], "period date, value int")
    found = {r["period"]: (r["prior_month"], r["growth"]) for r in TI.period_growth(months, "month", "month").collect()}
    assert found[date(2023, 3, 1)] == (None, None) and found[date(2024, 1, 1)] == (12, -0.25)
    assert {r["period"]: r["prior"] for r in TI.prior(months, "month", "year").collect()}[date(2024, 1, 1)] == 1
    with pytest.raises(ValueError):
        TI.prior(months, "quarter", "month")


def test_activity(history, spark):
    rows, df = history
    active = {}
    for _, d, e, _ in rows:
        active.setdefault(d.replace(day=1), set()).add(e)
    found = {r["period"]: r for r in TI.activity_changes(df, "d", "e", "month").collect()}
    assert set(found) == set(active)
    seen = set()
    fresh = {r["period"]: (r["new_entities"], r["cumulative_entities"]) for r in TI.cumulative_distinct(df, "d", "e", "month").collect()}
    for month in sorted(active):
        before = active.get(back(month, 1), set())
        r = found[month]
        assert (r["active"], r["prior_active"], r["churned"], r["retained"]) == (
            len(active[month]), len(before), len(before - active[month]), len(before & active[month]))
        new = active[month] - seen
        seen |= new
        assert fresh[month] == (len(new), len(seen))


def test_suite_for_a_field(history):
    _, df = history
    out = TI.field_suite(df, "d", F.col("v"), ["g"])
    assert set(out.columns) == {"g", "period", "total", "ytd", "qtd", "mtd", "running", "prior_year", "yoy_pct", "mom_pct", "moving_avg", "average", "pct_total", "rank"}
    shares = out.groupBy("period").agg(F.sum("pct_total").alias("s"), F.count("*").alias("n"))
    assert all(abs(r["s"] - 1) < 1e-9 for r in shares.where("n = 2").collect())
    with pytest.raises(ValueError):
        TI.measure_suite(TI.totals(df, "d", F.col("v")), kinds=["rank"])


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_ranking_matches_sorting(spark, slices):
    rng = random.Random(slices)
    values = [rng.choice([None, 5, 5, 5, rng.randint(0, 50)]) for _ in range(300)]  # 5 is a hot value
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    order = sorted({v for v in values if v is not None}, reverse=True)
    ranks = {r["i"]: r["rank"] for r in R.dense_rank(df, "v", slices=slices).collect()}
    assert ranks == {i: (order.index(v) + 1 if v is not None else len(order) + 1) for i, v in enumerate(values)}
    places = {r["i"]: r["position"] for r in R.row_positions(df, "v", ["i"], slices=slices).collect()}
    expected = sorted(range(300), key=lambda i: (values[i] is None, values[i] or 0, i))
    assert [i for i, _ in sorted(places.items(), key=lambda p: p[1])] == expected
    top = {(r["i"], r["rank"]) for r in R.top_members(df, "v", 10).collect()}
    ordered = sorted((v for v in values if v is not None), reverse=True)
    assert top == {(i, ordered.index(v) + 1) for i, v in enumerate(values) if v is not None and v >= ordered[9]}


def test_row_offsets(spark):
    df = spark.createDataFrame([(date(2024, m, 1), m * m) for m in range(1, 9)], "period date, value int")
    previous = [r["previous"] for r in R.previous_row(df, "period", [], "value").orderBy("period").collect()]
    assert previous == [None, 1, 4, 9, 16, 25, 36, 49]
    assert [r["window_sum"] for r in R.row_window(df, "period", [], "value").orderBy("period").collect()][:4] == [1, 5, 14, 29]
    assert {r["first_value"] for r in R.first_row(df, "period", [], "value").collect()} == {1}
    assert sum(r["share"] for r in R.share_of_total(df, "value").collect()) == pytest.approx(1)


def test_patterns(spark):
    months = spark.createDataFrame([(date(2024, m, 1), v) for m, v in enumerate([100, 80, -5, -50, 60, 57], 1)], "period date, value int")
    row = P.trend(months).first()
    assert (row["first_value"], row["last_value"], row["change"]) == (100, 57, -0.43)
    assert (row["drop_from"], row["drop_to"], row["steepest_drop"]) == (date(2024, 2, 1), date(2024, 3, 1), pytest.approx(-1.0625))
    tiers = spark.createDataFrame([(1000,), (999,), (100,), (99,)], "v int").select(P.tier(F.col("v")).alias("t"))
    assert [r["t"] for r in tiers.collect()] == ["High", "Medium", "Low", "Very Low"]
    lines = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 30.0), (3, None)], "o int, v double")
    assert P.per_order(lines, "o", F.col("v")).first()["per_order"] == 20.0
    assert P.per_order(lines, None, F.col("v")).first()["orders"] == 4
    assert P.threshold_entities(lines, "o", F.sum("v"), ">=", 30).first()["entities"] == 2
    weights = spark.createDataFrame([(10.0, 1.0), (20.0, 3.0), (99.0, None)], "x double, w double")
    assert P.weighted_average(weights, F.col("x"), F.col("w")).first()["weighted_avg"] == 17.5
    assert P.variance(lines, F.col("v"), F.lit(0)).first()["variance_pct"] is None
    members = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "m string, value int")
    assert [r["m"] for r in P.contributors(members, weakest=True, top_n=2).collect()] == ["c", "b"]


def test_fuzzy_values(spark):
    regions = spark.createDataFrame([("West",), ("East",), ("North America",), (None,)], "r string")
    asked = spark.createDataFrame([("west",), ("wst",), ("america",), ("northamerca",), ("zzz",), ("the west side",), ("",)], "q string")
    found = {r["q"]: (r["matched_value"], r["match_score"]) for r in fuzzy_join(asked, "q", regions, "r").collect()}
    assert found["west"] == ("West", 1.0) and found["america"] == ("North America", 0.82)
    assert found["northamerca"][0] == "North America" and found["northamerca"][1] == pytest.approx((1 - 1 / 12) * 0.78)
    assert found["wst"] == (None, None) and found["zzz"] == (None, None) and found[""] == (None, None)
    by_word = {r["q"]: r["matched_value"] for r in fuzzy_join(asked, "q", regions, "r", by_word=True).collect()}
    assert by_word["the west side"] == "West"


def test_fuzzy_join_misses_no_accepted_pair(spark):
    import random

    chance = random.Random(4)
    word = lambda n: "".join(chance.choice("abcd") for _ in range(n))
    values = sorted({word(chance.randint(1, 12)) for _ in range(150)})

    def edited(v):
        letters = list(v)
        for _ in range(chance.randint(0, 3)):
            letters.insert(chance.randint(0, len(letters)), chance.choice("abcd")) if chance.random() < 0.5 else letters and letters.pop(chance.randrange(len(letters)))
        return "".join(letters)

    asked = spark.createDataFrame([(edited(chance.choice(values)),) for _ in range(200)], "q string").distinct()
    known = spark.createDataFrame([(v,) for v in values], "r string")
    for accept in (0.55, 0.62, 0.8, 0.9):
        got = {r["q"]: (r["matched_value"], r["match_score"]) for r in fuzzy_join(asked, "q", known, "r", accept=accept).collect()}
        every = asked.join(known, how="cross").select("q", "r", match_score(plain(F.col("q")), plain(F.col("r"))).alias("s")).collect()
        want = {r["q"]: (None, None) for r in every}
        for r in sorted(every, key=lambda r: (-r["s"], r["r"])):
            if r["s"] >= accept and want[r["q"]] == (None, None) and len(r["q"]) > 1:
                want[r["q"]] = (r["r"], r["s"])
        assert got == want


def test_filters_of_measures_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "b"), (3, 5.0, "c")], "k int, v double, s string").write.parquet(path)
    df = spark.read.parquet(path)
    whole = M.Measure("v", "sum", F.col("v"))
    one, other = whole.refine(F.col("k") > 1, "one"), whole.refine(F.col("s") == "a", "other")
    found = M.evaluate(df, [one, other])
    plan = found._jdf.queryExecution().toString()
    assert "GreaterThan(k,1)" in plan and "EqualTo(s,a)" in plan
    assert tuple(found.first()) == (8, 2)
    assert tuple(M.evaluate(df, [one.refine(F.col("k") > 9)]).first()) == (None,)
    assert M.evaluate(df, [one, whole]).first()["v"] == 10


def test_fuzzy_candidates_of_names_with_one_start(spark):
    """Names that differ in their last digits: a request meets few names, not all."""
    from tieout.operators import fuzzy as Z

    names = spark.range(3000).select(F.format_string("Customer#%09d", F.col("id") * 37).alias("name"))
    plain_names = names.select(plain(F.col("name")).alias("k"))
    asked = plain_names.withColumnRenamed("k", "w")
    assert Z._inside(asked, "w", plain_names, "k").count() < 40 * 3000
    assert Z._one_edit(asked, plain_names).count() < 40 * 3000
    typed = names.select(F.concat(F.lit("x"), F.lower("name")).alias("typed"), F.concat(F.substring("name", 1, 8), F.lit("?"), F.substring("name", 10, 99)).alias("equal"), "name")
    for column, score in (("equal", 1.0), ("typed", 0.82)):
        got = Z.fuzzy_join(typed, column, names, "name")
        assert got.where((F.col("matched_value") == F.col("name")) & (F.col("match_score") == score)).count() == 3000
