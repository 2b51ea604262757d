"""Generated checks, suites, proposals and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieout.model import Measure, Side
from tieout.operators import checks as C
from tieout.operators.compare import compare
from tieout.plans import gate as G
from tieout.plans import propose as P
from tieout.plans import suite as S
from tieout.queries.reconcile import BUMPED_SQL, bumped, edited
from tieout.queries.registry import m, money, query, ratio, text, total
from tieout.sources.catalogue import describe


@query("SELECT CAST(COUNT(*) AS BIGINT) AS row_count FROM lineitem")
def check_row_count(t):
    return C.row_count(t.lineitem)


@query("SELECT CAST(COUNT(DISTINCT nullif(o_custkey % 50, 0)) AS BIGINT) AS distinct_values FROM orders")
def check_distinct(t):
    return C.distinct_values(t.orders.select(F.nullif(F.col("o_custkey") % 50, F.lit(0)).alias("g")), "g")


@query("SELECT CAST(COUNT(DISTINCT nullif(o_custkey % 50, 0)) + 1 AS BIGINT) AS distinct_values FROM orders")
def check_distinct_with_blank(t):
    return C.distinct_values(t.orders.select(F.nullif(F.col("o_custkey") % 50, F.lit(0)).alias("g")), "g", include_blank=True)


@query("SELECT CAST(COUNT(*) FILTER (nullif(o_custkey % 50, 0) IS NULL) AS BIGINT) AS blanks FROM orders")
def check_nulls(t):
    return C.null_count(t.orders.select(F.nullif(F.col("o_custkey") % 50, F.lit(0)).alias("g")), "g")


@query(
    """SELECT 'l_returnflag' AS "column", CAST(COUNT(*) AS BIGINT) AS rows, CAST(COUNT(*) FILTER (l_returnflag = 'R') AS BIGINT) AS blanks FROM lineitem
    UNION ALL SELECT 'l_quantity', COUNT(*), 0 FROM lineitem"""
)
def check_all_nulls(t):
    holed = t.lineitem.select(F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag"), "l_quantity")
    return C.table_counts(holed)


@query(
    """SELECT CAST(COUNT(*) AS BIGINT) AS duplicate_keys, CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS extra_rows
    FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)"""
)
def check_duplicates(t):
    return C.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT CAST(0 AS BIGINT) AS duplicate_keys, CAST(0 AS BIGINT) AS extra_rows")
def check_duplicates_clean(t):
    return C.duplicate_keys(t.orders, ["o_orderkey"])


@query(
    """SELECT CAST(MIN(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_date, CAST(MAX(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_date,
      CAST(COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders"""
)
def check_date_coverage(t):
    days = C.date_coverage(t.orders.select(F.col("o_orderdate").cast("date").alias("d")), "d")
    return days.select(text("first_date").alias("first_date"), text("last_date").alias("last_date"), "days")


@query("SELECT p_brand AS value, CAST(COUNT(*) AS BIGINT) AS frequency FROM part GROUP BY 1")
def check_value_set(t):
    return C.value_set(t.part, "p_brand")


@query(
    """WITH s AS (SELECT p_brand AS b, COUNT(*) AS n FROM part GROUP BY 1),
        t AS (SELECT CASE WHEN p_brand = 'Brand#7' THEN 'Brand#77' ELSE p_brand END AS b, COUNT(*) AS n FROM part WHERE p_brand <> 'Brand#9' GROUP BY 1)
    SELECT lower(COALESCE(s.b, t.b)) AS value,
      CASE WHEN t.n IS NULL THEN 'onlySource' WHEN s.n IS NULL THEN 'onlyTarget' WHEN s.n = t.n THEN 'match' ELSE 'mismatch' END AS status
    FROM s FULL OUTER JOIN t ON s.b = t.b"""
)
def check_value_set_difference(t):
    target = t.part.where("p_brand <> 'Brand#9'").withColumn("p_brand", F.when(F.col("p_brand") == "Brand#7", "Brand#77").otherwise(F.col("p_brand")))
    return compare(C.value_set(t.part, "p_brand"), C.value_set(target, "p_brand"), ["value"], ["frequency"]).rows.select("value", "status")


@query(
    """SELECT CAST(COUNT(*) AS BIGINT) AS orphans, CAST(COUNT(DISTINCT l_partkey) AS BIGINT) AS orphan_keys FROM lineitem
    WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey > 100)"""
)
def check_orphans(t):
    return C.orphan_keys(t.lineitem, "l_partkey", t.part.where("p_partkey > 100"), "p_partkey")


@query(
    f"SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, {m(total('o_totalprice'))} AS value FROM orders GROUP BY ALL"
)
def check_by_grain(t):
    grain = C.by_grain(t.orders, [F.year("o_orderdate").alias("year"), "o_orderstatus"], "o_totalprice")
    return grain.withColumn("value", money("value"))


@query("SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS value FROM lineitem GROUP BY ALL")
def check_rows_by_grain(t):
    return C.by_grain(t.lineitem, ["l_returnflag", "l_linestatus"])


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def keys_except(t):
    o = t.orders
    return C.only_left(o.where("o_orderstatus = 'F'").select("o_custkey"), o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def keys_intersect(t):
    o = t.orders
    return C.in_both(o.where("o_orderstatus = 'F'").select("o_custkey"), o.where("o_orderstatus = 'P'").select("o_custkey"))


def checks(t) -> list[S.Check]:
    """A small suite over the orders and an edited copy of them."""
    o, changed = t.orders, edited(t.orders).withColumn("o_totalprice", bumped())
    months = lambda df: C.by_grain(df, [F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")], "o_totalprice")
    dates = lambda df: C.date_coverage(df.select(F.col("o_orderdate").cast("date").alias("d")), "d")
    return [
        S.Check("c1", "orders — row count", C.row_count(o), C.row_count(changed), values=("row_count",), table="orders"),
        S.Check("c2", "orders — o_orderdate range", dates(o), dates(changed), values=("first_date", "last_date", "days"), table="orders"),
        S.Check("c3", "orders — duplicates", C.duplicate_keys(o, ["o_orderkey"]), C.duplicate_keys(changed, ["o_orderkey"]),
                values=("duplicate_keys", "extra_rows"), table="orders"),
        S.Check("c4", "month totals", months(o), months(changed), keys=("year", "month"), values=("value",)),
        S.Check("c5", "wrong pairing", o.select(F.col("o_orderkey").alias("k")), o.select((-F.col("o_orderkey") - 1).alias("k")), keys=("k",)),
        S.Check("c6", "switched off", C.row_count(o), C.row_count(o), values=("row_count",), enabled=False),
    ]


SUITE = f"""
  WITH e AS (SELECT * REPLACE ({BUMPED_SQL} AS o_totalprice) FROM orders WHERE month(o_orderdate) <> 7),
  ms AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS mo, {total('o_totalprice')} AS v FROM orders GROUP BY ALL),
  mt AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS mo, {total('o_totalprice')} AS v FROM e GROUP BY ALL),
  mj AS (SELECT CASE WHEN mt.v IS NULL THEN 'onlySource' WHEN ABS(ms.v - mt.v) <= 0.000001 THEN 'match' ELSE 'mismatch' END AS st
         FROM ms LEFT JOIN mt ON ms.y = mt.y AND ms.mo = mt.mo),
  d AS (SELECT (SELECT COUNT(DISTINCT CAST(o_orderdate AS DATE)) FROM orders) AS a, (SELECT COUNT(DISTINCT CAST(o_orderdate AS DATE)) FROM e) AS b),
  runs AS (
    SELECT 'c1' AS check_id, 'orders' AS table_name, CASE WHEN (SELECT COUNT(*) FROM e) = COUNT(*) THEN 'pass' ELSE 'fail' END AS status,
      1 AS compared_rows, 1 AS source_rows, 1 AS target_rows FROM orders
    UNION ALL SELECT 'c2', 'orders', CASE WHEN a = b THEN 'pass' ELSE 'fail' END, 1, 1, 1 FROM d
    UNION ALL SELECT 'c3', 'orders', 'pass', 1, 1, 1
    UNION ALL SELECT 'c4', 'Other checks', CASE WHEN bool_and(st = 'match') THEN 'pass' ELSE 'fail' END, COUNT(*),
      (SELECT COUNT(*) FROM ms), (SELECT COUNT(*) FROM mt) FROM mj
    UNION ALL SELECT 'c5', 'Other checks', 'inconclusive', 0, COUNT(*), COUNT(*) FROM orders)"""


@query(
    SUITE + """ SELECT check_id, table_name, status, CAST(compared_rows AS BIGINT) AS compared_rows,
      CAST(source_rows AS BIGINT) AS source_rows, CAST(target_rows AS BIGINT) AS target_rows FROM runs"""
)
def suite_runs(t):
    return S.suite_frame(checks(t)).select("check_id", "table_name", "status", "compared_rows", "source_rows", "target_rows")


@query(
    SUITE + """ SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 'pass') AS passed, COUNT(*) FILTER (status = 'fail') AS failed,
      COUNT(*) FILTER (status = 'inconclusive') AS inconclusive,
      COUNT(*) FILTER (status = 'pass') || ' passed · ' || COUNT(*) FILTER (status = 'fail') || ' failed · '
        || COUNT(*) FILTER (status = 'inconclusive') || ' could not run' AS verdict FROM runs"""
)
def suite_verdict(t):
    return S.suite_summary(S.suite_frame(checks(t)))


@query(
    SUITE + """ SELECT table_name, COUNT(*) AS checks, COUNT(*) FILTER (status = 'pass') AS passed,
      COUNT(*) FILTER (status = 'fail') AS failed, COUNT(*) FILTER (status = 'inconclusive') AS inconclusive FROM runs GROUP BY 1"""
)
def suite_by_table(t):
    return S.by_table(S.suite_frame(checks(t)))


@query(
    SUITE + """ SELECT check_id, table_name, status, CAST(CASE WHEN check_id = 'c5' THEN 1 ELSE 0 END AS BIGINT) AS refused FROM runs
      UNION ALL SELECT 'c7', 'Other checks', 'inconclusive', 0 UNION ALL SELECT 'c8', 'lineitem', 'inconclusive', 0"""
)
def suite_isolated(t):
    """Each check as a job of its own: a broken query and a missing column spoil only their own check."""
    broken = lambda: t.spark.table("no_such_table")
    failing = [
        S.Check("c7", "broken query", broken, broken, values=("n",)),
        S.Check("c8", "missing column", C.row_count(t.lineitem), C.row_count(t.lineitem), values=("gone",), table="lineitem"),
    ]
    runs = S.run_suite(t.spark, checks(t) + failing)
    return runs.select("check_id", "table_name", "status", F.col("refusal_kind").isNotNull().cast("bigint").alias("refused"))


@query(
    """WITH e AS (SELECT * FROM orders WHERE month(o_orderdate) <> 7)
    SELECT 'orders' AS "table", 'row count' AS "check", 'Failed' AS status, 'row_count' AS metric,
      format('{:,}', (SELECT COUNT(*) FROM orders)) AS source_value, format('{:,}', (SELECT COUNT(*) FROM e)) AS target_value,
      format('{:,}', (SELECT COUNT(*) FROM e) - (SELECT COUNT(*) FROM orders)) AS difference
    UNION ALL SELECT 'orders', 'duplicates', 'Passed', 'duplicate_keys', '0', '0', '0'
    UNION ALL SELECT 'orders', 'duplicates', 'Passed', 'extra_rows', '0', '0', '0'
    UNION ALL SELECT 'orders', 'o_orderdate range', 'Failed', 'first_date', (SELECT CAST(CAST(MIN(o_orderdate) AS DATE) AS VARCHAR) FROM orders),
      (SELECT CAST(CAST(MIN(o_orderdate) AS DATE) AS VARCHAR) FROM e), '—'
    UNION ALL SELECT 'orders', 'o_orderdate range', 'Failed', 'last_date', (SELECT CAST(CAST(MAX(o_orderdate) AS DATE) AS VARCHAR) FROM orders),
      (SELECT CAST(CAST(MAX(o_orderdate) AS DATE) AS VARCHAR) FROM e), '—'
    UNION ALL SELECT 'orders', 'o_orderdate range', 'Failed', 'days', format('{:,}', (SELECT COUNT(DISTINCT CAST(o_orderdate AS DATE)) FROM orders)),
      format('{:,}', (SELECT COUNT(DISTINCT CAST(o_orderdate AS DATE)) FROM e)),
      format('{:,}', (SELECT COUNT(DISTINCT CAST(o_orderdate AS DATE)) FROM e) - (SELECT COUNT(DISTINCT CAST(o_orderdate AS DATE)) FROM orders))
    UNION ALL SELECT 'Other checks', 'month totals', 'Failed', '', '', '', ''
    UNION ALL SELECT 'Other checks', 'wrong pairing', 'Could not run', '', '', '', ''"""
)
def suite_evidence(t):
    return S.evidence(S.suite_frame(checks(t))).select(
        "table", "check", "status", "metric", "source_value", "target_value", "difference"
    )


@query(
    """SELECT o_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS at FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_custkey DESC, o_orderkey DESC) AS nth FROM orders) WHERE nth = 1"""
)
def latest_run_per_pair(t):
    log = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("at"))
    return S.latest_runs(log, ["o_custkey"], "at").withColumn("at", text("at"))


@query(
    """SELECT o_custkey, CAST(epoch(r.read_at) - epoch(f.refreshed_at) AS BIGINT) AS age_seconds
    FROM (SELECT o_custkey, MAX(o_orderdate) AS read_at FROM orders GROUP BY 1) r
    LEFT JOIN (SELECT o_custkey, MAX(o_orderdate) AS refreshed_at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f USING (o_custkey)"""
)
def snapshot_freshness(t):
    reads = t.orders.select("o_custkey", F.col("o_orderdate").alias("read_at"))
    refreshes = t.orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderdate").alias("refreshed_at"))
    return S.freshness(reads, refreshes, "o_custkey", "read_at", "refreshed_at").select("o_custkey", "age_seconds")


@query(
    """SELECT CAST(ABS(epoch_ms(MAX(o_orderdate)) - epoch_ms(MIN(o_orderdate))) AS BIGINT) AS drift_ms FROM orders"""
)
def read_drift(t):
    """The first and the last order's days as the times of two reads, whose distance the comparison reports."""
    ends = t.orders.agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last")).first()
    sides = [Side(t.orders, executed_at=at) for at in ends]
    return compare(*sides, ["o_orderkey"], ["o_totalprice"]).summary.select("drift_ms")


CATALOGUE_KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "lineitem": ["l_orderkey", "l_linenumber"]}


def catalogue(t):
    return describe(t.spark, t.star(), CATALOGUE_KEYS)


def targets(t):
    rows = [
        ("Orders", "query", None, False), ("Fact_Lines", "query", "lineitem", True), ("Customer", "query", "customer", False),
        ("Calendar", "calculated", None, False), ("Budget", "query", None, False), ("Measures", "none", None, False),
    ]
    return t.spark.createDataFrame(rows, "table string, kind string, reads_from string, filtered boolean")


def target_relationships(t):
    rows = [
        ("Orders", "o_custkey", "Customer", "c_custkey", True), ("Fact_Lines", "l_orderkey", "Orders", "o_orderkey", True),
        ("Fact_Lines", "l_shipdate", "Calendar", "Date", True), ("Fact_Lines", "l_suppkey", "Orders", "o_orderkey", False),
        ("Orders", "o_missing", "Customer", "c_custkey", True),
    ]
    return t.spark.createDataFrame(rows, "from_table string, from_col string, to_table string, to_col string, active boolean")


def proposals(t):
    return P.propose_checks(targets(t), catalogue(t), target_relationships(t))


@query(
    """WITH pairs AS (SELECT 'row count' AS what, 'Orders' AS "table", (SELECT COUNT(*) FROM orders) AS a
      UNION ALL SELECT 'row count', 'Fact_Lines', (SELECT COUNT(*) FROM lineitem)
      UNION ALL SELECT 'row count', 'Customer', (SELECT COUNT(*) FROM customer)
      UNION ALL SELECT 'duplicates', 'Orders', 0
      UNION ALL SELECT 'duplicates', 'Customer', 0
      UNION ALL SELECT 'duplicates', 'Fact_Lines', (SELECT COUNT(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1))
      UNION ALL SELECT 'days', 'Orders', (SELECT COUNT(DISTINCT o_orderdate) FROM orders)
      UNION ALL SELECT 'days', 'Fact_Lines', (SELECT COUNT(DISTINCT l_shipdate) FROM lineitem)
      UNION ALL SELECT 'orphans', 'Orders', (SELECT COUNT(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
      UNION ALL SELECT 'orphans', 'Fact_Lines', (SELECT COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)))
    SELECT what, "table", CAST(a AS BIGINT) AS found FROM pairs"""
)
def proposed_checks_run(t):
    """Every proposal turned into its check and run over the whole source table."""
    tables, frames = t.star(), []
    for p in proposals(t).collect():  # one row per proposed check
        df = tables[p["object"]]
        if p["kind"] == "rowCount":
            found, what = C.row_count(df).select(F.col("row_count").alias("found")), "row count"
        elif p["kind"] == "dateRange":
            found, what = C.date_coverage(df, p["columns"]).select(F.col("days").alias("found")), "days"
        elif p["kind"] == "duplicates":
            found, what = C.duplicate_keys(df, p["columns"].split(" + ")).select(F.col("duplicate_keys").alias("found")), "duplicates"
        else:
            dim, key = p["other"].split(".")
            found, what = C.orphan_keys(df, p["columns"], tables[dim.lower()], key).select(F.col("orphans").alias("found")), "orphans"
        frames.append(found.select(F.lit(what).alias("what"), F.lit(p["table"]).alias("table"), "found"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def line_measures() -> list[Measure]:
    return [
        Measure("quantity", "sum", F.col("l_quantity")),
        Measure("revenue", "sum", F.col("l_extendedprice") * (1 - F.col("l_discount"))),
        Measure("lines", "count_rows"),
        Measure("mean_tax", "avg", F.col("l_tax")),
    ]


def recorded_totals(t):
    """Totals recorded from the table; one of them has drifted and one is allowed no slack."""
    totals = G.control_totals(t.lineitem, line_measures())
    drifted = F.when(F.col("measure") == "revenue", F.col("actual") * 1.01).when(F.col("measure") == "quantity", F.col("actual") * 1.0005)
    return totals.select(
        "measure", F.coalesce(drifted, F.col("actual")).alias("expected"), F.when(F.col("measure") == "lines", 0.0).alias("tolerance")
    )


TOTALS = f"""
  WITH a AS (SELECT CAST({total('l_quantity')} AS DOUBLE) AS q, CAST({total('l_extendedprice * (1 - l_discount)')} AS DOUBLE) AS r,
      CAST(COUNT(*) AS DOUBLE) AS n, CAST({total('l_tax')} AS DOUBLE) / COUNT(*) AS x FROM lineitem),
  c AS (SELECT 'quantity' AS measure, q * 1.0005 AS expected, q AS actual, NULL AS tol FROM a
    UNION ALL SELECT 'revenue', r * 1.01, r, NULL FROM a UNION ALL SELECT 'lines', n, n, 0.0 FROM a UNION ALL SELECT 'mean_tax', x, x, NULL FROM a),
  v AS (SELECT measure, expected, actual, COALESCE(tol, GREATEST(1.0, ABS(expected) * 0.001)) AS allowed FROM c)"""


@query(TOTALS + " SELECT measure, round(expected, 4) AS expected, round(actual, 4) AS actual, ABS(actual - expected) <= allowed AS ok FROM v")
def control_totals_verified(t):
    checked = G.verify_totals(recorded_totals(t), t.lineitem, line_measures())
    return checked.select("measure", ratio("expected", 4).alias("expected"), ratio("actual", 4).alias("actual"), "ok")


@query(
    TOTALS + """ SELECT CASE WHEN bool_and(ABS(actual - expected) <= allowed) THEN 'green' ELSE 'red' END AS gate,
      CAST(COUNT(*) FILTER (ABS(actual - expected) <= allowed) AS BIGINT) AS reconciled, CAST(COUNT(*) AS BIGINT) AS checked FROM v"""
)
def control_totals_gate(t):
    return G.gate(G.verify_totals(recorded_totals(t), t.lineitem, line_measures()))


@query(
    """WITH a AS (SELECT l_orderkey, SUM(l_quantity) AS q, SUM(l_quantity * l_discount) AS d FROM lineitem GROUP BY 1),
      p AS (SELECT l_orderkey, l_returnflag, SUM(l_quantity) AS q, SUM(l_discount * l_quantity) AS d FROM lineitem GROUP BY 1, 2),
      b AS (SELECT l_orderkey, SUM(q) AS q, SUM(d) AS d FROM p GROUP BY 1)
    SELECT CAST(COUNT(*) AS BIGINT) AS differing FROM a FULL OUTER JOIN b ON a.l_orderkey = b.l_orderkey
    WHERE a.l_orderkey IS NULL OR b.l_orderkey IS NULL OR ABS(a.q - b.q) / GREATEST(ABS(a.q), ABS(b.q), 1) >= 1e-9
      OR ABS(a.d - b.d) / GREATEST(ABS(a.d), ABS(b.d), 1) >= 1e-9"""
)
def variant_equal(t):
    """The same totals by two routes: filtered inside the aggregate, and aggregated per flag first."""
    direct = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum(F.col("l_quantity") * F.col("l_discount")).alias("d"))
    parts = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"), F.sum(F.col("l_discount") * F.col("l_quantity")).alias("d"))
    staged = parts.groupBy("l_orderkey").agg(F.sum("q").alias("q"), F.sum("d").alias("d"))
    return G.variants_agree(direct, staged, ["l_orderkey"]).agg(F.count(F.lit(1)).alias("differing"))


@query(
    """SELECT o_custkey, CAST(1 AS BIGINT) AS left_rows, CAST(1 AS BIGINT) AS right_rows FROM orders GROUP BY 1
    HAVING SUM(CAST(o_totalprice AS DECIMAL(38,9))) <> SUM(CAST(""" + BUMPED_SQL + """ AS DECIMAL(38,9)))"""
)
def variant_differs(t):
    left = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    right = t.orders.groupBy("o_custkey").agg(F.sum(bumped()).alias("v"))
    return G.variants_agree(left, right, ["o_custkey"]).select("o_custkey", "left_rows", "right_rows")


