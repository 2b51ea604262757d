"""Comparisons of the orders and lines with edited copies of themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.functions.cells import Tolerance
from tieout.functions.normalize import composite_key, normalize_key
from tieout.model import Side
from tieout.operators.compare import Comparison, compare
from tieout.operators.drill import drill_matrix
from tieout.queries.registry import m, money, query, total
from tieout.sources.queries import capped

# The edits, stated once for Spark and once for SQL.
BUMPED_SQL = "o_totalprice + CASE WHEN o_orderkey % 500 = 0 THEN 1000 ELSE 0 END"


def bumped() -> Column:
    return F.col("o_totalprice") + F.when(F.col("o_orderkey") % 500 == 0, 1000).otherwise(0)


def monthly(orders: DataFrame, value: Column | None = None) -> DataFrame:
    value = F.col("o_totalprice") if value is None else value
    return orders.select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), value.alias("total"))


def edited(orders: DataFrame) -> DataFrame:
    return orders.where(F.month("o_orderdate") != 7)


def month_comparison(t) -> Comparison:
    return compare(monthly(t.orders), monthly(edited(t.orders), bumped()), ["year", "month"], ["total"])


def shown(result: Comparison, digits: int = 2) -> DataFrame:
    """A comparison as flat columns of plain types."""
    return flat(result.rows, result, digits)


def flat(rows: DataFrame, result: Comparison, digits: int = 2) -> DataFrame:
    out = [F.col(k) for k in result.keys] + [F.col("status"), F.col("source_row_count"), F.col("target_row_count")]
    for v in result.values:
        out += [
            money(f"{v}_source_num", digits).alias(f"{v}_source"),
            money(f"{v}_target_num", digits).alias(f"{v}_target"),
            money(f"{v}_delta", digits).alias(f"{v}_delta"),
        ]
    return rows.select(*out)


def grain(select: str, keys: list[str]) -> str:
    by = ", ".join(keys)
    group = f"GROUP BY {by}" if keys else "HAVING COUNT(*) > 0"
    comma = f"{by}, " if keys else ""
    return f"SELECT {comma}COUNT(*) AS n, {total('v')} AS v FROM ({select}) GROUP BY ALL" if keys else (
        f"SELECT COUNT(*) AS n, {total('v')} AS v FROM ({select}) {group}"
    )


MATCH = "ABS(COALESCE(t.v, 0) - COALESCE(s.v, 0)) <= 0"


def joined_sql(source: str, target: str, keys: list[str], match: str = MATCH) -> str:
    """Both sides at the grain and joined in full: keys, status, counts, sums and difference."""
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM t.{k}" for k in keys) or "TRUE"
    shown_keys = "".join(f"COALESCE(CAST(COALESCE(s.{k}, t.{k}) AS VARCHAR), '(blank)') AS {k}, " for k in keys)
    return f"""
    WITH s AS ({grain(source, keys)}), t AS ({grain(target, keys)})
    SELECT {shown_keys}
      CASE WHEN t.n IS NULL THEN 'onlySource' WHEN s.n IS NULL THEN 'onlyTarget'
           WHEN {match} THEN 'match' ELSE 'mismatch' END AS status,
      COALESCE(s.n, 0) AS sn, COALESCE(t.n, 0) AS tn, s.v AS sv, t.v AS tv,
      CASE WHEN s.v IS NULL AND t.v IS NULL THEN NULL ELSE COALESCE(t.v, 0) - COALESCE(s.v, 0) END AS delta
    FROM s FULL OUTER JOIN t ON {on}"""


def compare_sql(source: str, target: str, keys: list[str], value: str, digits: int = 2, match: str = MATCH, tail: str = "") -> str:
    names = "".join(f"{k}, " for k in keys)
    return f"""SELECT {names}status, CAST(sn AS BIGINT) AS source_row_count, CAST(tn AS BIGINT) AS target_row_count,
      {m('sv', digits)} AS {value}_source, {m('tv', digits)} AS {value}_target, {m('delta', digits)} AS {value}_delta
    FROM ({joined_sql(source, target, keys, match)}) {tail}"""


MONTHS = "SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, o_totalprice AS v FROM orders"
MONTHS_EDITED = f"""SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, {BUMPED_SQL} AS v
  FROM orders WHERE month(o_orderdate) <> 7"""

SUMMARY = """
  CAST(COUNT(*) FILTER (status = 'match') AS BIGINT) AS matched,
  CAST(COUNT(*) FILTER (status = 'mismatch') AS BIGINT) AS mismatched,
  CAST(COUNT(*) FILTER (status = 'onlySource') AS BIGINT) AS only_source,
  CAST(COUNT(*) FILTER (status = 'onlyTarget') AS BIGINT) AS only_target,
  CAST(COUNT(*) FILTER (sn > 0) AS BIGINT) AS source_keys,
  CAST(COUNT(*) FILTER (tn > 0) AS BIGINT) AS target_keys,
  CAST(COUNT(*) FILTER (sn > 1) AS BIGINT) AS source_duplicate_keys,
  CAST(COUNT(*) FILTER (tn > 1) AS BIGINT) AS target_duplicate_keys,
  CAST(COALESCE(SUM(sn), 0) AS BIGINT) AS source_rows, CAST(COALESCE(SUM(tn), 0) AS BIGINT) AS target_rows"""


def refused_sql(kind: str, side: str = "NULL", rows: str = "(SELECT COUNT(*) FROM orders)", source_keys: str = "NULL", target_keys: str = "NULL") -> str:
    zeros = ["matched", "mismatched", "only_source", "only_target", "source_keys", "target_keys", "source_duplicate_keys", "target_duplicate_keys"]
    return f"""SELECT {', '.join(f'CAST(0 AS BIGINT) AS {z}' for z in zeros)}, CAST({rows} AS BIGINT) AS source_rows, CAST({rows} AS BIGINT) AS target_rows,
      '{kind}' AS refusal_kind, CAST({side} AS VARCHAR) AS refusal_side,
      CAST({source_keys} AS BIGINT) AS refused_source_keys, CAST({target_keys} AS BIGINT) AS refused_target_keys"""


# The refusal columns of a comparison that was not refused.
CLEAR = """CAST(NULL AS VARCHAR) AS refusal_kind, CAST(NULL AS VARCHAR) AS refusal_side,
  CAST(NULL AS BIGINT) AS refused_source_keys, CAST(NULL AS BIGINT) AS refused_target_keys"""


def counts(result: Comparison) -> DataFrame:
    return result.summary.drop("drift_ms", "refusal_message")


@query(compare_sql(MONTHS, MONTHS_EDITED, ["year", "month"], "total"))
def compare_month_grain(t):
    return shown(month_comparison(t))


@query(
    f"SELECT {SUMMARY}, {CLEAR} FROM ({joined_sql(MONTHS, MONTHS_EDITED, ['year', 'month'])})"
)
def compare_summary(t):
    return counts(month_comparison(t))


@query(
    compare_sql(
        "SELECT o_orderkey AS okey, o_totalprice AS v FROM orders",
        f"SELECT o_orderkey AS okey, {BUMPED_SQL} AS v FROM orders WHERE month(o_orderdate) <> 7",
        ["okey"],
        "total",
    )
)
def compare_row_grain(t):
    source = t.orders.select(F.col("o_orderkey").alias("okey"), F.col("o_totalprice").alias("total"))
    target = edited(t.orders).select(F.col("o_orderkey").alias("okey"), bumped().alias("total"))
    return shown(compare(source, target, ["okey"], ["total"]))


@query(compare_sql("SELECT o_totalprice AS v FROM orders", f"SELECT {BUMPED_SQL} AS v FROM orders", [], "total"))
def compare_keyless(t):
    source, target = t.orders.select(F.col("o_totalprice").alias("total")), t.orders.select(bumped().alias("total"))
    return shown(compare(source, target, [], ["total"]))


@query(
    compare_sql(
        "SELECT lower(o_orderpriority) AS priority, o_totalprice AS v FROM orders",
        f"SELECT lower(o_orderpriority) AS priority, {BUMPED_SQL} AS v FROM orders",
        ["priority"],
        "total",
    )
)
def compare_padded_keys(t):
    source = t.orders.select(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total"))
    target = t.orders.select(F.rpad(F.upper("o_orderpriority"), 20, " ").alias("priority"), bumped().alias("total"))
    return shown(compare(source, target, ["priority"], ["total"]))


@query(
    compare_sql(
        "SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice AS v FROM orders",
        f"SELECT CAST(o_orderdate AS DATE) AS day, {BUMPED_SQL} AS v FROM orders",
        ["day"],
        "total",
    )
)
def compare_dates_as_text(t):
    """Timestamps on one side, ISO text on the other, and the amount as text too."""
    source = t.orders.select(F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("total"))
    target = t.orders.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), bumped().cast("decimal(20,2)").cast("string").alias("total")
    )
    return shown(compare(source, target, ["day"], ["total"]))


@query(
    compare_sql(
        "SELECT nullif(o_custkey % 50, 0) AS grp, o_totalprice AS v FROM orders",
        "SELECT nullif(o_custkey % 50, 0) AS grp, o_totalprice AS v FROM orders WHERE month(o_orderdate) <> 7",
        ["grp"],
        "total",
    )
)
def compare_null_keys(t):
    """A missing key is a key: both sides' NULLs meet in one row."""
    grouped = lambda df: df.select(F.nullif(F.col("o_custkey") % 50, F.lit(0)).alias("grp"), F.col("o_totalprice").alias("total"))
    return shown(compare(grouped(t.orders), grouped(edited(t.orders)), ["grp"], ["total"]))


@query(
    compare_sql(
        "SELECT l_orderkey AS okey, l_linenumber AS line, l_quantity AS v FROM lineitem",
        "SELECT l_orderkey AS okey, l_linenumber AS line, l_quantity AS v FROM lineitem WHERE l_returnflag <> 'R'",
        ["okey", "line"],
        "quantity",
    )
)
def compare_duplicate_keys(t):
    keys = lambda df: df.select(
        F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity")
    )
    return shown(compare(keys(t.lineitem), keys(t.lineitem.where("l_returnflag <> 'R'")), ["okey", "line"], ["quantity"]))


@query(
    compare_sql(
        MONTHS,
        f"SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, {BUMPED_SQL} AS v FROM orders",
        ["year", "month"],
        "total",
        match="ABS(COALESCE(t.v, 0) - COALESCE(s.v, 0)) <= 500 OR "
        "(s.v <> 0 AND CAST(ABS(COALESCE(t.v, 0) - s.v) AS DOUBLE) / CAST(ABS(s.v) AS DOUBLE) <= 0.001)",
    )
)
def compare_tolerance_rel(t):
    tolerance = Tolerance(absolute=500, relative=0.001)
    return shown(compare(monthly(t.orders), monthly(t.orders, bumped()), ["year", "month"], ["total"], tolerance))


@query(
    compare_sql(MONTHS, MONTHS_EDITED, ["year", "month"], "total", tail="""
      ORDER BY CASE WHEN status IN ('onlySource', 'onlyTarget') THEN 3 WHEN status = 'mismatch' THEN 2 ELSE 0 END DESC,
        ABS(delta) DESC, '6:d:' || year || '|' || (length(month) + 2) || ':d:' || month LIMIT 12""")
)
def compare_worst_first_top(t):
    result = month_comparison(t)
    return flat(result.worst_first(12), result)


@query(
    f"""SELECT {SUMMARY}, {CLEAR},
      CAST(COUNT(*) AS BIGINT) AS total_rows, COUNT(*) > 12 AS rows_capped
    FROM ({joined_sql(MONTHS, MONTHS_EDITED, ['year', 'month'])})"""
)
def compare_capped_counts(t):
    return month_comparison(t).capped_summary(12).drop("drift_ms", "refusal_message")


OFFSET = {3: 50000, 9: -50000}


@query(
    compare_sql(
        MONTHS,
        f"""SELECT year, month, SUM(CAST(v AS DECIMAL(38,9))) + CASE month WHEN 3 THEN 50000 WHEN 9 THEN -50000 ELSE 0 END AS v
            FROM ({MONTHS}) GROUP BY year, month""",
        ["year", "month"],
        "total",
    )
)
def compare_offsetting_months(t):
    """Errors that cancel within a year show up by month and nowhere else."""
    moved = F.sum(F.col("total").cast("decimal(38,9)")) + F.when(F.col("month") == 3, 50000).when(F.col("month") == 9, -50000).otherwise(0)
    target = monthly(t.orders).groupBy("year", "month").agg(moved.alias("total"))
    return shown(compare(monthly(t.orders), target, ["year", "month"], ["total"]))


@query(
    """
    WITH s AS (SELECT o_custkey AS cust, COUNT(*) AS n, MIN(lower(o_orderpriority)) AS lo, MAX(lower(o_orderpriority)) AS hi,
                      MIN(CAST(o_orderdate AS DATE)) AS dlo, MAX(CAST(o_orderdate AS DATE)) AS dhi FROM orders GROUP BY 1),
         t AS (SELECT o_custkey AS cust, COUNT(*) AS n, MIN(lower(o_orderpriority)) AS lo, MAX(lower(o_orderpriority)) AS hi,
                      MIN(CAST(o_orderdate AS DATE)) AS dlo, MAX(CAST(o_orderdate AS DATE)) AS dhi FROM orders
               WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT CAST(COALESCE(s.cust, t.cust) AS VARCHAR) AS cust,
      CASE WHEN t.n IS NULL THEN 'onlySource' WHEN s.n IS NULL THEN 'onlyTarget'
           WHEN s.lo = s.hi AND t.lo = t.hi AND s.lo = t.lo AND s.dlo = s.dhi AND t.dlo = t.dhi AND s.dlo = t.dlo THEN 'match'
           ELSE 'mismatch' END AS status,
      CASE WHEN s.lo <> s.hi THEN '(multiple values)' ELSE s.lo END AS priority_source,
      CASE WHEN t.lo <> t.hi THEN '(multiple values)' ELSE t.lo END AS priority_target,
      CASE WHEN s.lo = s.hi AND t.lo = t.hi AND s.lo = t.lo THEN 'match' ELSE 'mismatch' END AS priority_status,
      CASE WHEN s.dlo <> s.dhi THEN '(multiple values)' ELSE CAST(s.dlo AS VARCHAR) END AS day_source,
      CASE WHEN t.dlo <> t.dhi THEN '(multiple values)' ELSE CAST(t.dlo AS VARCHAR) END AS day_target,
      CASE WHEN s.dlo = s.dhi AND t.dlo = t.dhi AND s.dlo = t.dlo THEN 'match' ELSE 'mismatch' END AS day_status
    FROM s FULL OUTER JOIN t ON s.cust = t.cust"""
)
def compare_text_cells(t):
    sides = lambda df: df.select(
        F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("day")
    )
    result = compare(sides(t.orders), sides(t.orders.where("o_orderstatus = 'F'")), ["cust"], ["priority", "day"])
    parts = ("source", "target", "status")
    return result.rows.select("cust", "status", *[f"{v}_{p}" for v in ("priority", "day") for p in parts])


CHANGED_ROWS = "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 500 = 0 THEN 'mismatch' ELSE 'match' END AS status FROM orders"


def scaled(df: DataFrame, factor: float, change) -> DataFrame:
    amount = F.col("o_totalprice") * F.lit(factor)
    return df.select("o_orderkey", F.when(F.col("o_orderkey") % 500 == 0, change(amount)).otherwise(amount).alias("amount"))


@query(CHANGED_ROWS)
def compare_huge_values(t):
    """Amounts beyond any sum's digits: a doubled one is still found."""
    result = compare(scaled(t.orders, 1e25, lambda a: a), scaled(t.orders, 1e25, lambda a: a * 2), ["o_orderkey"], ["amount"])
    return result.rows.select("o_orderkey", "status")


@query(CHANGED_ROWS)
def compare_tiny_values(t):
    """Amounts below nine decimals: one raised by a part of them is still found."""
    result = compare(scaled(t.orders, 1e-12, lambda a: a), scaled(t.orders, 1e-12, lambda a: a + 3.6e-10), ["o_orderkey"], ["amount"])
    return result.rows.select("o_orderkey", "status")


@query(
    refused_sql("noKeyOverlap", source_keys="(SELECT COUNT(DISTINCT o_orderkey) FROM orders)", target_keys="(SELECT COUNT(DISTINCT o_orderkey) FROM orders)")
)
def compare_refusal_no_overlap(t):
    target = t.orders.withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return counts(compare(t.orders, target, ["o_orderkey"], ["o_totalprice"]))


@query(refused_sql("truncated", "CASE WHEN (SELECT COUNT(*) FROM orders) > 100 THEN 'target' END"))
def compare_refusal_truncated(t):
    """A read that passes its row cap is refused; the rows of both reads are counted, none are compared."""
    return counts(compare(Side(t.orders), capped(t.orders, 100), ["o_orderkey"], ["o_totalprice"]))


@query(refused_sql("grainTooFine", "'both'"))
def compare_refusal_grain(t):
    return counts(compare(t.orders, t.orders, ["o_orderkey"], ["o_totalprice"], max_keys=100))


@query(refused_sql("emptyBothSides", rows="0"))
def compare_refusal_empty(t):
    none = t.orders.where("o_totalprice < 0")
    return counts(compare(none, none, ["o_orderkey"], ["o_totalprice"]))


@query("SELECT CAST(-1 - o_orderkey AS VARCHAR) AS sample FROM orders ORDER BY length(CAST(-1 - o_orderkey AS VARCHAR)) , 1 LIMIT 3")
def refusal_key_samples(t):
    target = t.orders.withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return compare(t.orders, target, ["o_orderkey"], []).sample_keys("target")


@query(
    """SELECT CAST(COUNT(DISTINCT o_custkey) AS BIGINT) AS left_keys,
      (SELECT COUNT(*) FROM customer WHERE c_acctbal > 0) AS right_keys,
      (SELECT COUNT(*) FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders)) AS shared_keys FROM orders"""
)
def key_overlap_count(t):
    from tieout.operators.checks import key_overlap

    return key_overlap(t.orders, "o_custkey", t.customer.where("c_acctbal > 0"), "c_custkey")


DRILL = f"""
  WITH s AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS mo, o_orderstatus AS st, {total('o_totalprice')} AS v FROM orders GROUP BY ALL),
       t AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS mo, o_orderstatus AS st, {total(BUMPED_SQL)} AS v FROM orders
             WHERE month(o_orderdate) <> 7 GROUP BY ALL),
       j AS (SELECT CAST(COALESCE(s.y, t.y) AS VARCHAR) AS year, CAST(COALESCE(s.mo, t.mo) AS VARCHAR) AS month,
               lower(COALESCE(s.st, t.st)) AS status_key, s.v AS sv, t.v AS tv, COALESCE(t.v, 0) - COALESCE(s.v, 0) AS d,
               CASE WHEN t.v IS NULL THEN 4 WHEN s.v IS NULL THEN 3 WHEN s.v <> t.v THEN 2 ELSE 1 END AS w
             FROM s FULL OUTER JOIN t ON s.y = t.y AND s.mo = t.mo AND s.st = t.st)
  SELECT year, month, status_key, 3 - CAST(log2(GROUPING(year, month, status_key) + 1) AS INTEGER) AS depth,
    CAST(COUNT(*) AS BIGINT) AS leaves,
    CASE MAX(w) WHEN 4 THEN 'onlySource' WHEN 3 THEN 'onlyTarget' WHEN 2 THEN 'mismatch' ELSE 'match' END AS status,
    {m('SUM(sv)')} AS total_source, {m('SUM(tv)')} AS total_target, {m('SUM(d)')} AS total_delta
  FROM j GROUP BY ROLLUP (year, month, status_key) HAVING GROUPING(year, month, status_key) < 7"""


@query(DRILL)
def drill_matrix_by_status(t):
    sides = lambda df, value: df.select(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("o_orderstatus").alias("status_key"), value.alias("total")
    )
    result = compare(sides(t.orders, F.col("o_totalprice")), sides(edited(t.orders), bumped()), ["year", "month", "status_key"], ["total"])
    tree = drill_matrix(result)
    return tree.select(
        "year", "month", "status_key", "depth", "leaves", "status",
        *[money(f"total_{p}").alias(f"total_{n}") for p, n in (("source_num", "source"), ("target_num", "target"), ("delta", "delta"))],
    )


@query(
    """SELECT o_orderkey, 'd:' || o_custkey AS customer_key, 't:' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_key,
      's:' || lower(o_orderpriority) AS priority_key,
      'd:' || regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '\\.$', '') AS price_key,
      length('d:' || o_custkey) || ':d:' || o_custkey || '|' || length('s:' || lower(o_orderpriority)) || ':s:' || lower(o_orderpriority)
        AS composite FROM orders"""
)
def normalised_keys(t):
    o = t.orders
    key = lambda c: normalize_key(F.col(c), o.schema[c].dataType)
    padded = normalize_key(F.rpad(F.upper("o_orderpriority"), 20, " "), o.schema["o_orderpriority"].dataType)
    return o.select(
        "o_orderkey",
        key("o_custkey").alias("customer_key"),
        key("o_orderdate").alias("date_key"),
        padded.alias("priority_key"),
        key("o_totalprice").alias("price_key"),
        composite_key([key("o_custkey"), padded]).alias("composite"),
    )


