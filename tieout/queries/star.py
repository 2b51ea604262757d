"""Measures over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieout.functions.numbers import exact_sum, safe_divide, truncate_number
from tieout.model import Measure, Model, Rel
from tieout.operators import fuzzy as Z
from tieout.operators import measures as M
from tieout.operators.datedim import date_dimension
from tieout.queries.registry import m, money, query, ratio, text, total


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


REVENUE = "l_extendedprice * (1 - l_discount)"


RELATIONSHIPS = (
    Rel("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Rel("lineitem", "l_partkey", "part", "p_partkey"),
    Rel("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Rel("orders", "o_custkey", "customer", "c_custkey"),
    Rel("customer", "c_nationkey", "nation", "n_nationkey"),
    Rel("nation", "n_regionkey", "region", "r_regionkey"),
)


def model(t, *tables: str) -> Model:
    return Model({name: getattr(t, name) for name in tables}, RELATIONSHIPS)


ONE_OF_EACH = f"""SELECT l_returnflag, {m(total('l_quantity'))} AS total_qty, round(CAST({total('l_discount')} AS DOUBLE) / COUNT(l_discount), 6) AS avg_discount,
  CAST(COUNT(*) AS BIGINT) AS lines, CAST(COUNT(DISTINCT l_shipdate) AS BIGINT) AS ship_days, MIN(l_extendedprice) AS lowest, MAX(l_extendedprice) AS highest
  FROM lineitem GROUP BY 1"""


@query(ONE_OF_EACH)
def basic_aggregates(t):
    out = M.evaluate(
        t.lineitem,
        [
            Measure("total_qty", "sum", F.col("l_quantity")),
            Measure("avg_discount", "avg", F.col("l_discount")),
            Measure("lines", "count_rows"),
            Measure("ship_days", "distinct", F.col("l_shipdate")),
            Measure("lowest", "min", F.col("l_extendedprice")),
            Measure("highest", "max", F.col("l_extendedprice")),
        ],
        by=["l_returnflag"],
    )
    return out.withColumn("total_qty", money("total_qty")).withColumn("avg_discount", ratio("avg_discount"))


@query(f"SELECT {m(total(REVENUE), 4)} AS revenue FROM lineitem")
def scalar_total(t):
    return M.evaluate(t.lineitem, [Measure("revenue", "sum", revenue())]).select(money("revenue", 4).alias("revenue"))


@query(f"SELECT COALESCE(p_brand, '—') AS label, {m(total(REVENUE), 4)} AS value FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
def star_group(t):
    points = M.group_by_dimension(t.lineitem, "l_partkey", t.part, "p_partkey", F.col("p_brand"), Measure("v", "sum", revenue()))
    return points.withColumn("value", money("value", 4))


@query(
    f"""SELECT COALESCE(p_brand, '—') AS label, {m(total('l_quantity'))} AS value FROM lineitem
    LEFT JOIN (SELECT * FROM part WHERE p_partkey > 100) ON l_partkey = p_partkey GROUP BY 1"""
)
def star_group_missing(t):
    """Lines whose part is gone keep a label of their own."""
    points = M.group_by_dimension(
        t.lineitem, "l_partkey", t.part.where("p_partkey > 100"), "p_partkey", F.col("p_brand"), Measure("v", "sum", F.col("l_quantity"))
    )
    return points.withColumn("value", money("value"))


@query(
    f"""SELECT COALESCE(p_type, '(blank)') AS p_type, {m(total('l_quantity'))} AS value FROM lineitem
    LEFT JOIN (SELECT * FROM part WHERE p_partkey > 100) ON l_partkey = p_partkey GROUP BY 1"""
)
def blank_group(t):
    wide = M.lookup(t.lineitem, "l_partkey", t.part.where("p_partkey > 100"), "p_partkey", ["p_type"], M.BLANK)
    return M.evaluate(wide, [Measure("value", "sum", F.col("l_quantity"))], by=["p_type"]).withColumn("value", money("value"))


@query(
    f"""SELECT strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS label, {m(total(REVENUE), 4)} AS value
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""
)
def star_group_bucket(t):
    points = M.group_by_dimension(
        t.lineitem, "l_orderkey", t.orders, "o_orderkey", F.col("o_orderdate"), Measure("v", "sum", revenue()), bucket="quarter"
    )
    return points.withColumn("value", money("value", 4))


@query(
    """SELECT strftime(o_orderdate, '%Y-%m') AS label, CAST(COUNT(DISTINCT l_suppkey) AS BIGINT) AS value
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""
)
def star_group_distinct(t):
    return M.group_by_dimension(
        t.lineitem, "l_orderkey", t.orders, "o_orderkey", F.col("o_orderdate"), Measure("v", "distinct", F.col("l_suppkey")), bucket="month"
    )


@query(
    f"""SELECT o_orderpriority AS label, round(CAST({total('l_discount')} AS DOUBLE) / COUNT(l_discount), 6) AS value
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""
)
def star_group_average(t):
    points = M.group_by_dimension(
        t.lineitem, "l_orderkey", t.orders, "o_orderkey", F.col("o_orderpriority"), Measure("v", "avg", F.col("l_discount"))
    )
    return points.withColumn("value", ratio("value"))


@query("SELECT strftime(l_shipdate, '%Y') AS label, CAST(COUNT(*) AS BIGINT) AS value FROM lineitem GROUP BY 1")
def fact_group_year(t):
    return M.group_measure(t.lineitem, Measure("v", "count_rows"), F.col("l_shipdate"), bucket="year")


@query(f"SELECT 'Total' AS label, {m(total('l_quantity'))} AS value FROM lineitem")
def fact_total(t):
    return M.group_measure(t.lineitem, Measure("v", "sum", F.col("l_quantity"))).withColumn("value", money("value"))


@query(
    f"""SELECT c_name AS label, {m(total('o_totalprice'))} AS value FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1
    ORDER BY {total('o_totalprice')} DESC, 1 LIMIT 10"""
)
def star_topn(t):
    points = M.group_by_dimension(
        t.orders, "o_custkey", t.customer, "c_custkey", F.col("c_name"), Measure("v", "sum", F.col("o_totalprice")), top_n=10
    )
    return points.withColumn("value", money("value"))


@query(
    f"""SELECT {m(f"SUM(CASE WHEN lower(l_returnflag) = 'r' AND l_quantity > 10 THEN CAST({REVENUE} AS DECIMAL(38,9)) END)", 4)} AS returned,
      {m(f"SUM(CASE WHEN lower(l_returnflag) = 'r' AND l_quantity > 10 AND l_linestatus <> 'F' THEN CAST({REVENUE} AS DECIMAL(38,9)) END)", 4)} AS returned_open,
      {m(total(REVENUE), 4)} AS revenue,
      round(CAST(SUM(CASE WHEN lower(l_returnflag) = 'r' AND l_quantity > 10 THEN CAST({REVENUE} AS DECIMAL(38,9)) END) AS DOUBLE)
        / CAST({total(REVENUE)} AS DOUBLE), 6) AS share FROM lineitem"""
)
def filtered_scalar(t):
    """Filters that pile up on a measure, beside the unfiltered one, and a ratio of two measures."""
    whole = Measure("revenue", "sum", revenue())
    returned = whole.refine(M.predicate(F.col("l_returnflag"), "=", "r"), "returned").refine(M.predicate(F.col("l_quantity"), ">", 10))
    opened = returned.refine(M.predicate(F.col("l_linestatus"), "<>", "f"), "returned_open")
    out = M.evaluate(
        t.lineitem, [whole, returned, opened], derived={"share": lambda c: safe_divide(c["returned"], c["revenue"])}
    )
    return out.select(*[money(c, 4).alias(c) for c in ("revenue", "returned", "returned_open")], ratio("share").alias("share"))


@query(
    """SELECT CAST(COUNT(*) AS BIGINT) AS rows_found FROM lineitem
    WHERE (l_returnflag IN ('A', 'N') OR l_quantity >= 40) AND NOT (l_linestatus = 'O' AND l_discount < 0.05)"""
)
def filter_conditions(t):
    either = F.col("l_returnflag").isin("A", "N") | M.predicate(F.col("l_quantity"), ">=", 40)
    unwanted = M.predicate(F.col("l_linestatus"), "=", "o") & M.predicate(F.col("l_discount"), "<", 0.05)
    kept = M.filter_rows(t.lineitem, either, ~unwanted)
    return M.evaluate(kept, [Measure("rows_found", "count_rows")])


@query(
    f"""SELECT r_name, c_mktsegment, {m(total('o_totalprice'))} AS sales, CAST(COUNT(*) AS BIGINT) AS orders,
      round(CAST({total('o_totalprice')} AS DOUBLE) / COUNT(*), 4) AS order_value, CAST(COUNT(DISTINCT o_custkey) AS BIGINT) AS customers
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""
)
def multi_measure_matrix(t):
    sales = model(t, "orders", "customer", "nation", "region")
    wide = M.star(
        sales,
        "orders",
        ["customer", sales.active("customer", "nation"), sales.active("nation", "region")],
        columns={"customer": ["c_mktsegment", "c_nationkey"], "nation": ["n_regionkey"], "region": ["r_name"]},
    )
    out = M.evaluate(
        wide,
        [
            Measure("sales", "sum", F.col("o_totalprice")),
            Measure("orders", "count_rows"),
            Measure("customers", "distinct", F.col("o_custkey")),
        ],
        by=["r_name", "c_mktsegment"],
        derived={"order_value": lambda c: safe_divide(c["sales"], c["orders"])},
    )
    return out.withColumn("sales", money("sales")).withColumn("order_value", ratio("order_value", 4))


@query(
    f"""SELECT l_linestatus, {m(total('l_quantity * l_extendedprice'), 2)} AS sumx, round(AVG(l_quantity * l_extendedprice), 3) AS averagex,
      MIN(l_quantity * l_extendedprice) AS minx, MAX(l_quantity * l_extendedprice) AS maxx, CAST(COUNT(l_quantity * l_extendedprice) AS BIGINT) AS countx
    FROM lineitem GROUP BY 1"""
)
def iterator_sumx(t):
    product = F.col("l_quantity") * F.col("l_extendedprice")
    out = M.evaluate(
        t.lineitem,
        [Measure("sumx", "sum", product), Measure("averagex", "avg", product), Measure("minx", "min", product),
         Measure("maxx", "max", product), Measure("countx", "count", product)],
        by=["l_linestatus"],
    )
    return out.withColumn("sumx", money("sumx")).withColumn("averagex", ratio("averagex", 3))


@query(f"SELECT p_type, {m(total('l_quantity * p_retailprice'))} AS list_value FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
def related_product(t):
    """A row product with a factor looked up from a dimension."""
    wide = M.lookup(t.lineitem, "l_partkey", t.part, "p_partkey", ["p_retailprice", "p_type"])
    out = M.evaluate(wide, [Measure("list_value", "sum", F.col("l_quantity") * F.col("p_retailprice"))], by=["p_type"])
    return out.withColumn("list_value", money("list_value"))


@query(
    """SELECT o_custkey, CASE WHEN COUNT(DISTINCT o_orderstatus) = 1 THEN MIN(o_orderstatus) ELSE 'several' END AS selected
    FROM orders GROUP BY 1"""
)
def selected_value(t):
    return M.selected_value(t.orders, "o_orderstatus", by=["o_custkey"], alternate="several")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(t):
    return M.distinct_rows(t.lineitem, ["l_returnflag", "l_linestatus"])


@query("SELECT DISTINCT p_brand AS value FROM part")
def slicer_values(t):
    return M.slicer_values(t.part, "p_brand")


@query(
    f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS y FROM orders UNION SELECT CAST(l_shipdate AS DATE), year(l_shipdate) FROM lineitem)
    SELECT CAST(y AS INTEGER) AS year, {m(total('CASE WHEN k = 1 THEN x END'))} AS by_order_date, {m(total('CASE WHEN k = 2 THEN x END'))} AS by_ship_date
    FROM (SELECT year(o_orderdate) AS y, 1 AS k, l_extendedprice AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          UNION ALL SELECT year(l_shipdate), 2, l_extendedprice FROM lineitem) GROUP BY 1"""
)
def role_playing_date(t):
    """The same measure over the active date and over the other one, against one calendar."""
    sales = Measure("v", "sum", F.col("l_extendedprice"))
    days = lambda label, points: points.select(F.col("label").cast("int").alias("year"), F.col("value").alias(label))
    active = M.group_by_dimension(t.lineitem, "l_orderkey", t.orders, "o_orderkey", F.col("o_orderdate"), sales, bucket="year")
    other = M.group_measure(t.lineitem, sales, F.col("l_shipdate"), bucket="year")
    out = days("by_order_date", active).join(days("by_ship_date", other), "year", "full_outer")
    return out.select("year", money("by_order_date").alias("by_order_date"), money("by_ship_date").alias("by_ship_date"))


@query(
    f"""SELECT n_name, {m(total('s_acctbal'))} AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"""
)
def inner_join_group(t):
    wide = M.inner_star(t.supplier, "s_nationkey", t.nation, "n_nationkey")
    return M.evaluate(wide, [Measure("balance", "sum", F.col("s_acctbal"))], by=["n_name"]).withColumn("balance", money("balance"))


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS band,
      CASE lower(c_mktsegment) WHEN 'building' THEN 1 WHEN 'machinery' THEN 2 ELSE 0 END AS segment_no,
      CAST(trunc(c_acctbal) AS BIGINT) AS whole, round(sqrt(abs(c_acctbal)), 4) AS root, COALESCE(nullif(c_nationkey, 0), 99) AS nation,
      c_mktsegment || '/' || COALESCE(nullif(c_name, 'Customer#000000001'), '') AS joined, CASE WHEN c_nationkey = 0 THEN NULL ELSE round(c_acctbal / c_nationkey, 7) END AS per_nation,
      CAST(year(DATE '2024-02-29' + CAST(c_custkey AS INTEGER)) AS INTEGER) AS y, c_nationkey <> 0 AS has_nation FROM customer"""
)
def scalar_functions(t):
    c = t.customer
    day = F.date_add(F.lit("2024-02-29").cast("date"), F.col("c_custkey").cast("int"))
    return c.select(
        "c_custkey",
        M.switch(None, [(F.col("c_acctbal") < 0, "debt"), (F.col("c_acctbal") < 5000, "some")], "rich").alias("band"),
        M.switch(F.lower("c_mktsegment"), [("building", 1), ("machinery", 2)], 0).alias("segment_no"),
        truncate_number(F.col("c_acctbal")).alias("whole"),
        F.round(F.sqrt(F.abs("c_acctbal")), 4).alias("root"),
        F.coalesce(F.nullif("c_nationkey", F.lit(0)), F.lit(99)).alias("nation"),
        M.text_join(F.col("c_mktsegment"), F.lit("/"), F.nullif("c_name", F.lit("Customer#000000001"))).alias("joined"),
        ratio(safe_divide(F.col("c_acctbal"), F.col("c_nationkey")), 7).alias("per_nation"),
        F.year(day).alias("y"),
        M.truthy(F.col("c_nationkey"), c.schema["c_nationkey"].dataType).alias("has_nation"),
    )


WEEK = "CAST(floor((dayofyear(d) - 1 + (isodow(make_date(year(d), 1, 1)) - 1)) / 7) AS INTEGER) + 1"
CALENDAR = f"""
  SELECT CAST(d AS VARCHAR) AS "Date", CAST(year(d) AS INTEGER) AS "Year", 'Q' || quarter(d) AS "Quarter", CAST(month(d) AS INTEGER) AS "MonthNo", monthname(d) AS "MonthName",
    substr(monthname(d), 1, 3) AS "MonthShort", strftime(d, '%Y-%m') AS "YearMonth", {WEEK} AS "WeekOfYear", CAST(day(d) AS INTEGER) AS "Day", CAST(isodow(d) AS INTEGER) AS "WeekdayNo",
    dayname(d) AS "WeekdayName", isodow(d) > 5 AS "IsWeekend", CAST(year(d) + CASE WHEN month(d) >= 7 THEN 1 ELSE 0 END AS INTEGER) AS "FiscalYear"
  FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
        FROM (SELECT CAST(MIN(o_orderdate) AS DATE) AS lo, CAST(MAX(o_orderdate) AS DATE) AS hi FROM orders))"""


@query(CALENDAR)
def date_dimension_fiscal(t):
    return date_dimension(t.orders, "o_orderdate", fiscal_start=7).withColumn("Date", text("Date"))


@query(
    f"""SELECT "Year" AS year, "WeekOfYear" AS week, {m(total('v'))} AS value FROM ({CALENDAR}) JOIN
      (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS k, o_totalprice AS v FROM orders) ON "Date" = k GROUP BY 1, 2"""
)
def sales_by_calendar_week(t):
    days = date_dimension(t.orders, "o_orderdate", ["Year", "WeekOfYear"])
    keyed = t.orders.withColumn("day", F.col("o_orderdate").cast("date"))
    wide = M.lookup(keyed, "day", days, "Date", ["Year", "WeekOfYear"])
    out = wide.groupBy(F.col("Year").alias("year"), F.col("WeekOfYear").alias("week")).agg(exact_sum(F.col("o_totalprice")).alias("value"))
    return out.withColumn("value", money("value"))


NORMAL = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
FUZZY = """
  WITH v AS (SELECT DISTINCT {column} AS value FROM part),
  r AS (SELECT p_partkey, {typed} AS typed FROM part),
  s AS (SELECT p_partkey, typed, value, {nt} AS w, {nv} AS k FROM r, v),
  x AS (SELECT *, CASE WHEN w = '' OR k = '' THEN 0.0 WHEN w = k THEN 1.0 WHEN length(w) > 2 AND (contains(k, w) OR contains(w, k)) THEN 0.82
      WHEN 1 - levenshtein(w, k) / CAST(GREATEST(length(w), length(k)) AS DOUBLE) >= 0.7
        THEN (1 - levenshtein(w, k) / CAST(GREATEST(length(w), length(k)) AS DOUBLE)) * 0.78 ELSE 0.0 END AS score FROM s),
  b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, value) AS nth FROM x)
  SELECT p_partkey, typed, CASE WHEN score >= 0.62 THEN value END AS matched_value, CASE WHEN score >= 0.62 THEN round(score, 6) END AS match_score
  FROM b WHERE nth = 1"""


@query(
    FUZZY.format(
        column="p_type", typed="substr(p_type, 1, 2) || substr(p_type, 4) || CASE WHEN p_size > 40 THEN 'qq' ELSE '' END",
        nt=NORMAL.format("typed"), nv=NORMAL.format("value"),
    )
)
def fuzzy_values(t):
    """Types typed with a letter dropped, some with letters too many."""
    typed = F.concat(
        F.substring("p_type", 1, 2), F.expr("substring(p_type, 4)"), F.when(F.col("p_size") > 40, "qq").otherwise("")
    )
    out = Z.fuzzy_join(t.part.select("p_partkey", typed.alias("typed")), "typed", t.part, "p_type")
    return out.withColumn("match_score", ratio("match_score"))


@query(
    FUZZY.format(
        column="p_name", typed="substr(p_name, 1, 3) || substr(p_name, 5) || CASE WHEN p_size > 40 THEN 'qq' ELSE '' END",
        nt=NORMAL.format("typed"), nv=NORMAL.format("value"),
    )
)
def fuzzy_names(t):
    """Part names, of which there are many, typed with a letter dropped or letters too many."""
    typed = F.concat(F.substring("p_name", 1, 3), F.expr("substring(p_name, 5)"), F.when(F.col("p_size") > 40, "qq").otherwise(""))
    out = Z.fuzzy_join(t.part.select("p_partkey", typed.alias("typed")), "typed", t.part, "p_name")
    return out.withColumn("match_score", ratio("match_score"))
