"""Time intelligence over orders, and patterns over orders, lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieout.functions.numbers import exact_sum, safe_divide
from tieout.model import Measure
from tieout.operators import patterns as P
from tieout.operators import ranking as R
from tieout.operators import timeintel as TI
from tieout.queries.registry import m, money, query, ratio, text, total
from tieout.queries.star import REVENUE, revenue

DAILY = f"SELECT o_orderstatus AS grp, CAST(o_orderdate AS DATE) AS d, {total('o_totalprice')} AS v FROM orders GROUP BY ALL"


def periods(t, axis: str, by=("grp",)):
    orders = t.orders.withColumnRenamed("o_orderstatus", "grp")
    return TI.totals(orders, "o_orderdate", F.col("o_totalprice"), axis, by)


def monthly_sql(axis: str = "month", by: bool = True) -> str:
    grp = "o_orderstatus AS grp, " if by else ""
    return f"SELECT {grp}CAST(date_trunc('{axis}', o_orderdate) AS DATE) AS d, {total('o_totalprice')} AS v FROM orders GROUP BY ALL"


def out(df, *amounts, ratios=()):
    """Periods as text, exact amounts and rounded ratios."""
    cols = [text(c).alias(c) if c == "period" else F.col(c) for c in df.columns if c not in amounts and c not in ratios]
    return df.select(*cols, *[money(a).alias(a) for a in amounts], *[ratio(r).alias(r) for r in ratios])


def to_date_sql(unit: str, name: str) -> str:
    return f"""SELECT grp, CAST(d AS VARCHAR) AS period, {m('v')} AS value,
      {m(f"SUM(v) OVER (PARTITION BY grp, date_trunc('{unit}', d) ORDER BY d)")} AS {name} FROM ({DAILY})"""


@query(to_date_sql("year", "ytd"))
def ytd(t):
    return out(TI.to_date(periods(t, "day"), "year", ["grp"], name="ytd"), "value", "ytd")


@query(to_date_sql("quarter", "qtd"))
def qtd(t):
    return out(TI.to_date(periods(t, "day"), "quarter", ["grp"], name="qtd"), "value", "qtd")


@query(to_date_sql("month", "mtd"))
def mtd(t):
    return out(TI.to_date(periods(t, "day"), "month", ["grp"], name="mtd"), "value", "mtd")


def prior_sql(axis: str, shift: str, name: str) -> str:
    data = DAILY if axis == "day" else monthly_sql(axis)
    return f"""WITH p AS ({data}) SELECT a.grp, CAST(a.d AS VARCHAR) AS period, {m('a.v')} AS value, {m('b.v')} AS {name}
      FROM p a LEFT JOIN p b ON a.grp = b.grp AND b.d = CAST(a.d - INTERVAL {shift} AS DATE)"""


@query(prior_sql("month", "'1 year'", "prior_year"))
def prior_year(t):
    return out(TI.prior(periods(t, "month"), "month", "year", ["grp"], name="prior_year"), "value", "prior_year")


@query(prior_sql("day", "'1 month'", "prior_month"))
def prior_month_by_day(t):
    return out(TI.prior(periods(t, "day"), "day", "month", ["grp"], name="prior_month"), "value", "prior_month")


@query(prior_sql("quarter", "'3 months'", "prior_quarter"))
def prior_quarter(t):
    return out(TI.prior(periods(t, "quarter"), "quarter", "quarter", ["grp"], name="prior_quarter"), "value", "prior_quarter")


def growth_sql(axis: str, shift: str, unit: str) -> str:
    return f"""WITH p AS ({monthly_sql(axis)}) SELECT a.grp, CAST(a.d AS VARCHAR) AS period, {m('a.v')} AS value, {m('b.v')} AS prior_{unit},
      round((CAST(a.v AS DOUBLE) - CAST(b.v AS DOUBLE)) / nullif(CAST(b.v AS DOUBLE), 0), 6) AS growth
      FROM p a LEFT JOIN p b ON a.grp = b.grp AND b.d = CAST(a.d - INTERVAL {shift} AS DATE)"""


def grown(t, axis: str, unit: str):
    return out(TI.period_growth(periods(t, axis), axis, unit, ["grp"]), "value", f"prior_{unit}", ratios=["growth"])


@query(growth_sql("month", "'1 year'", "year"))
def yoy(t):
    return grown(t, "month", "year")


@query(growth_sql("quarter", "'3 months'", "quarter"))
def qoq(t):
    return grown(t, "quarter", "quarter")


@query(growth_sql("month", "'1 month'", "month"))
def mom(t):
    return grown(t, "month", "month")


@query(
    f"""WITH p AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, CAST({total('o_totalprice')} AS DOUBLE) AS v, COUNT(*) AS n FROM orders GROUP BY 1)
    SELECT CAST(a.d AS VARCHAR) AS period, round(a.v / a.n, 7) AS order_value, round(a.v / a.n - b.v / b.n, 6) AS points
    FROM p a LEFT JOIN p b ON b.d = CAST(a.d - INTERVAL '1 year' AS DATE)"""
)
def ratio_points(t):
    """A ratio is rebuilt from its parts in each period, and its change is in points."""
    parts = TI.measures_by_period(
        t.orders, "o_orderdate", [Measure("v", "sum", F.col("o_totalprice")), Measure("n", "count_rows")], "month",
        derived={"order_value": lambda c: safe_divide(c["v"], c["n"])},
    )
    changed = TI.period_growth(parts, "month", "year", value="order_value", name="points", ratio=True)
    return changed.select(text("period").alias("period"), ratio("order_value", 7).alias("order_value"), ratio("points", 6).alias("points"))


@query(
    f"""WITH p AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, {total('o_totalprice')} AS v, COUNT(*) AS n FROM orders GROUP BY 1)
    SELECT CAST(d AS VARCHAR) AS period, round(CAST(SUM(v) OVER w AS DOUBLE) / SUM(n) OVER w, 6) AS order_value_ytd FROM p
    WINDOW w AS (PARTITION BY year(d) ORDER BY d)"""
)
def ratio_ytd(t):
    """The year-to-date of a ratio."""
    parts = TI.measures_by_period(
        t.orders, "o_orderdate", [Measure("v", "sum", F.col("o_totalprice")), Measure("n", "count_rows")], "month"
    )
    shifted = TI.over_parts(
        parts, ["v", "n"], lambda df, part: TI.to_date(df, "year", value=part, name=f"{part}_shifted"),
        lambda c: safe_divide(c["v"], c["n"]), "order_value_ytd",
    )
    return shifted.select(text("period").alias("period"), ratio("order_value_ytd").alias("order_value_ytd"))


def window_sum(low: str, high: str) -> str:
    return f"(SELECT SUM(b.v) FROM p b WHERE b.grp = a.grp AND b.d > {low} AND b.d <= {high})"


def rolling_sql(step: str) -> str:
    back = f"CAST(a.d - INTERVAL {step} AS DATE)"
    twice = f"CAST({back} - INTERVAL {step} AS DATE)"
    return f"""WITH p AS ({DAILY}), w AS (SELECT a.grp, a.d, a.v, {window_sum(back, 'a.d')} AS r, {window_sum(twice, back)} AS q FROM p a)
      SELECT grp, CAST(d AS VARCHAR) AS period, {m('v')} AS value, {m('r')} AS rolling, {m('q')} AS rolling_prior,
        round((CAST(r AS DOUBLE) - CAST(q AS DOUBLE)) / nullif(CAST(q AS DOUBLE), 0), 6) AS rolling_growth FROM w"""


def rolled(t, span: TI.Span):
    return out(TI.rolling(periods(t, "day"), span, ["grp"]), "value", "rolling", "rolling_prior", ratios=["rolling_growth"])


@query(rolling_sql("'28 days'"))
def rolling_days(t):
    return rolled(t, TI.Span(28, "day"))


@query(rolling_sql("'14 days'"))
def rolling_weeks(t):
    return rolled(t, TI.Span(2, "week"))


@query(rolling_sql("'3 months'"))
def rolling_months(t):
    return rolled(t, TI.Span(3, "month"))


@query(rolling_sql("'1 year'"))
def rolling_year(t):
    return rolled(t, TI.Span(1, "year"))


@query(
    f"""WITH p AS ({DAILY}) SELECT a.grp, CAST(a.d AS VARCHAR) AS period, {m('a.v')} AS value,
      (SELECT round(CAST(SUM(b.v) AS DOUBLE) / COUNT(*), 6) FROM p b WHERE b.grp = a.grp AND b.d > CAST(a.d - INTERVAL '3 months' AS DATE) AND b.d <= a.d) AS moving_avg
    FROM p a"""
)
def moving_avg(t):
    return out(TI.moving_average(periods(t, "day"), TI.Span(3, "month"), ["grp"]), "value", ratios=["moving_avg"])


@query(f"SELECT grp, CAST(d AS VARCHAR) AS period, {m('v')} AS value, {m('SUM(v) OVER (PARTITION BY grp ORDER BY d)')} AS running FROM ({DAILY})")
def running_total(t):
    return out(TI.running_total(periods(t, "day"), ["grp"]), "value", "running")


FAMILY = f"""
  WITH dy AS ({DAILY}), mo AS ({monthly_sql()}),
  last AS (SELECT grp, CAST(date_trunc('month', d) AS DATE) AS mth, MAX(d) AS d FROM dy GROUP BY ALL),
  f AS (SELECT a.grp, a.d, a.v,
      SUM(a.v) OVER (PARTITION BY a.grp, date_trunc('year', a.d) ORDER BY a.d) AS ytd,
      SUM(a.v) OVER (PARTITION BY a.grp, date_trunc('quarter', a.d) ORDER BY a.d) AS qtd,
      SUM(a.v) OVER (PARTITION BY a.grp ORDER BY a.d) AS running, y.v AS py, p.v AS pm,
      (SELECT CAST(SUM(b.v) AS DOUBLE) / COUNT(*) FROM dy b, last l WHERE l.grp = a.grp AND l.mth = a.d AND b.grp = a.grp
         AND b.d <= l.d AND b.d > CAST(l.d - INTERVAL '3 months' AS DATE)) AS ma
    FROM mo a LEFT JOIN mo y ON y.grp = a.grp AND y.d = CAST(a.d - INTERVAL '1 year' AS DATE)
      LEFT JOIN mo p ON p.grp = a.grp AND p.d = CAST(a.d - INTERVAL '1 month' AS DATE))"""
FAMILY_COLUMNS = f"""grp, CAST(d AS VARCHAR) AS period, {m('ytd')} AS ytd, {m('qtd')} AS qtd, {m('v')} AS mtd, {m('running')} AS running, {m('py')} AS prior_year,
  round((CAST(v AS DOUBLE) - CAST(py AS DOUBLE)) / nullif(CAST(py AS DOUBLE), 0), 6) AS yoy_pct,
  round((CAST(v AS DOUBLE) - CAST(pm AS DOUBLE)) / nullif(CAST(pm AS DOUBLE), 0), 6) AS mom_pct, round(ma, 6) AS moving_avg"""


@query(f"{FAMILY} SELECT {FAMILY_COLUMNS}, {m('v')} AS value FROM f")
def measure_suite(t):
    suite = TI.measure_suite(periods(t, "day"), ["grp"])
    return out(suite, "value", "ytd", "qtd", "mtd", "running", "prior_year", ratios=["yoy_pct", "mom_pct", "moving_avg"])


@query(
    f"""{FAMILY}, c AS (SELECT o_orderstatus AS grp, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, COUNT(*) AS n FROM orders GROUP BY ALL)
    SELECT {FAMILY_COLUMNS.replace('grp,', 'f.grp,').replace('CAST(d AS', 'CAST(f.d AS')}, {m('v')} AS total, round(CAST(v AS DOUBLE) / n, 6) AS average,
      round(CAST(v AS DOUBLE) / CAST(SUM(v) OVER (PARTITION BY f.d) AS DOUBLE), 6) AS pct_total, CAST(dense_rank() OVER (PARTITION BY f.d ORDER BY v DESC) AS INTEGER) AS rank
    FROM f JOIN c ON c.grp = f.grp AND c.d = f.d"""
)
def field_suite(t):
    orders = t.orders.withColumnRenamed("o_orderstatus", "grp")
    suite = TI.field_suite(orders, "o_orderdate", F.col("o_totalprice"), ["grp"])
    return out(
        suite, "total", "ytd", "qtd", "mtd", "running", "prior_year", ratios=["average", "yoy_pct", "mom_pct", "moving_avg", "pct_total"]
    )


@query(
    f"""SELECT grp, CAST(date_trunc('quarter', d) AS DATE)::VARCHAR AS period, {m('arg_min(v, d)')} AS opening, {m('arg_max(v, d)')} AS closing
    FROM ({DAILY}) GROUP BY 1, 2"""
)
def opening_closing_balance(t):
    return out(TI.balances(periods(t, "day"), "quarter", ["grp"]), "opening", "closing")


@query(
    """WITH f AS (SELECT user_id, MIN(CAST(ts AS DATE)) AS d FROM events GROUP BY 1), a AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events),
      n AS (SELECT a.d, COUNT(f.user_id) AS n FROM a LEFT JOIN f ON a.d = f.d GROUP BY 1)
    SELECT CAST(d AS VARCHAR) AS period, CAST(n AS BIGINT) AS new_entities, CAST(SUM(n) OVER (ORDER BY d) AS BIGINT) AS cumulative_entities FROM n"""
)
def cumulative_distinct(t):
    return out(TI.cumulative_distinct(t.events, "ts", "user_id"))


RATES = """SELECT period, active, prior_active, churned, retained, round(churned / nullif(CAST(prior_active AS DOUBLE), 0), 6) AS churn_rate,
  round(retained / nullif(CAST(prior_active AS DOUBLE), 0), 6) AS retention_rate FROM ({})"""
PAIRED = """
  WITH a AS (SELECT DISTINCT o_custkey AS e, CAST(date_trunc('{axis}', o_orderdate) AS DATE) AS d FROM orders),
  n AS (SELECT d, COUNT(*) AS active FROM a GROUP BY 1),
  r AS (SELECT c.d, COUNT(*) AS retained FROM a c JOIN a p ON p.e = c.e AND p.d = CAST(c.d - INTERVAL {step} AS DATE) GROUP BY 1)
  SELECT CAST(n.d AS VARCHAR) AS period, CAST(n.active AS BIGINT) AS active, CAST(COALESCE(b.active, 0) AS BIGINT) AS prior_active,
    CAST(COALESCE(b.active, 0) - COALESCE(r.retained, 0) AS BIGINT) AS churned, CAST(COALESCE(r.retained, 0) AS BIGINT) AS retained
  FROM n LEFT JOIN n b ON b.d = CAST(n.d - INTERVAL {step} AS DATE) LEFT JOIN r ON r.d = n.d"""


@query(RATES.format(PAIRED.format(axis="month", step="'1 month'")))
def churn(t):
    return out(TI.activity_changes(t.orders, "o_orderdate", "o_custkey", "month"), ratios=["churn_rate", "retention_rate"])


@query(RATES.format(PAIRED.format(axis="quarter", step="'1 year'")))
def retention(t):
    return out(TI.activity_changes(t.orders, "o_orderdate", "o_custkey", "quarter", "year"), ratios=["churn_rate", "retention_rate"])


@query(
    """WITH f AS (SELECT o_custkey, date_trunc('month', MIN(o_orderdate)) AS d FROM orders GROUP BY 1), a AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS d FROM orders)
    SELECT CAST(CAST(a.d AS DATE) AS VARCHAR) AS period, CAST(COUNT(f.o_custkey) AS BIGINT) AS new_entities FROM a LEFT JOIN f ON a.d = f.d GROUP BY 1"""
)
def new_entities(t):
    return out(TI.new_entities(t.orders, "o_orderdate", "o_custkey", "month"))


@query(
    f"""SELECT o_orderpriority, CAST(COUNT(*) AS BIGINT) AS entities, round(CAST(SUM(v) AS DOUBLE) / COUNT(*), 4) AS value_per_entity
    FROM (SELECT o_orderpriority, o_custkey, {total('o_totalprice')} AS v FROM orders GROUP BY 1, 2) GROUP BY 1"""
)
def lifetime_value(t):
    return P.per_entity(t.orders, "o_custkey", F.col("o_totalprice"), ["o_orderpriority"]).withColumn(
        "value_per_entity", ratio("value_per_entity", 4)
    )


@query(
    f"""SELECT l_returnflag, {m(total('l_quantity'))} AS total, CAST(COUNT(DISTINCT l_orderkey) AS BIGINT) AS orders,
      round(CAST({total('l_quantity')} AS DOUBLE) / COUNT(DISTINCT l_orderkey), 6) AS per_order FROM lineitem GROUP BY 1"""
)
def order_value(t):
    return out(P.per_order(t.lineitem, "l_orderkey", F.col("l_quantity"), ["l_returnflag"]), "total", ratios=["per_order"])


@query("SELECT CAST(COUNT(*) AS BIGINT) AS entities FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING COUNT(*) >= 12)")
def threshold_entities(t):
    return P.threshold_entities(t.orders, "o_custkey", F.count(F.lit(1)), ">=", 12)


@query("SELECT CAST(COUNT(*) AS BIGINT) AS entities FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING SUM(CAST(o_totalprice AS DECIMAL(38,9))) < 1500000)")
def threshold_value(t):
    return P.threshold_entities(t.orders, "o_custkey", exact_sum(F.col("o_totalprice")), "<", 1_500_000)


@query(
    f"""SELECT l_linestatus, round(CAST(SUM(CAST(l_discount * l_extendedprice AS DECIMAL(38,9))) AS DOUBLE) / CAST({total('l_extendedprice')} AS DOUBLE), 6) AS weighted_avg
    FROM lineitem GROUP BY 1"""
)
def weighted_avg(t):
    return out(P.weighted_average(t.lineitem, F.col("l_discount"), F.col("l_extendedprice"), ["l_linestatus"]), ratios=["weighted_avg"])


COST = "l_quantity * 900"


@query(
    f"""SELECT l_returnflag, {m(total(REVENUE), 4)} AS revenue, {m(total(COST), 4)} AS cost, {m(f"{total(REVENUE)} - {total(COST)}", 4)} AS profit,
      round(CAST({total(REVENUE)} - {total(COST)} AS DOUBLE) / CAST({total(REVENUE)} AS DOUBLE), 6) AS margin FROM lineitem GROUP BY 1"""
)
def margin(t):
    df = P.margin(t.lineitem, revenue(), F.col("l_quantity") * 900, ["l_returnflag"])
    return df.select("l_returnflag", *[money(c, 4).alias(c) for c in ("revenue", "cost", "profit")], ratio("margin").alias("margin"))


@query(
    f"""SELECT o_orderpriority, {m(total('o_totalprice'))} AS actual, {m(total('250000'))} AS budget, {m(f"{total('o_totalprice')} - {total('250000')}")} AS variance,
      round(CAST({total('o_totalprice')} - {total('250000')} AS DOUBLE) / CAST({total('250000')} AS DOUBLE), 6) AS variance_pct FROM orders GROUP BY 1"""
)
def variance(t):
    return out(
        P.variance(t.orders, F.col("o_totalprice"), F.lit(250000), ["o_orderpriority"]), "actual", "budget", "variance", ratios=["variance_pct"]
    )


@query(f"SELECT l_returnflag, {m(total('l_quantity * l_extendedprice'))} AS product_sum FROM lineitem GROUP BY 1")
def product_sum(t):
    return out(P.product_sum(t.lineitem, F.col("l_quantity"), F.col("l_extendedprice"), ["l_returnflag"]), "product_sum")


@query(
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(COUNT(*) FILTER (event_type = 'purchase') AS BIGINT) AS matched, CAST(COUNT(*) AS BIGINT) AS rows,
      round(COUNT(*) FILTER (event_type = 'purchase') / CAST(COUNT(*) AS DOUBLE), 6) AS conversion_rate FROM events GROUP BY 1"""
)
def conversion_rate(t):
    days = t.events.withColumn("day", F.col("ts").cast("date"))
    return out(P.conversion_rate(days, F.col("event_type") == "purchase", ["day"]).withColumn("day", text("day")), ratios=["conversion_rate"])


@query(
    f"""SELECT {m(total('o_totalprice'))} AS total, (SELECT COUNT(*) FROM customer) AS per_rows,
      round(CAST({total('o_totalprice')} AS DOUBLE) / (SELECT COUNT(*) FROM customer), 4) AS average_per FROM orders"""
)
def avg_per(t):
    df = P.average_per(t.orders, F.col("o_totalprice"), t.customer)
    return df.select(money("total").alias("total"), "per_rows", ratio("average_per", 4).alias("average_per"))


@query(
    """SELECT CASE WHEN value >= 200 THEN 'High' WHEN value >= 100 THEN 'Medium' WHEN value >= 20 THEN 'Low' ELSE 'Very Low' END AS tier,
      CAST(COUNT(*) AS BIGINT) AS rows FROM events GROUP BY 1"""
)
def tiers(t):
    steps = ((200, "High"), (100, "Medium"), (20, "Low"))
    return t.events.groupBy(P.tier(F.col("value"), steps).alias("tier")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    f"""WITH p AS ({monthly_sql(by=False)}), s AS (SELECT d, CAST(v AS DOUBLE) AS v, lag(CAST(v AS DOUBLE)) OVER (ORDER BY d) AS w, lag(d) OVER (ORDER BY d) AS wd FROM p),
      g AS (SELECT *, CASE WHEN w > 0 THEN (v - w) / w END AS drop FROM s), x AS (SELECT * FROM g WHERE drop < 0 ORDER BY drop, d LIMIT 1)
    SELECT CAST(MIN(p.d) AS VARCHAR) AS first_period, CAST(MAX(p.d) AS VARCHAR) AS last_period, {m('arg_min(v, d)')} AS first_value, {m('arg_max(v, d)')} AS last_value,
      round((CAST(arg_max(v, d) AS DOUBLE) - CAST(arg_min(v, d) AS DOUBLE)) / CAST(arg_min(v, d) AS DOUBLE), 6) AS change,
      (SELECT round(drop, 6) FROM x) AS steepest_drop, (SELECT CAST(wd AS VARCHAR) FROM x) AS drop_from, (SELECT CAST(d AS VARCHAR) FROM x) AS drop_to FROM p"""
)
def trend_drop(t):
    df = P.trend(periods(t, "month", ()))
    return df.select(
        *[text(c).alias(c) for c in ("first_period", "last_period", "drop_from", "drop_to")],
        money("first_value").alias("first_value"), money("last_value").alias("last_value"),
        ratio("change").alias("change"), ratio("steepest_drop").alias("steepest_drop"),
    )


MEMBERS = f"SELECT c_nationkey, {total('o_totalprice')} AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"


def by_nation(t):
    keys = t.orders.groupBy("o_custkey").agg(exact_sum(F.col("o_totalprice")).alias("v"))
    joined = keys.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey").agg(F.sum("v").alias("value"))


def by_customer(t):
    return t.orders.groupBy("o_custkey").agg(exact_sum(F.col("o_totalprice")).alias("value"))


CUSTOMERS = f"SELECT o_custkey, {total('o_totalprice')} AS v FROM orders GROUP BY 1"


@query(f"SELECT c_nationkey, {m('v')} AS value, round(CAST(v AS DOUBLE) / (SELECT CAST(SUM(v) AS DOUBLE) FROM ({MEMBERS})), 6) AS share FROM ({MEMBERS}) ORDER BY v DESC LIMIT 5")
def contributors(t):
    return out(P.contributors(by_nation(t)), "value", ratios=["share"])


@query(f"SELECT o_custkey, {m('v')} AS value, CAST(dense_rank() OVER (ORDER BY v DESC) AS BIGINT) AS rank FROM ({CUSTOMERS})")
def dense_rank(t):
    return out(R.dense_rank(by_customer(t), "value"), "value")


@query("SELECT p_partkey, p_size, CAST(dense_rank() OVER (ORDER BY p_size DESC) AS BIGINT) AS rank FROM part")
def dense_rank_ties(t):
    return R.dense_rank(t.part.select("p_partkey", "p_size"), "p_size")


@query(f"SELECT o_custkey, {m('v')} AS value, round(CAST(v AS DOUBLE) / (SELECT CAST(SUM(v) AS DOUBLE) FROM ({CUSTOMERS})), 6) AS share FROM ({CUSTOMERS})")
def pct_of_total(t):
    return out(R.share_of_total(by_customer(t), "value"), "value", ratios=["share"])


@query(
    f"""SELECT c_nationkey, {m('v')} AS value, round(CAST(v AS DOUBLE) / (SELECT CAST(SUM(v) AS DOUBLE) FROM ({MEMBERS})), 6) AS share
    FROM ({MEMBERS}) WHERE c_nationkey < 10"""
)
def pct_of_all_rows(t):
    """Shares of the filtered members in the total before the filter."""
    nations = by_nation(t)
    return out(R.share_of_total(nations.where("c_nationkey < 10"), "value", total=nations), "value", ratios=["share"])


@query(
    """SELECT p_partkey, p_size, rank FROM (SELECT p_partkey, p_size, CAST(rank() OVER (ORDER BY p_size DESC) AS BIGINT) AS rank FROM part WHERE p_type <> 'SMALL')
    WHERE rank <= 10"""
)
def top_n_ties(t):
    return R.top_members(t.part.select("p_partkey", "p_size", "p_type"), "p_size", 10, F.col("p_type") == "SMALL").drop("p_type")


@query(f"SELECT o_custkey, v_rank AS rank, {m('v')} AS value FROM (SELECT *, CAST(rank() OVER (ORDER BY v DESC) AS BIGINT) AS v_rank FROM ({CUSTOMERS})) WHERE v_rank <= 25")
def top_n_members(t):
    return out(R.top_members(by_customer(t), "value", 25), "value")


@query(f"SELECT CAST(d AS VARCHAR) AS period, {m('v')} AS value, {m('lag(v) OVER (ORDER BY d)')} AS previous FROM ({monthly_sql(by=False)})")
def prev_row(t):
    return out(R.previous_row(periods(t, "month", ()), "period", [], "value"), "value", "previous")


@query(f"SELECT CAST(d AS VARCHAR) AS period, {m('v')} AS value, {m('SUM(v) OVER (ORDER BY d ROWS 2 PRECEDING)')} AS window_sum FROM ({monthly_sql(by=False)})")
def window_3(t):
    return out(R.row_window(periods(t, "month", ()), "period", [], "value"), "value", "window_sum")


@query(f"SELECT CAST(d AS VARCHAR) AS period, {m('v')} AS value, {m('first(v) OVER (ORDER BY d)')} AS first_value FROM ({monthly_sql(by=False)})")
def first_row(t):
    return out(R.first_row(periods(t, "month", ()), "period", [], "value"), "value", "first_value")


@query(f"SELECT o_custkey, {m('v')} AS value, CAST(row_number() OVER (ORDER BY v, o_custkey) AS BIGINT) AS position FROM ({CUSTOMERS})")
def row_positions(t):
    return out(R.row_positions(by_customer(t), "value", ["o_custkey"]), "value")
