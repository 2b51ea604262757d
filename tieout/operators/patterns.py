"""Business measure patterns on top of grouped totals."""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions.numbers import SUM_TYPE, addable, exact_sum, safe_divide
from tieout.model import quoted

COMPARISONS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}

# The default tiers, highest first.
TIERS = ((1000, "High"), (500, "Medium"), (100, "Low"))
LOWEST_TIER = "Very Low"


def per_entity(fact: DataFrame, entity: str, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Lifetime value: the mean of the totals of each entity."""
    totals = fact.groupBy(*[quoted(b) for b in by], quoted(entity).alias("entity")).agg(exact_sum(value).alias("total"))
    return totals.groupBy(*[quoted(b) for b in by]).agg(
        F.count(F.lit(1)).alias("entities"),
        safe_divide(F.sum("total"), F.count("total")).alias("value_per_entity"),
    )


def per_order(fact: DataFrame, order: str | None, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Average order value or items per order: total over distinct orders (over rows without an order id).

    Lines are summed per order before orders are counted, which avoids a distinct count beside a sum.
    """
    keys = [quoted(b) for b in by]
    if order is None:
        grouped = fact.groupBy(*keys).agg(exact_sum(value).alias("total"), F.count(F.lit(1)).alias("orders"))
    else:
        lines = fact.groupBy(*keys, quoted(order).alias("order_id")).agg(exact_sum(value).alias("v"))
        grouped = lines.groupBy(*keys).agg(F.sum("v").cast(SUM_TYPE).alias("total"), F.count(F.lit(1)).alias("orders"))
    return grouped.withColumn("per_order", safe_divide(F.col("total"), F.col("orders")))


def threshold_entities(fact: DataFrame, entity: str, metric: Column, op: str, threshold) -> DataFrame:
    """How many entities have a metric past a threshold. ``metric`` is an aggregate."""
    passed = COMPARISONS[op](F.col("metric"), F.lit(threshold))
    return (
        fact.groupBy(quoted(entity)).agg(metric.alias("metric")).where(passed).agg(F.count(F.lit(1)).alias("entities"))
    )


def variance(df: DataFrame, actual: Column, budget: Column, by: Sequence[str] = ()) -> DataFrame:
    grouped = df.groupBy(*[quoted(b) for b in by]).agg(exact_sum(actual).alias("actual"), exact_sum(budget).alias("budget"))
    gap = (F.col("actual") - F.col("budget")).cast(SUM_TYPE)
    return grouped.withColumn("variance", gap).withColumn("variance_pct", safe_divide(F.col("variance"), F.col("budget")))


def margin(df: DataFrame, revenue: Column, cost: Column, by: Sequence[str] = ()) -> DataFrame:
    grouped = df.groupBy(*[quoted(b) for b in by]).agg(exact_sum(revenue).alias("revenue"), exact_sum(cost).alias("cost"))
    gap = (F.col("revenue") - F.col("cost")).cast(SUM_TYPE)
    return grouped.withColumn("profit", gap).withColumn("margin", safe_divide(F.col("profit"), F.col("revenue")))


def weighted_average(df: DataFrame, value: Column, weight: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean of a value weighted by another; a row without either one has no part in it."""
    both = value.isNotNull() & weight.isNotNull()
    top = F.sum(F.when(both, addable(value * weight)))
    return df.groupBy(*[quoted(b) for b in by]).agg(safe_divide(top, F.sum(F.when(both, addable(weight)))).alias("weighted_avg"))


def product_sum(df: DataFrame, a: Column, b: Column, by: Sequence[str] = ()) -> DataFrame:
    """Sum of a row product; one factor may come from a dimension looked up before."""
    return df.groupBy(*[quoted(c) for c in by]).agg(exact_sum(a * b).alias("product_sum"))


def conversion_rate(df: DataFrame, matched: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows that match."""
    return (
        df.groupBy(*[quoted(b) for b in by])
        .agg(F.count_if(matched).alias("matched"), F.count(F.lit(1)).alias("rows"))
        .withColumn("conversion_rate", safe_divide(F.col("matched"), F.col("rows")))
    )


def average_per(fact: DataFrame, value: Column, other: DataFrame) -> DataFrame:
    """A total of one table divided by the row count of another."""
    count = other.agg(F.count(F.lit(1))).scalar()
    total = fact.agg(exact_sum(value).alias("total")).withColumn("per_rows", count)
    return total.withColumn("average_per", safe_divide(F.col("total"), F.col("per_rows")))


def tier(value: Column, steps: Sequence[tuple] = TIERS, lowest: str = LOWEST_TIER) -> Column:
    """Tier of a value; steps go from the highest limit down."""
    column = None
    for limit, label in steps:
        column = F.when(value >= limit, label) if column is None else column.when(value >= limit, label)
    return F.lit(lowest) if column is None else column.otherwise(lowest)


def trend(periods: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """First and last period with the change between them, and the steepest fall from one to the next.

    Falls count only from a positive value. ``periods`` is an aggregated time series.
    """
    keys = [quoted(b) for b in by]
    w = Window.partitionBy(*keys).orderBy("period")
    stepped = periods.select(
        *keys, "period", quoted(value).alias("v"), F.lag(quoted(value)).over(w).alias("was"), F.lag("period").over(w).alias("was_at")
    )
    fall = F.when(F.col("was") > 0, safe_divide(F.col("v") - F.col("was"), F.col("was")))
    worst = F.struct("drop", "period", "was_at", "was", "v")
    falls = stepped.withColumn("drop", fall).withColumn("f", F.when(F.col("drop") < 0, worst))
    first, last = F.min_by("v", "period"), F.max_by("v", "period")
    return falls.groupBy(*keys).agg(
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        first.alias("first_value"),
        last.alias("last_value"),
        F.min("f").alias("w"),
    ).select(
        *keys,
        "first_period",
        "last_period",
        "first_value",
        "last_value",
        F.coalesce(safe_divide(F.col("last_value") - F.col("first_value"), F.col("first_value")), F.lit(0.0)).alias("change"),
        F.col("w.drop").alias("steepest_drop"),
        F.col("w.was_at").alias("drop_from"),
        F.col("w.period").alias("drop_to"),
    )


def contributors(members: DataFrame, value: str = "value", top_n: int = 5, weakest: bool = False) -> DataFrame:
    """Largest or smallest members with their share of the total."""
    total = members.agg(F.sum(quoted(value))).scalar()
    order = quoted(value).asc() if weakest else quoted(value).desc()
    tie = [quoted(c) for c in members.columns if c != value]
    return (
        members.withColumn("share", safe_divide(quoted(value), total)).orderBy(order, *tie).limit(top_n)
    )


