"""Check generators. Each returns one side of a check as a DataFrame; run it on both systems and compare.

Every generator is one aggregate over the raw rows, so partial aggregation happens before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.functions.numbers import exact_sum
from tieout.model import quoted


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def distinct_values(df: DataFrame, column: str, include_blank: bool = False) -> DataFrame:
    """Distinct values. NULL is not one of them unless ``include_blank`` asks for it.

    Values are grouped first and counted after, so a frequent value shrinks to one row per task.
    """
    values = df.select(quoted(column).alias("value")).distinct()
    counted = F.count("value") if not include_blank else F.count(F.lit(1))
    return values.agg(counted.alias("distinct_values"))


def null_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(quoted(column).isNull()).alias("blanks"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys repeat, and how many surplus rows that makes. Clean data gives 0 and 0."""
    repeated = df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return repeated.agg(
        F.count(F.lit(1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("extra_rows"),
    )


def date_coverage(df: DataFrame, column: str) -> DataFrame:
    """First and last date, and how many distinct dates carry data.

    Grouping by date first leaves a few thousand rows per task for the three aggregates.
    """
    dates = df.select(quoted(column).alias("date")).distinct()
    return dates.agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("date").alias("days")
    )


def value_set(df: DataFrame, column: str) -> DataFrame:
    """Every distinct value and how often it occurs. Compared on both sides it is the named set difference."""
    return df.groupBy(quoted(column).alias("value")).agg(F.count(F.lit(1)).alias("frequency"))


def orphan_keys(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Fact rows, and distinct keys, that point at no dimension row. A NULL key is not an orphan.

    The fact is reduced to one counted row per key before the anti join. A key with a third of all
    rows joins as a single row, and the fact is shuffled once at the size of its key set.
    """
    keys = (
        fact.where(quoted(fact_key).isNotNull())
        .groupBy(quoted(fact_key).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = dim.select(quoted(dim_key).alias("dim_key"))
    orphans = keys.join(known, F.col("key") == F.col("dim_key"), "left_anti")
    return orphans.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphans"),
        F.count(F.lit(1)).alias("orphan_keys"),
    )


def by_grain(df: DataFrame, dimensions: Sequence[str | Column], measure: str | Column | None = None) -> DataFrame:
    """A total, or the row count, at each combination of the dimensions (coarsest first)."""
    dims = [quoted(d) if isinstance(d, str) else d for d in dimensions]
    if measure is None:
        value = F.count(F.lit(1))
    else:
        value = exact_sum(quoted(measure) if isinstance(measure, str) else measure)
    return df.groupBy(*dims).agg(value.alias("value"))


def table_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and the blank count of every column in one pass, one row per column."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(quoted(c).isNull()).alias(f"b{i}") for i, c in enumerate(columns)]
    )
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("blanks")) for i, c in enumerate(columns)]
    return counts.select("rows", F.explode(F.array(*entries)).alias("e")).select("e.column", "rows", "e.blanks")


def key_overlap(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Distinct keys on each side and on both, by one grouping of the stacked keys."""
    stacked = left.select(quoted(left_key).alias("key"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(quoted(right_key).alias("key"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sides = stacked.where("key is not null").groupBy("key").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(
        F.count_if(F.col("l") == 1).alias("left_keys"),
        F.count_if(F.col("r") == 1).alias("right_keys"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("shared_keys"),
    )


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every distinct row with the sides it occurs on; repeated rows combine before the one shuffle."""
    if len(left.columns) != len(right.columns):
        raise ValueError("the two sides have different numbers of columns")
    tagged = lambda df, l, r: df.toDF(*left.columns).withColumns({"__l": F.lit(l), "__r": F.lit(r)})
    stacked = tagged(left, 1, 0).unionByName(tagged(right, 0, 1))
    return stacked.groupBy(*[quoted(c) for c in left.columns]).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))


def only_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of the left side that the right side lacks (NULL equals NULL)."""
    return _sides(left, right).where("__l = 1 and __r = 0").drop("__l", "__r")


def in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows present on both sides (NULL equals NULL)."""
    return _sides(left, right).where("__l = 1 and __r = 1").drop("__l", "__r")
