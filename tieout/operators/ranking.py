"""Global order without a single-task window: ranks, row positions, shares and top members.

A window without a partition sends every row to one task. Here rows are range-partitioned and sorted
within the partitions, which numbers them locally; the sizes of the partitions before (one row per
partition) complete the number. The numbered rows are written once, so numbers never change when a
lost executor makes Spark repeat work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.model import quoted
from tieout.session import checkpointed

# Fixed value: Spark's row ids keep the partition above this bit and the row within it below.
ROW_BITS = 33


def _numbered(df: DataFrame, order: Sequence[Column], name: str, slices: int | None) -> DataFrame:
    """Rows with their number, counted from 1, in a total order."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = checkpointed(placed)
    slice_no = F.shiftright("__id", ROW_BITS)
    sizes = placed.groupBy(slice_no.alias("__slice")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice, so this window and the broadcast are bounded by the number of slices.
    offsets = sizes.select("__slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    local = F.col("__id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    return (
        placed.withColumn("__slice", slice_no)
        .join(F.broadcast(offsets), "__slice")
        .withColumn(name, (local + F.col("__before")).cast("bigint"))
        .drop("__id", "__slice", "__before")
    )


def dense_rank(members: DataFrame, value: str, name: str = "rank", slices: int | None = None) -> DataFrame:
    """Dense rank by value, largest first; a blank ranks after every value.

    Values are made distinct before they are numbered, so ties of any size cost one row.
    """
    values = members.select(quoted(value).alias("__value")).where("__value is not null").distinct()
    ranks = _numbered(values, [F.col("__value").desc()], name, slices)
    after_all = ranks.agg(F.count(F.lit(1)) + 1).scalar()
    joined = members.join(ranks, quoted(value) == F.col("__value"), "left").drop("__value")
    return joined.withColumn(name, F.coalesce(quoted(name), after_all))


def row_positions(members: DataFrame, order: str, ties: Sequence[str], name: str = "position", slices: int | None = None) -> DataFrame:
    """Position of each row, counted from 1 in ascending order, blanks last.

    ``ties`` make the order total. They take part in the partitioning, so rows that share one order
    value are spread over partitions as well.
    """
    return _numbered(members, [quoted(order).asc_nulls_last(), *[quoted(t).asc_nulls_last() for t in ties]], name, slices)


def previous_row(members: DataFrame, order: str, ties: Sequence[str], value: str, name: str = "previous") -> DataFrame:
    """The value of the row just before, over the whole result."""
    placed = row_positions(members, order, ties, "__at")
    shifted = placed.select((F.col("__at") + 1).alias("__at"), quoted(value).alias(name))
    return placed.join(shifted, "__at", "left").drop("__at")


def row_window(members: DataFrame, order: str, ties: Sequence[str], value: str, back: int = 2, name: str = "window_sum") -> DataFrame:
    """Sum over the row and the ``back`` rows before it, over the whole result."""
    placed = row_positions(members, order, ties, "__at")
    reach = placed.select(
        F.explode(F.sequence(F.col("__at"), F.col("__at") + back)).alias("__at"), quoted(value).alias("__v")
    )
    sums = reach.groupBy("__at").agg(F.sum("__v").alias(name))
    return placed.join(sums, "__at", "left").drop("__at")


def first_row(members: DataFrame, order: str, ties: Sequence[str], value: str, name: str = "first_value") -> DataFrame:
    """Every row with the value of the first row of the whole result."""
    key = F.struct(quoted(order), *[quoted(t) for t in ties])
    return members.withColumn(name, members.agg(F.min_by(quoted(value), key)).scalar())


def share_of_total(members: DataFrame, value: str, name: str = "share", total: DataFrame | None = None) -> DataFrame:
    """Share of each row in the total of all rows, or of ``total`` (the rows before a filter)."""
    whole = (members if total is None else total).agg(F.sum(quoted(value))).scalar()
    return members.withColumn(name, F.try_divide(quoted(value).cast("double"), whole.cast("double")))


def top_members(members: DataFrame, value: str, n: int, exclude: Column | None = None, name: str = "rank") -> DataFrame:
    """The ``n`` largest members by value with every tie of the last one, and their rank.

    The n-th value comes from a distributed top-n; its distinct values are at most n rows, which
    bounds the broadcast that picks the members.
    """
    pool = members if exclude is None else members.where(~exclude)
    pool = pool.where(quoted(value).isNotNull())
    best = pool.select(quoted(value).alias("__top")).orderBy(F.col("__top").desc()).limit(n)
    # At most n rows: the rank of a value is one more than the number of larger rows among them.
    ranked = best.withColumn(name, F.rank().over(Window.orderBy(F.col("__top").desc())).cast("bigint")).distinct()
    return pool.join(F.broadcast(ranked), quoted(value) == F.col("__top"), "inner").drop("__top")
