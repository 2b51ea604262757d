"""Query sources: a database over JDBC, or anything Spark can name."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tieout.model import Side

FETCH_SIZE = 10_000


def jdbc_query(
    spark: SparkSession,
    url: str,
    query: str,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int | None = None,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A query run in the database. With a partition column its ranges are read by separate tasks.

    Filters and columns the plan needs are pushed into the database's query by Spark.
    """
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", FETCH_SIZE)
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    if partition_column is None:
        return reader.option("query", query).load()
    if bounds is None or partitions is None:
        raise ValueError("a partitioned read needs bounds and a number of partitions")
    return (
        reader.option("dbtable", f"({query}) q")
        .option("partitionColumn", partition_column)
        .option("lowerBound", bounds[0])
        .option("upperBound", bounds[1])
        .option("numPartitions", partitions)
        .load()
    )


def capped(df: DataFrame, cap: int, label: str = "", query: str = "") -> Side:
    """A side that knows whether it exceeds a row cap that the caller names.

    Rows are counted where they are; no columns are read and no rows are moved. The rows themselves are
    not cut: within the cap there is nothing to cut, and beyond it the comparison is refused and says
    how many rows there were.
    """
    read_at = datetime.now(timezone.utc)
    seen = df.count()
    return Side(df, label=label, executed_at=read_at, truncated=seen > cap, query=query, rows_seen=seen)


def side(df: DataFrame, label: str = "", query: str = "") -> Side:
    """A whole side, stamped with the time it was taken."""
    return Side(df, label=label, executed_at=datetime.now(timezone.utc), query=query)


def sql_side(spark: SparkSession, query: str, label: str = "") -> Side:
    return side(spark.sql(query), label, query)
