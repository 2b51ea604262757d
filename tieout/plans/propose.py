"""Propose a suite of checks from two catalogues and the relationships between the target's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Column types that carry a date, and how many date checks a table gets.
DATE_TYPES = ["date", "datetime", "datetime2", "smalldatetime", "datetimeoffset", "timestamp", "timestamp_ntz"]
DATE_CHECKS_PER_TABLE = 2


def matched_tables(targets: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Target tables with the source object each one reads.

    ``targets`` has ``table, kind, reads_from, filtered``: ``reads_from`` names the source object
    where the table's own definition does, otherwise names are matched without regard to case.
    """
    objects = catalogue.select(F.lower("table").alias("object_key"), F.col("table").alias("object")).distinct()
    queried = targets.where("kind = 'query'")
    by_query = queried.join(objects, F.lower("reads_from") == F.col("object_key"), "inner").withColumn("matched_by", F.lit("query"))
    rest = queried.join(objects, F.lower("reads_from") == F.col("object_key"), "left_anti")
    by_name = rest.join(objects, F.lower("table") == F.col("object_key"), "inner").withColumn("matched_by", F.lit("name"))
    caution = F.concat_ws(
        "; ",
        F.when(F.col("matched_by") == "name", "matched by name only"),
        F.when(F.col("filtered"), "the target filters rows, so a difference may be right"),
    )
    return by_query.unionByName(by_name).select(
        "table", "object", "matched_by", F.when(caution != "", caution).alias("caution")
    )


def propose_checks(targets: DataFrame, catalogue: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row per proposed check: row counts, up to two date ranges per table, duplicates on a
    declared key, and orphans per active relationship."""
    matches = matched_tables(targets, catalogue)
    columns = catalogue.select(
        F.col("table").alias("object"), F.col("column"), F.lower("type").alias("type"), "position", "key_position"
    )
    empty = F.lit(None).cast("string")
    counts = matches.select(
        F.lit("rowCount").alias("kind"), "table", "object", empty.alias("columns"), empty.alias("other"), "matched_by", "caution"
    )
    first_dates = Window.partitionBy("table").orderBy("position")
    dates = (
        matches.join(columns.where(F.col("type").isin(*DATE_TYPES)), "object")
        .withColumn("nth", F.row_number().over(first_dates))
        .where(F.col("nth") <= DATE_CHECKS_PER_TABLE)
        .select(F.lit("dateRange").alias("kind"), "table", "object", F.col("column").alias("columns"), empty.alias("other"), "matched_by", "caution")
    )
    # A declared key has a handful of columns, so gathering its names is bounded.
    keys = (
        columns.where("key_position is not null")
        .groupBy("object")
        .agg(F.array_sort(F.collect_list(F.struct("key_position", "column"))).alias("k"))
        .select("object", F.concat_ws(" + ", F.col("k.column")).alias("columns"))
    )
    duplicates = matches.join(keys, "object").select(
        F.lit("duplicates").alias("kind"), "table", "object", "columns", empty.alias("other"), "matched_by", "caution"
    )
    fact = matches.select(F.col("table").alias("from_table"), "object", "matched_by")
    dim = matches.select(
        F.col("table").alias("to_table"), F.col("object").alias("to_object"), F.col("matched_by").alias("to_matched_by")
    )
    known = columns.select("object", F.lower("column").alias("known"))
    orphans = (
        relationships.where("active")
        .join(fact, "from_table")
        .join(dim, "to_table")
        .join(known.alias("f"), (F.col("f.object") == fact["object"]) & (F.col("f.known") == F.lower("from_col")), "left_semi")
        .join(known.alias("d"), (F.col("d.object") == F.col("to_object")) & (F.col("d.known") == F.lower("to_col")), "left_semi")
        .select(
            F.lit("orphans").alias("kind"),
            F.col("from_table").alias("table"),
            "object",
            F.col("from_col").alias("columns"),
            F.concat("to_table", F.lit("."), "to_col").alias("other"),
            "matched_by",
            F.when((F.col("matched_by") == "name") | (F.col("to_matched_by") == "name"), "matched by name only").alias("caution"),
        )
    )
    return counts.unionByName(dates).unionByName(duplicates).unionByName(orphans)


def unmatched_tables(targets: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Target tables left out, and why."""
    matches = matched_tables(targets, catalogue).select("table")
    derived = targets.where("kind = 'calculated'").select("table", F.lit("derived in the target: no source to compare with").alias("reason"))
    missing = (
        targets.where("kind = 'query'")
        .join(matches, "table", "left_anti")
        .select("table", F.lit("no source table or view of that name").alias("reason"))
    )
    return derived.unionByName(missing)
