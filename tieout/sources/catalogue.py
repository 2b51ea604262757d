"""A catalogue of tables and columns, with declared keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "table string, kind string, column string, position int, type string, nullable boolean, key_position int"


def describe(
    spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None, kind: str = "table"
) -> DataFrame:
    """One row per column of each table. Keys are declared, never guessed, and keep their order."""
    rows = []
    for name, df in tables.items():
        declared = list((keys or {}).get(name, ()))
        unknown = set(declared) - set(df.columns)
        if unknown:
            raise ValueError(f"{name} has no columns {sorted(unknown)}")
        for i, f in enumerate(df.schema.fields):
            at = declared.index(f.name) + 1 if f.name in declared else None
            rows.append((name, kind, f.name, i, f.dataType.simpleString(), f.nullable, at))
    return spark.createDataFrame(rows, SCHEMA)


def describe_database(spark: SparkSession, database: str | None = None, keys: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The tables and views Spark's own catalogue lists."""
    out = None
    for t in spark.catalog.listTables(database) if database else spark.catalog.listTables():
        name = t.name if t.isTemporary else ".".join([*(t.namespace or []), t.name])
        part = describe(spark, {t.name: spark.table(name)}, keys, "view" if "VIEW" in t.tableType or t.isTemporary else "table")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out
