"""File sources."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions.numbers import trimmed
from tieout.model import quoted

# The file kinds that can be read, by extension.
READERS = {"csv": ",", "tsv": "\t", "txt": ","}


def clean_headers(names: Sequence[str | None]) -> list[str]:
    """Blank headers get a numbered name; a repeated header gets a suffix, since columns need names of their own."""
    out: list[str] = []
    for i, name in enumerate(names):
        base = name if name is not None and name.strip() != "" else f"Column {i + 1}"
        unique, n = base, 2
        while unique.lower() in {o.lower() for o in out}:
            unique, n = f"{base}_{n}", n + 1
        out.append(unique)
    return out


def table_id(name: str, taken: Sequence[str] = ()) -> str:
    """A lower-case identifier for a table, unlike any already taken."""
    base = re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", name.lower())) or "table"
    unique, n = base, 2
    while unique in taken:
        unique, n = f"{base}_{n}", n + 1
    return unique


def read_text_table(spark: SparkSession, path: str, delimiter: str | None = None, multiline: bool = True) -> DataFrame:
    """Delimited text with a header row, every column as text; rows without any content are dropped.

    Short rows are padded with NULL and long ones cut to the header, as Spark's permissive reader
    does. A line break inside quotes belongs to its cell, which ties each file to one task; pass
    ``multiline=False`` for files known to have none, and Spark splits them. Only the header line is
    read on the driver.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    sep = delimiter or READERS.get(kind, ",")
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "header": "true", "multiLine": str(multiline).lower()}
    headers = spark.read.options(**options, inferSchema="false").csv(path).columns
    # Spark numbers blank headers itself (_c0, _c1 …) while reading.
    names = clean_headers([None if h == f"_c{i}" else h for i, h in enumerate(headers)])
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = spark.read.options(**options, enforceSchema="true").schema(schema).csv(path).toDF(*names)
    return drop_blank_rows(rows)


def drop_blank_rows(df: DataFrame) -> DataFrame:
    filled = [F.coalesce(trimmed(quoted(c).cast("string")) != "", F.lit(False)) for c in df.columns]
    return df.where(reduce(lambda a, b: a | b, filled))


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder by its extension."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind in READERS:
        return read_text_table(spark, path)
    raise ValueError(f"cannot read a .{kind} file: use csv, tsv, txt or parquet")


def read_tables(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Several tables, under unique identifiers made from their names."""
    out: dict[str, DataFrame] = {}
    for name, path in paths.items():
        out[table_id(name, list(out))] = read_table(spark, path)
    return out
