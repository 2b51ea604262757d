"""Registered queries: a function over the tables of a folder, and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class Tables:
    """The tables of one folder. A table's files are looked at when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, df)
        return df

    def star(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in STAR}


def query(sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def money(value: Column | str, digits: int = 2) -> Column:
    """An exact amount as a double, for a result that is checked against another engine."""
    value = F.col(value) if isinstance(value, str) else value
    return value.cast(f"decimal(38,{digits})").cast("double")


def ratio(value: Column | str, digits: int = 6) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), digits)


def text(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.cast("string")


def m(expression: str, digits: int = 2) -> str:
    """The SQL of ``money``."""
    return f"CAST(CAST({expression} AS DECIMAL(38,{digits})) AS DOUBLE)"


def total(expression: str) -> str:
    """The SQL of an exact sum."""
    return f"SUM(CAST({expression} AS DECIMAL(38,9)))"
