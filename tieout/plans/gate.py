"""Gates: recorded control totals checked again, and two variants of a query that must agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.functions.normalize import is_number
from tieout.functions.numbers import nearly_equal
from tieout.model import Measure, quoted
from tieout.operators.measures import aggregate


def control_totals(df: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """The measures of a table as one row per measure, ready to be recorded."""
    totals = df.agg(*[aggregate(m).alias(f"m{i}") for i, m in enumerate(measures)])
    entries = [
        F.struct(F.lit(m.name).alias("measure"), F.col(f"m{i}").cast("double").alias("actual"))
        for i, m in enumerate(measures)
    ]
    return totals.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def verify_totals(recorded: DataFrame, df: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """Recorded totals (``measure, expected[, tolerance]``) against a fresh aggregate.

    Without a tolerance of its own a total may move by one, or by a thousandth, whichever is more.
    """
    tolerance = F.greatest(F.lit(1.0), F.abs(F.col("expected")) * 0.001)
    if "tolerance" in recorded.columns:
        tolerance = F.coalesce(F.col("tolerance").cast("double"), tolerance)
    fresh = control_totals(df, measures)
    ok = F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= F.col("allowed"), F.lit(False))
    return (
        recorded.join(fresh, "measure", "left")
        .withColumn("expected", F.col("expected").cast("double"))
        .withColumn("allowed", tolerance)
        .select("measure", "expected", "actual", "allowed", ok.alias("ok"))
    )


def gate(checks: DataFrame) -> DataFrame:
    """Green when there is something to verify and all of it holds."""
    good = F.coalesce(F.bool_and("ok"), F.lit(False))
    return checks.agg(
        F.when(good, "green").otherwise("red").alias("gate"),
        F.count_if("ok").alias("reconciled"),
        F.count(F.lit(1)).alias("checked"),
    )


def variants_agree(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows where two variants of one query differ; no rows means they agree.

    Both variants are stacked and grouped once by their key. A key that one variant lacks or repeats
    is reported too: repeated rows cannot be paired, so agreement is never claimed for them.
    """
    values = [c for c in left.columns if c not in keys]
    if set(left.columns) != set(right.columns):
        raise ValueError("the variants have different columns")
    types = {c: left.schema[c].dataType for c in values}

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*[quoted(k) for k in keys], F.lit(tag).alias("side"), *[quoted(v).alias(f"v{i}") for i, v in enumerate(values)])

    stacked = side(left, "l").unionByName(side(right, "r"))
    here = lambda tag, c: F.when(F.col("side") == tag, c)
    aggs = [F.count(here(t, F.lit(1))).alias(f"{t}n") for t in "lr"]
    aggs += [F.max(here(t, F.col(f"v{i}"))).alias(f"{t}{i}") for i in range(len(values)) for t in "lr"]
    grouped = stacked.groupBy(*[quoted(k) for k in keys]).agg(*aggs)
    same = (F.col("ln") == 1) & (F.col("rn") == 1)
    for i, v in enumerate(values):
        a, b = F.col(f"l{i}"), F.col(f"r{i}")
        same = same & (nearly_equal(a, b, tolerance) if is_number(types[v]) else a.eqNullSafe(b))
    return grouped.where(~same).select(
        *[quoted(k) for k in keys],
        F.col("ln").alias("left_rows"),
        F.col("rn").alias("right_rows"),
        *[F.col(f"{t}{i}").alias(f"{name}_{v}") for i, v in enumerate(values) for t, name in (("l", "left"), ("r", "right"))],
    )
