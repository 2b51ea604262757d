"""Saved checks, suite runs and their evidence."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions.cells import DEFAULT, Tolerance
from tieout.functions.normalize import Normalize
from tieout.functions.numbers import shown_delta, shown_number
from tieout.model import Side, quoted
from tieout.operators.compare import Comparison, compare

OTHER_GROUP = "Other checks"

METRIC = (
    "array<struct<metric:string,source:string,target:string,source_num:decimal(37,9),"
    "target_num:decimal(37,9),delta:decimal(38,9),status:string>>"
)
OUTCOME = (
    f"check_id string, name string, table_name string, status string, matched bigint, mismatched bigint, "
    f"only_source bigint, only_target bigint, compared_rows bigint, source_rows bigint, target_rows bigint, "
    f"refusal_kind string, error string, metrics {METRIC}, duration_ms bigint, ran_at timestamp"
)


@dataclass(frozen=True)
class Check:
    """A saved check: two result sets, how they pair, and the slack allowed.

    ``source`` and ``target`` may be functions of no arguments, so a broken query is that check's
    error and not the suite's.
    """

    check_id: str
    name: str
    source: DataFrame | Side | Callable[[], DataFrame]
    target: DataFrame | Side | Callable[[], DataFrame]
    keys: tuple = ()
    values: tuple = ()
    tolerance: Tolerance = DEFAULT
    normalize: Normalize = Normalize()
    table: str | None = None
    enabled: bool = True

    def comparison(self) -> Comparison:
        s = self.source() if callable(self.source) else self.source
        t = self.target() if callable(self.target) else self.target
        return compare(s, t, self.keys, self.values, self.tolerance, self.normalize)


def classify(refusal_kind: Column, mismatched: Column, only_source: Column, only_target: Column) -> Column:
    """pass, fail or inconclusive. A refusal never counts as a pass."""
    clean = (mismatched == 0) & (only_source == 0) & (only_target == 0)
    return F.when(refusal_kind.isNotNull(), "inconclusive").when(clean, "pass").otherwise("fail")


def outcome(check: Check) -> DataFrame:
    """One row for one check: verdict, counts and, where a single row was compared, the values."""
    result = check.comparison()
    only = F.col("compared_rows") == 1
    quotes = [
        F.struct(
            F.lit(v).alias("metric"),
            *[
                # With one compared row any aggregate returns its value.
                F.max(quoted(f"{v}_{part}")).alias(part)
                for part in ("source", "target", "source_num", "target_num", "delta", "status")
            ],
        )
        for v in result.values
    ]
    metrics = F.array(*quotes).cast(METRIC) if quotes else F.array().cast(METRIC)
    summary = result.summarise([metrics.alias("metrics")]).withColumn(
        "compared_rows", F.col("matched") + F.col("mismatched") + F.col("only_source") + F.col("only_target")
    )
    return summary.select(
        F.lit(check.check_id).alias("check_id"),
        F.lit(check.name).alias("name"),
        F.lit(check.table or OTHER_GROUP).alias("table_name"),
        classify(
            F.col("refusal_kind"), F.col("mismatched"), F.col("only_source"), F.col("only_target")
        ).alias("status"),
        "matched",
        "mismatched",
        "only_source",
        "only_target",
        "compared_rows",
        "source_rows",
        "target_rows",
        "refusal_kind",
        F.coalesce(F.col("refusal_message"), F.lit(None).cast("string")).alias("error"),
        F.when(only, F.col("metrics")).otherwise(F.array().cast(METRIC)).alias("metrics"),
        F.lit(None).cast("bigint").alias("duration_ms"),
        F.lit(None).cast("timestamp").alias("ran_at"),
    )


def suite_frame(checks: Sequence[Check]) -> DataFrame:
    """All enabled checks as one lazy DataFrame, one row per check."""
    frames = [outcome(c) for c in checks if c.enabled]
    if not frames:
        raise ValueError("no enabled checks")
    return reduce(DataFrame.unionByName, frames)


def run_suite(spark: SparkSession, checks: Sequence[Check], parallel: int = 4) -> DataFrame:
    """Run each enabled check as its own job and return one row per check.

    The jobs overlap, so a small check does not wait for a large one. A check that fails to build or
    to run is inconclusive with its error; a timeout is tried once more. Only one row per check
    comes to the driver.
    """
    active = [c for c in checks if c.enabled]

    def attempt(check: Check):
        return outcome(check).first().asDict(recursive=True)

    def run(check: Check):
        ran_at, begun = datetime.now(timezone.utc), time.monotonic()
        try:
            try:
                row = attempt(check)
            except Exception as problem:  # noqa: BLE001 - any failure is this check's outcome
                if "timeout" not in str(problem).lower() and "timed out" not in str(problem).lower():
                    raise
                row = attempt(check)
        except Exception as problem:  # noqa: BLE001
            row = {
                "check_id": check.check_id,
                "name": check.name,
                "table_name": check.table or OTHER_GROUP,
                "status": "inconclusive",
                "error": str(problem).split("\n")[0],
                "metrics": [],
            }
        row["ran_at"] = ran_at
        row["duration_ms"] = int((time.monotonic() - begun) * 1000)
        return row

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        rows = list(pool.map(run, active))
    return spark.createDataFrame(rows, OUTCOME)


def suite_summary(runs: DataFrame) -> DataFrame:
    """Counts of each outcome and one line of verdict. Only a suite where every check ran and agreed is clear."""
    counts = runs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "inconclusive").alias("inconclusive"),
    )
    parts = F.concat_ws(
        " · ",
        F.format_string("%d passed", "passed"),
        F.when(F.col("failed") > 0, F.format_string("%d failed", "failed")),
        F.when(F.col("inconclusive") > 0, F.format_string("%d could not run", "inconclusive")),
    )
    clear = F.concat(
        F.format_string("All clear — %d check", "total"), F.when(F.col("total") == 1, "").otherwise("s"), F.lit(" passed.")
    )
    verdict = (
        F.when(F.col("total") == 0, "No checks to run.")
        .when((F.col("failed") == 0) & (F.col("inconclusive") == 0), clear)
        .otherwise(parts)
    )
    return counts.withColumn("verdict", verdict)


def by_table(runs: DataFrame) -> DataFrame:
    """Outcomes per table; checks that name no table share one group."""
    return runs.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "inconclusive").alias("inconclusive"),
    )


def evidence(runs: DataFrame) -> DataFrame:
    """One row per quoted metric, or one per check where nothing could be quoted, with readable texts."""
    word = (
        F.when(F.col("status") == "pass", "Passed").when(F.col("status") == "fail", "Failed").otherwise("Could not run")
    )
    flat = runs.select("*", F.explode_outer("metrics").alias("m"))
    number = lambda text, exact: F.when(exact.isNotNull(), shown_number(exact)).otherwise(F.coalesce(text, F.lit("(blank)")))
    has = F.col("m").isNotNull()
    label = F.regexp_replace(F.col("m.metric"), r"^\[|\]$", "")
    finding = F.concat_ws(
        " · ",
        F.when(F.col("mismatched") > 0, F.concat(shown_number(F.col("mismatched")), F.lit(" mismatched"))),
        F.when(F.col("only_source") > 0, F.concat(shown_number(F.col("only_source")), F.lit(" only in source"))),
        F.when(F.col("only_target") > 0, F.concat(shown_number(F.col("only_target")), F.lit(" only in target"))),
    )
    source, target = number(F.col("m.source"), F.col("m.source_num")), number(F.col("m.target"), F.col("m.target_num"))
    quote = F.when(source == target, F.concat_ws(" ", label, source)).otherwise(
        F.concat(label, F.lit(": source "), source, F.lit(", target "), target)
    )
    detail = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(has, quote)
        .when(F.col("status") == "pass", F.concat(shown_number(F.col("matched")), F.lit(" keys compared, all agree")))
        .otherwise(finding)
    )
    prefix = F.concat(F.col("table_name"), F.lit(" — "))
    short = F.when(F.startswith(F.col("name"), prefix), F.expr("substring(name, length(table_name) + 4)")).otherwise(F.col("name"))
    return flat.select(
        F.col("table_name").alias("table"),
        short.alias("check"),
        word.alias("status"),
        F.when(has, label).otherwise("").alias("metric"),
        F.when(has, source).otherwise("").alias("source_value"),
        F.when(has, target).otherwise("").alias("target_value"),
        F.when(has, shown_delta(F.col("m.delta"))).otherwise("").alias("difference"),
        detail.alias("detail"),
        "source_rows",
        "target_rows",
        "duration_ms",
        "ran_at",
    )


def latest_runs(runs: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """A log in which running the same thing again replaces its earlier entry.

    The newest row per key is an aggregate (one partial row per key and task), not a window sort.
    """
    newest = runs.groupBy(*[quoted(k).alias(f"g{i}") for i, k in enumerate(keys)]).agg(
        F.max_by(F.struct(*[quoted(c) for c in runs.columns]), F.struct(quoted(at), *[quoted(c) for c in _orderable(runs)])).alias("r")
    )
    return newest.select("r.*")


def _orderable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]


def freshness(reads: DataFrame, refreshes: DataFrame, key: str, read_at: str, refreshed_at: str) -> DataFrame:
    """Age of the target's latest refresh at the time the source was read, in seconds."""
    latest = refreshes.groupBy(quoted(key)).agg(F.max(quoted(refreshed_at)).alias("refreshed_at"))
    read = reads.groupBy(quoted(key)).agg(F.max(quoted(read_at)).alias("read_at"))
    age = F.unix_seconds(F.col("read_at").cast("timestamp")) - F.unix_seconds(F.col("refreshed_at").cast("timestamp"))
    return read.join(latest, key, "left").select(key, "read_at", "refreshed_at", age.alias("age_seconds"))


