"""CSV sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.model import quoted
from tieout.operators.datedim import date_dimension
from tieout.plans.suite import evidence

# First characters that a spreadsheet would run as a formula.
FORMULA_START = r"^[=+\-@\t\r]"


def guarded(text: Column) -> Column:
    """Text that no spreadsheet takes for a formula."""
    return F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def csv_ready(df: DataFrame, guard: bool = True) -> DataFrame:
    """Every column as text; text columns are guarded, numbers and dates are not text to begin with."""
    out = []
    for f in df.schema.fields:
        value = quoted(f.name)
        kind = f.dataType.typeName()
        if kind == "string" and guard:
            value = guarded(value)
        elif kind.startswith("timestamp"):
            value = F.substring(value.cast("string"), 1, 19)
        out.append(value.cast("string").alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, guard: bool = True, mode: str = "errorifexists") -> None:
    """A folder of CSV files with headers, written in parallel."""
    (
        csv_ready(df, guard)
        .write.mode(mode)
        .options(header="true", quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
        .csv(path)
    )


def write_evidence(runs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The evidence of a suite run. Amounts are texts here, so all cells are guarded."""
    write_csv(evidence(runs), path, True, mode)


def write_date_dimension(fact: DataFrame, column: str, path: str, mode: str = "errorifexists", **options) -> None:
    write_csv(date_dimension(fact, column, **options), path, False, mode)


def extract_tables(tables: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> dict[str, str]:
    """Every table to a CSV folder of its own, in one folder; returns where each went."""
    written = {}
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}.csv"
        write_csv(df, path, False, mode)
        written[name] = path
    return written
