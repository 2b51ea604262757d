"""The date dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.functions.dates import MONTH_NAMES, WEEKDAY_NAMES, fiscal_year, name_of, week_of_year, weekday_number
from tieout.model import quoted


def date_columns(day: Column, fiscal_start: int = 1) -> dict[str, Column]:
    month = F.month(day)
    weekday = weekday_number(day)
    return {
        "Year": F.year(day),
        "Quarter": F.concat(F.lit("Q"), F.quarter(day).cast("string")),
        "MonthNo": month,
        "MonthName": name_of(month, MONTH_NAMES),
        "MonthShort": F.substring(name_of(month, MONTH_NAMES), 1, 3),
        "YearMonth": F.date_format(day, "yyyy-MM"),
        "WeekOfYear": week_of_year(day),
        "Day": F.dayofmonth(day),
        "WeekdayNo": weekday,
        "WeekdayName": name_of(weekday, WEEKDAY_NAMES),
        "IsWeekend": weekday > 5,
        "FiscalYear": fiscal_year(day, fiscal_start),
    }


def date_dimension(
    fact: DataFrame, column: str, columns: Sequence[str] | None = None, fiscal_start: int = 1, whole_years: bool = False
) -> DataFrame:
    """One row per calendar day from the first to the last date of a fact column.

    ``whole_years`` extends the range to full fiscal years.
    """
    day = quoted(column).cast("date")
    low, high = F.min(day), F.max(day)
    if whole_years:
        back = fiscal_start - 1
        start = lambda d: F.add_months(F.trunc(F.add_months(d, -back), "year"), back)
        low, high = start(low), F.date_sub(F.add_months(start(high), 12), 1)
    span = fact.agg(low.alias("low"), high.alias("high"))
    days = span.where("low is not null").select(F.explode(F.sequence("low", "high")).alias("Date"))
    chosen = date_columns(F.col("Date"), fiscal_start)
    return days.select("Date", *[chosen[c].alias(c) for c in (columns or chosen)])
