"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "—"

# Months per period and the calendar names.
MONTHS_IN = {"month": 1, "quarter": 3, "year": 12}
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def bucket_label(value: Column, bucket: str | None = None) -> Column:
    """Text label of a date at year, quarter or month; a missing value has its own label."""
    if bucket is None:
        label = value.cast("string")
    else:
        day = value.cast("date")
        year = F.lpad(F.year(day).cast("string"), 4, "0")
        label = {
            "year": year,
            "quarter": F.concat(year, F.lit("-Q"), F.quarter(day).cast("string")),
            "month": F.substring(day.cast("string"), 1, 7),
        }[bucket]
    return F.coalesce(label, F.lit(MISSING))


def period_start(value: Column, axis: str) -> Column:
    day = value.cast("date")
    return day if axis == "day" else F.trunc(day, axis)


def period_index(day: Column, axis: str) -> Column:
    """A number that grows by one per period, so range frames can address a period exactly."""
    if axis == "day":
        return F.unix_date(day)
    months = F.year(day) * 12 + F.month(day) - 1
    return F.floor(months / F.lit(MONTHS_IN[axis])).cast("int")


def weekday_number(day: Column) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(day) + 1


def week_of_year(day: Column) -> Column:
    """Week number where week 1 holds January 1st and weeks begin on Monday (not the ISO week)."""
    new_year = F.trunc(day, "year")
    return F.floor((F.dayofyear(day) - 1 + F.weekday(new_year)) / F.lit(7)).cast("int") + 1


def name_of(number: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), number)


def fiscal_year(day: Column, first_month: int = 1) -> Column:
    """Fiscal year, labelled by the calendar year it ends in."""
    if first_month == 1:
        return F.year(day)
    return F.year(day) + F.when(F.month(day) >= first_month, 1).otherwise(0)
