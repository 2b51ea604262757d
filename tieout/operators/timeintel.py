"""Time intelligence over any measure.

Facts are reduced to one row per group and day (or longer period) first. Everything after that works
on those rows: windows run per group, or over the days alone when there are no groups, so the size of
a window is bounded by the calendar and not by the facts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions.dates import MONTHS_IN, period_index, period_start
from tieout.functions.numbers import SUM_TYPE, addable, safe_divide
from tieout.model import Measure, quoted
from tieout.operators.measures import aggregate

# The kinds of a measure suite, and those that make sense over any measure.
SUITE_KINDS = [
    "total", "average", "ytd", "qtd", "mtd", "prior-year", "yoy-pct", "mom-pct", "moving-avg", "running",
    "pct-total", "rank",
]
MEASURE_SUITE_KINDS = ["ytd", "qtd", "mtd", "prior-year", "yoy-pct", "mom-pct", "moving-avg", "running"]


def totals(fact: DataFrame, date: str, value: Column, axis: str = "day", by: Sequence[str] = ()) -> DataFrame:
    """Exact totals per group and period: ``by…, period, value``."""
    return fact.where(quoted(date).isNotNull()).groupBy(
        *[quoted(b) for b in by], period_start(quoted(date), axis).alias("period")
    ).agg(F.sum(addable(value)).cast(SUM_TYPE).alias("value"))


def measures_by_period(
    fact: DataFrame,
    date: str,
    measures: Sequence[Measure],
    axis: str,
    by: Sequence[str] = (),
    derived: Mapping[str, Callable[[Mapping[str, Column]], Column]] | None = None,
) -> DataFrame:
    """Any measures per group and period, with ratios built from their parts in each period."""
    out = (
        fact.where(quoted(date).isNotNull())
        .groupBy(*[quoted(b) for b in by], period_start(quoted(date), axis).alias("period"))
        .agg(*[aggregate(m).alias(m.name) for m in measures])
    )
    for name, formula in (derived or {}).items():
        out = out.withColumn(name, formula({c: quoted(c) for c in out.columns}))
    return out


def _window(by: Sequence[str], *more: Column):
    return Window.partitionBy(*[quoted(b) for b in by], *more)


def to_date(periods: DataFrame, unit: str, by: Sequence[str] = (), value: str = "value", name: str | None = None) -> DataFrame:
    """Year-, quarter- or month-to-date at each period."""
    w = _window(by, F.trunc("period", unit)).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return periods.withColumn(name or f"{unit}_to_date", F.sum(quoted(value)).over(w))


def over_parts(
    periods: DataFrame,
    parts: Sequence[str],
    step: Callable[[DataFrame, str], DataFrame],
    formula: Callable[[Mapping[str, Column]], Column],
    name: str,
) -> DataFrame:
    """A derived measure under a time shift: ``step`` is applied to each part, then the formula.

    The year-to-date of a ratio is the ratio of the year-to-dates, never a sum or mean of ratios.
    ``step(df, part)`` must add the shifted part as ``<part>_shifted``.
    """
    out = periods
    for part in parts:
        out = step(out, part)
    shifted = {part: quoted(f"{part}_shifted") for part in parts}
    return out.withColumn(name, formula(shifted)).drop(*[f"{part}_shifted" for part in parts])


def running_total(periods: DataFrame, by: Sequence[str] = (), value: str = "value", name: str = "running") -> DataFrame:
    w = _window(by).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return periods.withColumn(name, F.sum(quoted(value)).over(w))


def prior(
    periods: DataFrame, axis: str, unit: str, by: Sequence[str] = (), value: str = "value", name: str = "prior", n: int = 1
) -> DataFrame:
    """The value of the same period ``n`` units earlier on the calendar; NULL where there is none.

    Months, quarters and years are numbered, and a range frame reads exactly one number, so a gap
    stays a gap and no join is needed. A day is moved by whole months with the end of the month
    clamped, which can send several days to one; there the shifted date is looked up.
    """
    if axis != "day":
        step = MONTHS_IN[unit] * n // MONTHS_IN[axis]
        if step * MONTHS_IN[axis] != MONTHS_IN[unit] * n:
            raise ValueError(f"a {axis} axis cannot move by {n} {unit}")
        w = _window(by).orderBy(period_index(F.col("period"), axis)).rangeBetween(-step, -step)
        return periods.withColumn(name, F.max(quoted(value)).over(w))
    moved = periods.withColumn("__then", F.add_months("period", -MONTHS_IN[unit] * n))
    earlier = periods.select(
        *[quoted(b).alias(f"__b{i}") for i, b in enumerate(by)], F.col("period").alias("__then_at"), quoted(value).alias(name)
    )
    match = F.col("__then") == F.col("__then_at")
    for i, b in enumerate(by):
        match = match & quoted(b).eqNullSafe(F.col(f"__b{i}"))
    return moved.join(earlier, match, "left").drop("__then", "__then_at", *[f"__b{i}" for i in range(len(by))])


def growth(current: Column, before: Column) -> Column:
    """Change relative to the earlier value; NULL when that is zero or missing."""
    return safe_divide(current - before, before)


def period_growth(
    periods: DataFrame, axis: str, unit: str, by: Sequence[str] = (), value: str = "value", name: str = "growth", ratio: bool = False
) -> DataFrame:
    """Growth against the prior period; a ratio changes in points instead of percent."""
    before = prior(periods, axis, unit, by, value, "__before")
    now, then = quoted(value), F.col("__before")
    change = (now.cast("double") - then.cast("double")) if ratio else growth(now, then)
    # The current value counts as zero when it is blank, as long as there is something to compare it with.
    return before.withColumn(name, change).withColumnRenamed("__before", f"prior_{unit}")


@dataclass(frozen=True)
class Span:
    """A trailing window of ``n`` days, weeks, months, quarters or years."""

    n: int
    unit: str

    @property
    def days(self) -> int | None:
        return {"day": self.n, "week": 7 * self.n}.get(self.unit)

    def back(self, day: Column, times: int = 1) -> Column:
        """The day one span earlier, moved once per time so that month ends clamp at each step."""
        for _ in range(times):
            day = F.date_sub(day, self.days) if self.days else F.add_months(day, -self.n * MONTHS_IN[self.unit])
        return day


def _cumulative_at(periods: DataFrame, by: Sequence[str], value: str, probes: Mapping[str, Column]) -> DataFrame:
    """Cumulative total and number of dates with data up to and including each probe date.

    Probe dates are stacked with the data and one ordered pass per group carries the running sums
    over to them. This replaces a range join: work is linear in the days whatever the window length.
    """
    keys = [quoted(b) for b in by]
    points = F.array(
        F.struct(F.col("period").alias("at"), F.lit(0).alias("probe"), quoted(value).alias("v"), F.lit(1).alias("c")),
        *[
            F.struct(
                probe.alias("at"), F.lit(i + 1).alias("probe"), F.lit(None).cast(SUM_TYPE).alias("v"), F.lit(0).alias("c")
            )
            for i, probe in enumerate(probes.values())
        ],
    )
    stacked = periods.select(*keys, "period", F.explode(points).alias("p")).select(*keys, "period", "p.*")
    # The frame is a range over dates, so a probe sees the data of its own date whatever the row order.
    w = _window(by).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    run = stacked.withColumn("cv", F.coalesce(F.sum("v").over(w), F.lit(0).cast(SUM_TYPE))).withColumn("cc", F.sum("c").over(w))
    here = lambda i, c: F.max(F.when(F.col("probe") == i, F.col(c)))
    return run.groupBy(*keys, "period").agg(
        F.max(F.when(F.col("probe") == 0, F.col("v"))).alias(value),
        here(0, "cv").alias("sum_now"),
        here(0, "cc").alias("days_now"),
        *[here(i + 1, "cv").alias(f"sum_{p}") for i, p in enumerate(probes)],
        *[here(i + 1, "cc").alias(f"days_{p}") for i, p in enumerate(probes)],
    )


def rolling(daily: DataFrame, span: Span, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Trailing window ending at each date with data, the window before it, and the growth.

    The window before is the trailing window of the date one span earlier.
    """
    if span.days:
        order = _window(by).orderBy(F.unix_date("period"))
        n = span.days
        out = daily.withColumn("rolling", F.sum(quoted(value)).over(order.rangeBetween(-(n - 1), 0))).withColumn(
            "rolling_prior", F.sum(quoted(value)).over(order.rangeBetween(-(2 * n - 1), -n))
        )
    else:
        day = F.col("period")
        at = _cumulative_at(daily, by, value, {"start": span.back(day), "earlier": span.back(day, 2)})
        some = F.col("days_start") > F.col("days_earlier")
        out = at.select(
            *[quoted(b) for b in by],
            "period",
            value,
            (F.col("sum_now") - F.col("sum_start")).cast(SUM_TYPE).alias("rolling"),
            F.when(some, (F.col("sum_start") - F.col("sum_earlier")).cast(SUM_TYPE)).alias("rolling_prior"),
        )
    return out.withColumn("rolling_growth", growth(F.col("rolling"), F.col("rolling_prior")))


def moving_average(daily: DataFrame, span: Span, by: Sequence[str] = (), value: str = "value", name: str = "moving_avg") -> DataFrame:
    """Mean of the daily totals over the dates with data in the trailing window."""
    if span.days:
        w = _window(by).orderBy(F.unix_date("period")).rangeBetween(-(span.days - 1), 0)
        return daily.withColumn(
            name, safe_divide(F.sum(quoted(value)).over(w), F.count(quoted(value)).over(w))
        )
    at = _cumulative_at(daily, by, value, {"start": span.back(F.col("period"))})
    return at.select(
        *[quoted(b) for b in by],
        "period",
        value,
        safe_divide(F.col("sum_now") - F.col("sum_start"), F.col("days_now") - F.col("days_start")).alias(name),
    )


def balances(daily: DataFrame, axis: str, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Opening and closing balance: the totals of the first and the last date with data in each period."""
    present = daily.where(quoted(value).isNotNull())
    return present.groupBy(*[quoted(b) for b in by], period_start(F.col("period"), axis).alias("period")).agg(
        F.min_by(quoted(value), "period").alias("opening"), F.max_by(quoted(value), "period").alias("closing")
    )


def cumulative_distinct(fact: DataFrame, date: str, entity: str, axis: str = "day") -> DataFrame:
    """Distinct entities seen from the beginning up to each period with data, and the new ones in it.

    An entity counts once, on its first date; the running sum is over periods only.
    """
    seen = fact.where(quoted(date).isNotNull())
    firsts = (
        seen.where(quoted(entity).isNotNull())
        .groupBy(quoted(entity))
        .agg(F.min(quoted(date)).alias("first"))
        .groupBy(period_start(F.col("first"), axis).alias("period"))
        .agg(F.count(F.lit(1)).alias("new_entities"))
    )
    periods = seen.select(period_start(quoted(date), axis).alias("period")).distinct()
    w = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    filled = periods.join(firsts, "period", "left").withColumn("new_entities", F.coalesce("new_entities", F.lit(0)))
    return filled.withColumn("cumulative_entities", F.sum("new_entities").over(w))


def activity_changes(fact: DataFrame, date: str, entity: str, axis: str, unit: str | None = None) -> DataFrame:
    """Churned and retained entities per period against the period one ``unit`` earlier.

    Each fact row marks its own period as active and the later one as preceded; one grouping by
    entity and period then knows both. Duplicate rows combine before the shuffle, so nothing
    gathers per entity.
    """
    step = MONTHS_IN[unit or axis]
    if axis == "day":
        raise ValueError("churn needs a month, quarter or year axis")
    period = period_start(quoted(date), axis)
    marks = F.array(
        F.struct(period.alias("period"), F.lit(1).alias("now"), F.lit(0).alias("before")),
        F.struct(F.add_months(period, step).alias("period"), F.lit(0).alias("now"), F.lit(1).alias("before")),
    )
    present = fact.where(quoted(date).isNotNull() & quoted(entity).isNotNull())
    marked = present.select(quoted(entity).alias("entity"), F.explode(marks).alias("m")).select("entity", "m.*")
    states = marked.groupBy("entity", "period").agg(F.max("now").alias("now"), F.max("before").alias("before"))
    counted = states.groupBy("period").agg(
        F.sum("now").alias("active"),
        F.sum("before").alias("prior_active"),
        F.count_if((F.col("before") == 1) & (F.col("now") == 0)).alias("churned"),
        F.count_if((F.col("before") == 1) & (F.col("now") == 1)).alias("retained"),
    )
    return (
        counted.where("active > 0")
        .withColumn("churn_rate", safe_divide(F.col("churned"), F.col("prior_active")))
        .withColumn("retention_rate", safe_divide(F.col("retained"), F.col("prior_active")))
    )


def new_entities(fact: DataFrame, date: str, entity: str, axis: str) -> DataFrame:
    """Entities active in a period and never before."""
    return cumulative_distinct(fact, date, entity, axis).select("period", "new_entities")


def measure_suite(daily: DataFrame, by: Sequence[str] = (), kinds: Sequence[str] = tuple(MEASURE_SUITE_KINDS), value: str = "value") -> DataFrame:
    """The time-intelligence family of one additive measure, month by month.

    ``daily`` has the daily totals. Month values are those of the month's last date with data, as a
    month on an axis shows them.
    """
    unknown = set(kinds) - set(MEASURE_SUITE_KINDS)
    if unknown:
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    month = F.trunc("period", "month")
    keys = [quoted(b) for b in by]
    monthly = daily.groupBy(*keys, month.alias("month")).agg(
        F.sum(quoted(value)).cast(SUM_TYPE).alias("value"),
        F.count(quoted(value)).alias("days"),
        F.max("period").alias("last_day"),
    )
    named = monthly.withColumnRenamed("month", "period")
    out = named
    steps = {
        "ytd": lambda d: to_date(d, "year", by, name="ytd"),
        "qtd": lambda d: to_date(d, "quarter", by, name="qtd"),
        "mtd": lambda d: d.withColumn("mtd", F.col("value")),
        "running": lambda d: running_total(d, by, name="running"),
        "prior-year": lambda d: prior(d, "month", "year", by, name="prior_year"),
        "yoy-pct": lambda d: prior(d, "month", "year", by, name="__py").withColumn("yoy_pct", growth(F.col("value"), F.col("__py"))).drop("__py"),
        "mom-pct": lambda d: prior(d, "month", "month", by, name="__pm").withColumn("mom_pct", growth(F.col("value"), F.col("__pm"))).drop("__pm"),
    }
    for kind in kinds:
        if kind in steps:
            out = steps[kind](out)
    if "moving-avg" in kinds:
        average = moving_average(daily, Span(3, "month"), by, value)
        match = F.col("last_day") == F.col("__day")
        for i, b in enumerate(by):
            match = match & quoted(b).eqNullSafe(F.col(f"__b{i}"))
        picked = average.select(
            *[quoted(b).alias(f"__b{i}") for i, b in enumerate(by)], F.col("period").alias("__day"), "moving_avg"
        )
        out = out.join(picked, match, "left").drop("__day", *[f"__b{i}" for i in range(len(by))])
    return out.drop("days", "last_day")


def field_suite(fact: DataFrame, date: str, value: Column, by: Sequence[str], kinds: Sequence[str] = tuple(SUITE_KINDS)) -> DataFrame:
    """All kinds for one numeric field, by group and month: the time family, total, average, share and rank.

    Share and rank are taken among the groups of a month.
    """
    daily = (
        fact.where(quoted(date).isNotNull())
        .groupBy(*[quoted(b) for b in by], quoted(date).cast("date").alias("period"))
        .agg(F.sum(addable(value)).cast(SUM_TYPE).alias("value"), F.count(addable(value)).alias("rows"))
    )
    out = measure_suite(daily, by, [k for k in kinds if k in MEASURE_SUITE_KINDS])
    if "average" in kinds:
        rows = daily.groupBy(*[quoted(b) for b in by], F.trunc("period", "month").alias("period")).agg(F.sum("rows").alias("__rows"))
        out = out.join(rows, [*by, "period"], "left").withColumn("average", safe_divide(F.col("value"), F.col("__rows"))).drop("__rows")
    month = Window.partitionBy("period")
    if "pct-total" in kinds:
        out = out.withColumn("pct_total", safe_divide(F.col("value"), F.sum("value").over(month)))
    if "rank" in kinds:
        out = out.withColumn("rank", F.dense_rank().over(month.orderBy(F.col("value").desc())))
    return out.withColumnRenamed("value", "total") if "total" in kinds else out.drop("value")
