"""Measures over a star schema: row sources, filters, lookups, grouping.

A measure is an aggregate expression, so any number of them shares one pass. Filters become part of
the aggregate (``sum(when(filter, x))``); without groups, rows that no measure takes are not read at all.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.functions.dates import MISSING, bucket_label
from tieout.functions.normalize import is_float, is_number
from tieout.functions.numbers import SUM_TYPE, addable
from tieout.model import Measure, Model, quoted, Rel

BLANK = "(blank)"


def predicate(column: Column, op: str, value) -> Column:
    """A comparison that a missing cell never passes. Text is compared without regard to case."""
    if isinstance(value, str):
        left, right = F.lower(column.cast("string")), F.lit(value.lower())
    else:
        left, right = column, F.lit(value)
    tests: dict[str, Callable[[], Column]] = {
        "=": lambda: left == right,
        "<>": lambda: left != right,
        ">": lambda: left > right,
        "<": lambda: left < right,
        ">=": lambda: left >= right,
        "<=": lambda: left <= right,
    }
    if op not in tests:
        raise ValueError(f"unknown comparison {op!r}")
    return tests[op]()


def aggregate(m: Measure) -> Column:
    """The Spark aggregate of one measure. Blanks are ignored; sums are exact."""
    value = m.input
    if m.kind == "sum":
        return F.sum(addable(value)).cast(SUM_TYPE)
    if m.kind == "avg":
        return F.try_divide(F.sum(addable(value)).cast("double"), F.count(addable(value)).cast("double"))
    if m.kind in ("count", "count_rows"):
        return F.count(value)
    if m.kind == "distinct":
        return F.count_distinct(value)
    if m.kind == "min":
        return F.min(value)
    if m.kind == "max":
        return F.max(value)
    raise ValueError(f"unknown measure kind {m.kind!r}")


def evaluate(
    df: DataFrame,
    measures: Sequence[Measure],
    by: Sequence[str | Column] = (),
    where: Column | None = None,
    derived: Mapping[str, Callable[[Mapping[str, Column]], Column]] | None = None,
) -> DataFrame:
    """Several measures over the same groups in one aggregate.

    ``derived`` measures are built from named ones, in the order given; each function receives the
    columns computed so far, so a ratio is always recomputed from its parts.
    """
    rows = df if where is None else df.where(where)
    if not by and measures and all(m.where for m in measures):
        # Rows that no measure takes need not be read. With groups they would be: a group may be empty.
        rows = rows.where(reduce(or_, [reduce(and_, m.where) for m in measures]))
    keys = [quoted(b) if isinstance(b, str) else b for b in by]
    out = rows.groupBy(*keys).agg(*[aggregate(m).alias(m.name) for m in measures])
    for name, formula in (derived or {}).items():
        out = out.withColumn(name, formula({c: quoted(c) for c in out.columns}))
    return out


def lookup(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str, columns: Sequence[str], default: str | None = None) -> DataFrame:
    """Many-to-one lookup: dimension columns for each fact row, which keeps its place without a match.

    The dimension key must be unique (``checks.duplicate_keys`` tells). Spark broadcasts the
    dimension when its measured size allows, and otherwise sorts and merges with skew handling.
    """
    picked = dim.select(quoted(dim_key).alias("__pk"), *[quoted(c) for c in columns])
    joined = fact.join(picked, quoted(fact_key) == F.col("__pk"), "left").drop("__pk")
    if default is not None:
        for c in columns:
            joined = joined.withColumn(c, F.coalesce(quoted(c).cast("string"), F.lit(default)))
    return joined


def star(model: Model, fact: str, path: Sequence[Rel | str], default: str | None = None, columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """A fact widened by its dimensions, following relationships in order.

    A step is a table name, reached over the active relationship from the fact, or a ``Rel``, which
    may start at a dimension already joined or be an inactive one (a second date, for example).
    """
    out = model.tables[fact]
    for step in path:
        rel = model.active(fact, step) if isinstance(step, str) else step
        dim = model.tables[rel.to_table]
        wanted = (columns or {}).get(rel.to_table) or [c for c in dim.columns if c != rel.to_col]
        out = lookup(out, rel.from_col, dim, rel.to_col, wanted, default)
    return out


def inner_star(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Fact rows that have a dimension row, with its columns."""
    return fact.join(dim, quoted(fact_key) == quoted(dim_key), "inner")


def sort_points(points: DataFrame, sort: str, top_n: int | None) -> DataFrame:
    """Largest value first or label order, then the first ``top_n``; ties are settled by label."""
    order = [F.col("value").desc_nulls_last(), F.col("label")] if sort == "valueDesc" else [F.col("label")]
    ordered = points.orderBy(*order)
    return ordered if top_n is None else ordered.limit(top_n)


def group_measure(
    fact: DataFrame,
    measure: Measure,
    category: Column | None = None,
    bucket: str | None = None,
    sort: str | None = None,
    top_n: int | None = None,
) -> DataFrame:
    """A measure by a category of the fact: ``label, value``. No category gives one ``Total`` row."""
    label = F.lit("Total") if category is None else bucket_label(category, bucket)
    points = fact.groupBy(label.alias("label")).agg(aggregate(measure).alias("value"))
    return sort_points(points, sort or ("labelAsc" if bucket else "valueDesc"), top_n)


def group_by_dimension(
    fact: DataFrame,
    fact_key: str,
    dim: DataFrame,
    dim_key: str,
    attribute: Column,
    measure: Measure,
    bucket: str | None = None,
    sort: str | None = None,
    top_n: int | None = None,
    missing: str = MISSING,
) -> DataFrame:
    """A measure by an attribute of a dimension: ``label, value``.

    The fact is first reduced to one row per key (per key and value for a distinct count), and only
    then joined and reduced again. The join moves key-set-sized data, and a key with a third of all
    rows is a single row by then. Rows without a dimension row are kept under ``missing``.
    """
    labels = dim.select(quoted(dim_key).alias("__pk"), bucket_label(attribute, bucket).alias("label"))
    key = quoted(fact_key).alias("__fk")
    value = measure.input
    if measure.kind == "distinct":
        part = fact.select(key, value.alias("__v")).distinct()
        final = F.count_distinct("__v")
    elif measure.kind in ("count", "count_rows"):
        part = fact.groupBy(key).agg(F.count(value).alias("__v"))
        final = F.sum("__v")
    elif measure.kind == "sum":
        part = fact.groupBy(key).agg(F.sum(addable(value)).cast(SUM_TYPE).alias("__v"))
        final = F.sum("__v").cast(SUM_TYPE)
    elif measure.kind == "avg":
        part = fact.groupBy(key).agg(F.sum(addable(value)).alias("__v"), F.count(addable(value)).alias("__n"))
        final = F.try_divide(F.sum("__v").cast("double"), F.sum("__n").cast("double"))
    else:
        extreme = F.min if measure.kind == "min" else F.max
        part = fact.groupBy(key).agg(extreme(value).alias("__v"))
        final = extreme("__v")
    joined = part.join(labels, F.col("__fk") == F.col("__pk"), "left")
    points = joined.groupBy(F.coalesce("label", F.lit(missing)).alias("label")).agg(final.alias("value"))
    return sort_points(points, sort or ("labelAsc" if bucket else "valueDesc"), top_n)


def selected_value(df: DataFrame, column: str, by: Sequence[str] = (), alternate=None) -> DataFrame:
    """The one value of a column in each group, or ``alternate`` where there are several or a blank.

    Groups and values are made distinct first, so only different values of a group are compared.
    """
    dtype = df.schema[column].dataType
    different = df.select(*[quoted(b) for b in by], quoted(column).alias("__v")).distinct()
    picked = F.when(F.count(F.lit(1)) == 1, F.coalesce(F.min("__v"), F.lit(alternate).cast(dtype))).otherwise(F.lit(alternate).cast(dtype))
    return different.groupBy(*[quoted(b) for b in by]).agg(picked.alias("selected"))


def distinct_rows(df: DataFrame, columns: Sequence[str], keep_filters: Column | None = None) -> DataFrame:
    """The distinct combinations of some columns, under a filter or over the whole table."""
    rows = df if keep_filters is None else df.where(keep_filters)
    return rows.select(*[quoted(c) for c in columns]).distinct()


def slicer_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct present values of a column in order."""
    return df.select(quoted(column).alias("value")).where("value is not null").distinct().orderBy("value")


def filter_rows(df: DataFrame, *predicates: Column) -> DataFrame:
    for p in predicates:
        df = df.where(p)
    return df


def text_join(*parts: Column) -> Column:
    """Text concatenation in which a blank is empty text."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def switch(selector: Column | None, cases: Sequence[tuple], otherwise=None) -> Column:
    """The first case that holds: values against a selector, or conditions when there is none."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    result = None
    for test, value in cases:
        condition = lit(test) if selector is None else selector == lit(test)
        result = F.when(condition, lit(value)) if result is None else result.when(condition, lit(value))
    return lit(otherwise) if result is None else result.otherwise(lit(otherwise))


def truthy(column: Column, dtype: T.DataType) -> Column:
    """A bare value as a condition: anything but zero, empty text and blank."""
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(column, F.lit(False))
    if is_number(dtype):
        test = column != 0
        return F.coalesce(test & ~F.isnan(column) if is_float(dtype) else test, F.lit(False))
    return F.coalesce(column.cast("string") != "", F.lit(False))
