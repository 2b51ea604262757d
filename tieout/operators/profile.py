"""Type inference, column profiles, distributions and a storage profile.

One grouping of the columns turned into (column, value) rows gives everything exact: counts, extremes,
means, distinct values, frequencies and bytes. Equal values combine before the shuffle, so a value that
fills a third of a column is one row per task. Discovery needs less: mergeable sketches from one scan
say which columns have to be counted at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.functions.celltypes import KINDS, coerce, column_kind, is_blank, trimmed_kind
from tieout.functions.normalize import is_float, is_number, is_temporal
from tieout.functions.numbers import number_text, safe_divide, trimmed, uniqueness
from tieout.model import quoted
from tieout.session import settled

# Sizes of the distributions, and the name patterns that suggest a role.
BINS = 10
TOP_VALUES = 8
SAMPLES = 5
#: Sketches of distinct values have 2 to the power of so many registers; intervals are so many standard errors wide.
SKETCH_BITS, SKETCH_ERRORS = 12, 6
KEY_HINTS = r"(?i)(^id$|_id$|\bid\b|key|code|number|no\.)"
MEASURE_HINTS = (
    r"(?i)(revenue|sales|amount|price|cost|total|qty|quantity|profit|margin|discount|tax|balance|value|count|units?)"
)


def infer_types(df: DataFrame) -> DataFrame:
    """The kind of every column: ``column, position, <kind counts>, data_type``.

    The text columns become (column, text) rows, so the pattern tests exist once in the generated code
    however wide the table is. Kinds are counted per task before the shuffle of a few rows per column.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    other = [f for f in df.schema.fields if f.name not in text]
    parts = []
    if text:
        cells = df.select(*[quoted(c) for c in text]).unpivot([], [quoted(c) for c in text], "column", "cell")
        cells = cells.select("column", trimmed(F.col("cell")).alias("cell"))
        parts.append(cells.select("column", trimmed_kind(F.col("cell")).alias("kind")))
    if other:
        kinds = df.select(*[_kind(quoted(f.name), f.dataType).alias(f.name) for f in other])
        parts.append(kinds.unpivot([], [quoted(f.name) for f in other], "column", "kind"))
    counted = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("column")
        .agg(*[F.count_if(F.col("kind") == kind).alias(kind) for kind in KINDS])
    )
    place = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column")) - 1
    found = counted.select("column", place.cast("int").alias("position"), *KINDS)
    return found.withColumn("data_type", column_kind({kind: F.col(kind) for kind in KINDS}))


def _kind(value: Column, dtype: T.DataType) -> Column:
    """The kind of a cell that has a type already."""
    kind = F.lit(kind_of(dtype))
    if is_float(dtype) or isinstance(dtype, T.DecimalType):
        kind = F.when(value == F.floor(value), "integer").otherwise("decimal")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        kind = F.when(value == value.cast("date").cast(dtype), "date").otherwise("dateTime")
    return F.when(value.isNotNull(), kind)


def coerce_columns(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Text columns turned into the given kinds; other columns stay as they are."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[coerce(quoted(c), kinds[c]).alias(c) if c in text and c in kinds else quoted(c) for c in df.columns]
    )


def typed(df: DataFrame) -> DataFrame:
    """Infer the kinds of text columns and apply them. One small row per column comes to the driver."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    kinds = {r["column"]: r["data_type"] for r in infer_types(df.select(*[quoted(c) for c in text])).collect()}
    return coerce_columns(df, kinds)


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.NumericType):
        return "decimal"
    if isinstance(dtype, T.DateType):
        return "date"
    return "dateTime" if is_temporal(dtype) else "string"


def value_text(value: Column, dtype: T.DataType) -> Column:
    """The text that identifies a value within its column; blank text is no value."""
    if isinstance(dtype, T.BooleanType):
        return value.cast("string")
    if is_number(dtype):
        return number_text(value, dtype)
    text = value.cast("string")
    return text if is_temporal(dtype) else F.when(~is_blank(text), text)


def _carried(dtype: T.DataType) -> str:
    """The type under which a column's values are counted, so columns of one type share a pass."""
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    return "double" if is_float(dtype) else dtype.simpleString()


def _counted(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> tuple[DataFrame, list[tuple[str, str]], dict[str, T.DataType]]:
    """Every value of the given columns, NULL included, with its frequency: ``at`` and one column for each type.

    One scan of each table makes (column, value) rows, each value in the column of its own type, and one
    grouping counts those of all tables. Also returned: the table and column behind each ``at``, and the
    types of the value columns.
    """
    names = [(table, c) for table, found in columns.items() for c in found]
    carried = {(table, c): _carried(tables[table].schema[c].dataType) for table, c in names}
    slots = {kind: f"v{i}" for i, kind in enumerate(dict.fromkeys(carried.values()))}
    frames, types = [], {}
    for table, found in columns.items():
        if not found:
            continue
        cells = []
        for c in found:
            kind = carried[(table, c)]
            cells.append(F.lit(names.index((table, c))))
            cells += [(quoted(c) if kind == mine else F.lit(None)).cast(mine) for mine in slots]
        frames.append(tables[table].select(F.stack(F.lit(len(found)), *cells).alias("at", *slots.values())))
    stacked = reduce(DataFrame.unionAll, frames)
    types = {slot: stacked.schema[slot].dataType for slot in slots.values()}
    return stacked.groupBy("at", *slots.values()).agg(F.count(F.lit(1)).alias("n")), names, types


def _shown(types: Mapping[str, T.DataType]) -> Column:
    """The text of a value, whichever column it is in; NULL for none and for blank text."""
    return F.coalesce(*[value_text(F.col(slot), dtype) for slot, dtype in types.items()])


def _named(names: Sequence[tuple[str, str]], part: int) -> Column:
    """The table (0) or column (1) behind ``at``."""
    return F.element_at(F.array(*[F.lit(n[part]) for n in names]), F.col("at") + 1)


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every distinct present value of every column with its frequency: ``column, value, n``.

    Values are counted in their own types; only the distinct ones that are left become text.
    """
    counted, names, types = _counted({"": df}, {"": list(columns or df.columns)})
    texts = counted.select("at", _shown(types).alias("value"), "n").where("value is not null")
    return texts.select(_named(names, 1).alias("column"), "value", "n")


def profile(df: DataFrame, table: str = "") -> DataFrame:
    """One row per column: type, role, counts, extremes, mean, and storage bytes."""
    return _profiles({table: df})


def _profiles(tables: Mapping[str, DataFrame]) -> DataFrame:
    counted, names, types = _counted(tables, {name: df.columns for name, df in tables.items()})
    values = counted.select("at", "n", *types, _shown(types).alias("value"))
    size, n, given = F.octet_length("value"), F.col("n"), F.col("value").isNotNull()
    numeric = [F.col(slot).cast("double") for slot, t in types.items() if kind_of(t) in ("integer", "decimal")]
    x = F.coalesce(*numeric) if numeric else F.lit(None).cast("double")
    timed = [slot for slot, t in types.items() if is_temporal(t)]
    other = [F.when(given, F.col(slot).cast("string")) for slot, t in types.items() if kind_of(t) == "string"]
    text = F.coalesce(*other) if other else F.lit(None).cast("string")
    found = values.groupBy("at").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(given, 0).otherwise(n)).alias("null_count"),
        F.count_if(given).alias("distinct_count"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        safe_divide(F.sum(x * n), F.sum(F.when(x.isNotNull(), n))).alias("mean"),
        F.coalesce(F.min(text), *[F.min(slot).cast("string") for slot in timed]).alias("min_text"),
        F.coalesce(F.max(text), *[F.max(slot).cast("string") for slot in timed]).alias("max_text"),
        F.sum(size * n).alias("data_bytes"),
        F.sum(size).cast("bigint").alias("dictionary_bytes"),
    )
    # Tables without rows have no values; their columns come from the schema, one row each.
    kinds = {(name, f.name): kind_of(f.dataType) for name, df in tables.items() for f in df.schema.fields}
    places = [(i, name, c, tables[name].columns.index(c), kinds[(name, c)]) for i, (name, c) in enumerate(names)]
    listed = counted.sparkSession.createDataFrame(places, "at int, table string, column string, position int, data_type string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    out = listed.join(found, "at", "left").select(
        "table", "column", "position", "data_type", zero("rows"), zero("null_count"), zero("distinct_count"),
        "min", "max", "mean", "min_text", "max_text", zero("data_bytes"), zero("dictionary_bytes"),
    )
    return out.withColumn("role", column_role(F.col("column"), F.col("data_type"), F.col("distinct_count"), F.col("rows")))


def profile_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The exact profiles of several tables, from one scan of each and one exchange of their distinct values."""
    return settled(_profiles(tables))


def sketch_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The profiles that discovery needs: ``table, column, position, data_type, rows, null_count, distinct_count,
    exact, role``.

    The first scan of a table counts its rows and blanks and keeps a mergeable sketch of each column's
    distinct values, a few kilobytes whatever the size of the table. A second scan counts exactly (``exact``)
    where a rule needs the number itself, in columns of text, or where the sketch's interval reaches the
    limit of a rule: a column that may be unique, and one that may have as few values as a dimension.
    All other columns keep the estimate, which lies on the same side of every limit as the true count
    (up to ``SKETCH_ERRORS`` standard errors).
    """
    names = [(name, f) for name, df in tables.items() for f in df.schema.fields]
    frames, at = [], 0
    for name, df in tables.items():
        cells = []
        for f in df.schema.fields:
            value = quoted(f.name)
            present = ~is_blank(value) if kind_of(f.dataType) == "string" else value.isNotNull()
            cells += [F.lit(at), F.when(present, F.xxhash64(value))]
            at += 1
        frames.append(df.select(F.stack(F.lit(len(df.columns)), *cells).alias("at", "h")))
    sketched = reduce(DataFrame.unionAll, frames).groupBy("at").agg(
        F.count(F.lit(1)).alias("rows"), F.count("h").alias("present"), F.hll_sketch_estimate(F.hll_sketch_agg("h", SKETCH_BITS)).alias("estimate")
    )
    found = {r["at"]: r for r in sketched.collect()}  # one row per column
    wanted: dict[str, list[str]] = {name: [] for name in tables}
    for i, (name, f) in enumerate(names):
        if i not in found:
            continue
        rows, estimate = found[i]["rows"], found[i]["estimate"] or 0
        low, high = distinct_interval(estimate)
        may_be_key = found[i]["present"] == rows and high >= rows
        if kind_of(f.dataType) in ("string", "boolean") or may_be_key or low <= min(20.0, rows * 0.5) <= high:
            wanted[name].append(f.name)
    exact: dict[tuple[str, str], int] = {}
    if any(wanted.values()):
        counted, listed, types = _counted(tables, wanted)
        present = counted.select("at", _shown(types).isNotNull().alias("present")).groupBy("at").agg(F.count_if("present").alias("n"))
        exact = {listed[r["at"]]: r["n"] for r in present.collect()}
    out = []
    for i, (name, f) in enumerate(names):
        r = found.get(i)
        rows, nulls, estimate = (r["rows"], r["rows"] - r["present"], r["estimate"] or 0) if r else (0, 0, 0)
        sure = exact.get((name, f.name))
        out.append((name, f.name, tables[name].columns.index(f.name), kind_of(f.dataType), rows, nulls, estimate if sure is None else sure, sure is not None or not rows))
    schema = "table string, column string, position int, data_type string, rows bigint, null_count bigint, distinct_count bigint, exact boolean"
    profiles = next(iter(tables.values())).sparkSession.createDataFrame(out, schema)
    return profiles.withColumn("role", column_role(F.col("column"), F.col("data_type"), F.col("distinct_count"), F.col("rows")))


def distinct_interval(estimate: int) -> tuple[float, float]:
    """Between what numbers of distinct values a sketch's estimate lies."""
    slack = SKETCH_ERRORS * 1.04 / 2 ** (SKETCH_BITS / 2)
    return estimate * (1 - slack) - 1, estimate * (1 + slack) + 1


def column_role(name: Column, kind: Column, distinct: Column, rows: Column) -> Column:
    """key, measureCandidate, dimension, date or flag."""
    key = (rows > 0) & (distinct == rows) & name.rlike(KEY_HINTS)
    measured = name.rlike(MEASURE_HINTS) | (distinct > F.least(F.lit(20.0), rows * 0.5))
    return (
        F.when(kind.isin("date", "dateTime"), "date")
        .when(kind == "boolean", "flag")
        .when(key, "key")
        .when(kind.isin("integer", "decimal") & measured, "measureCandidate")
        .otherwise("dimension")
    )


def sample_values(df: DataFrame, n: int = SAMPLES) -> DataFrame:
    """The first few distinct values of every column in text order.

    Spark limits the ranked rows before it shuffles them, so a column of unique values is cut early.
    """
    w = Window.partitionBy("column").orderBy("value")
    return value_counts(df).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).select("column", "nth", "value")


def top_values(df: DataFrame, columns: Sequence[str], top: int = TOP_VALUES) -> DataFrame:
    """The most frequent values of each column, and one row for all the others: ``column, nth, label, count``."""
    counts = value_counts(df, columns)
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    best = counts.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= top)
    whole = counts.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("total"))
    taken = best.groupBy("column").agg(F.sum("n").alias("taken"))
    rest = (
        whole.join(F.broadcast(taken), "column")  # one row per column on each side
        .where(F.col("values") > top)
        .select(
            "column",
            F.lit(top + 1).alias("nth"),
            F.concat(F.lit("+"), (F.col("values") - top).cast("string"), F.lit(" more")).alias("label"),
            (F.col("total") - F.col("taken")).alias("count"),
        )
    )
    return best.select("column", "nth", F.col("value").alias("label"), F.col("n").alias("count")).unionByName(rest)


def histogram(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """Equal-width bins of each numeric column: ``column, bin, low, high, label, count``.

    A column with a single value has one bin. Empty bins are kept.
    """
    numbers = df.select(*[quoted(c).cast("double").alias(c) for c in columns])
    long = numbers.unpivot([], [quoted(c) for c in columns], "column", "x").where("x is not null and not isnan(x)")
    span = long.groupBy("column").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    spans = span.withColumn("width", width)
    at = F.when(F.col("lo") == F.col("hi"), 0).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("width"), F.lit(0.0))))
    )
    # The spans are one row per column.
    counts = (
        long.join(F.broadcast(spans), "column").groupBy("column", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    last = F.when(F.col("lo") == F.col("hi"), 0).otherwise(bins - 1)
    slots = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), last)))
    low = F.col("lo") + F.col("bin") * F.col("width")
    high = F.col("lo") + (F.col("bin") + 1) * F.col("width")
    one = F.col("lo") == F.col("hi")
    return slots.join(F.broadcast(counts), ["column", "bin"], "left").select(
        "column",
        "bin",
        low.alias("low"),
        F.when(one, F.col("hi")).otherwise(high).alias("high"),
        F.when(one, bin_text(low)).otherwise(F.concat(bin_text(low), F.lit("–"), bin_text(high))).alias("label"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
    )


def bin_text(x: Column) -> Column:
    """Large edges as grouped whole numbers, whole ones as they are, others with one decimal."""
    return (
        F.when(F.abs(x) >= 1000, F.format_number(F.floor(x + 0.5), 0))
        .when(x == F.floor(x), x.cast("bigint").cast("string"))
        .otherwise(F.format_string("%.1f", x))
    )


def year_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per calendar year of each date column."""
    years = df.select(*[F.year(quoted(c)).alias(c) for c in columns])
    long = years.unpivot([], [quoted(c) for c in columns], "column", "year").where("year is not null")
    return long.groupBy("column", "year").agg(F.count(F.lit(1)).alias("count"))


def flag_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """True and false rows of each boolean column."""
    long = df.select(*[quoted(c) for c in columns]).unpivot([], [quoted(c) for c in columns], "column", "flag")
    return long.groupBy("column").agg(F.count_if("flag").alias("true_count"), F.count_if(~F.col("flag")).alias("false_count"))


def storage_profile(profiles: DataFrame) -> DataFrame:
    """Bytes, share of the model, and uniqueness of every column, from the profiles of all tables."""
    total = F.col("data_bytes") + F.col("dictionary_bytes")
    sized = profiles.select(
        "table", "column", "data_type", "rows", F.col("distinct_count").alias("cardinality"), "data_bytes", "dictionary_bytes",
        total.alias("total_bytes"),
    )
    model = sized.agg(F.greatest(F.sum("total_bytes"), F.lit(1))).scalar()
    return sized.withColumn("share", safe_divide(F.col("total_bytes"), model)).withColumn(
        "uniqueness", uniqueness(F.col("cardinality"), F.col("rows"))
    )


def storage_by_table(storage: DataFrame) -> DataFrame:
    return storage.groupBy("table").agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.sum("total_bytes").alias("total_bytes")
    )


def storage_summary(storage: DataFrame, top: int = 10) -> DataFrame:
    """Model size, its largest column and table, and the share held by the largest columns."""
    name = F.concat("table", F.lit("["), "column", F.lit("]"))
    best = storage.orderBy(F.col("total_bytes").desc(), "table", "column").limit(top).agg(F.sum("total_bytes")).scalar()
    tables = storage_by_table(storage)
    largest = tables.agg(F.max_by("table", F.struct("total_bytes", "table"))).scalar()
    return storage.agg(
        F.sum("total_bytes").alias("model_bytes"),
        F.count_distinct("table").alias("tables"),
        F.count(F.lit(1)).alias("columns"),
        F.max_by(name, F.struct("total_bytes", "table", "column")).alias("largest_column"),
    ).select(
        "*", largest.alias("largest_table"), safe_divide(best, F.greatest("model_bytes", F.lit(1))).alias("top_share")
    )
