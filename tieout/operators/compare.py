"""Comparison of two result sets at a chosen grain.

Both sides are projected to one layout, stacked, and grouped once. Keys that are missing on one
side, repeated or NULL need no special join: a group with no source rows exists only in the target.
The plan has one shuffle, both sides combine before it, and a key that holds a third of all rows
travels as one partial sum per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.functions.cells import EXACT, MULTIPLE, Piece, Tolerance, compare_cell, severity
from tieout.functions.normalize import (
    NULL_TAG,
    Normalize,
    Number,
    comparable_number,
    composite_key,
    display_part,
    finite,
    is_float,
    is_number,
    is_temporal,
    normalize_key,
    spelling_of,
    temporal_text,
    to_second,
    utc,
)
from tieout.functions.numbers import INPUT_TYPE, LIMBS, REST_TYPE, SUM_TYPE, from_limbs, limbs, plain_units, trimmed
from tieout.model import Pair, Side, pairs, quoted, resolve
from tieout.session import checkpointed


RESERVED = ("composite_key", "status", "source_row_count", "target_row_count")
CELL_PARTS = ("source", "target", "source_num", "target_num", "delta", "status")


@dataclass(frozen=True)
class _Key:
    """How one key pair is carried through the shuffle: typed where the types allow, else as text."""

    source: Column
    target: Column
    form: str  # number, time or text

    def tagged(self, name: str, granularity: str) -> Column:
        value = F.col(name)
        if self.form == "text":
            return value
        if self.form == "number":
            body = F.concat(F.lit("d:"), value.cast("string"))
        else:
            body = F.concat(F.lit("t:"), temporal_text(value, granularity))
        return F.coalesce(body, F.lit(NULL_TAG))


def _whole(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.IntegralType, T.BooleanType))


def _whole_value(value: Column, dtype: T.DataType) -> Column:
    return (value.cast("int") if isinstance(dtype, T.BooleanType) else value).cast("bigint")


def _key(source: Column, s_type: T.DataType, target: Column, t_type: T.DataType, opts: Normalize, neat: Column) -> _Key:
    if _whole(s_type) and _whole(t_type):
        return _Key(_whole_value(source, s_type), _whole_value(target, t_type), "number")
    if is_temporal(s_type) and is_temporal(t_type):
        grain = (
            (lambda c: c.cast("date"))
            if opts.granularity == "date"
            else to_second
        )
        return _Key(grain(utc(source, s_type)), grain(utc(target, t_type)), "time")
    return _Key(normalize_key(source, s_type, opts, neat), normalize_key(target, t_type, opts, neat), "text")


def _text_form(s_type: T.DataType, t_type: T.DataType) -> str | None:
    """What a pair must carry besides its sum: nothing, a not-a-number flag, a time, or text."""
    if is_temporal(s_type) and is_temporal(t_type):
        return "time"
    if not all(is_number(t) or isinstance(t, T.NullType) for t in (s_type, t_type)):
        return "text"
    return "flag" if _wide(s_type) or _wide(t_type) else None


def _wide(dtype: T.DataType) -> bool:
    """Whether values of a number type may fit no sum of nine decimals (or, as floats, be no number)."""
    return is_float(dtype) or isinstance(dtype, T.DecimalType) and (dtype.scale > 27 or dtype.precision - dtype.scale > 29)


def _text_value(value: Column, dtype: T.DataType, form: str, opts: Normalize, number: Column, odd: Column, neat: Column) -> Column:
    """The text side of a value, NULL where it is blank or a number. ``number`` is the value as one, ``odd``
    the spelling of a number that fits no sum."""
    if form == "time":
        day = utc(value, dtype)
        return day.cast("date") if opts.granularity == "date" else to_second(day)
    if form == "flag":
        return F.when(value.isNotNull() & number.isNull() & odd.isNull(), 1) if is_float(dtype) else F.lit(None).cast("int")
    spelling = F.concat(F.lit("d:"), odd)
    if is_number(dtype):
        return F.when(odd.isNotNull(), spelling).when(value.isNotNull() & ~finite(value), F.lit(NULL_TAG)) if _wide(dtype) else F.lit(None).cast("string")
    present = value.isNotNull() if is_temporal(dtype) else value.isNotNull() & (value.cast("string") != "")
    return F.when(odd.isNotNull(), spelling).when(present & number.isNull(), normalize_key(value, dtype, opts, neat))


def _piece(prefix: str, i: int, form: str | None, granularity: str, columns) -> Piece:
    part = lambda kind: F.col(f"{prefix}{kind}{i}") if f"{prefix}{kind}{i}" in columns else None
    number = F.col(f"{prefix}n{i}").cast(SUM_TYPE)
    rest, odd = part("r"), part("o")
    rest = None if rest is None else rest.cast(REST_TYPE)
    if form is None:
        return Piece(number, rest=rest)
    low, high = F.col(f"{prefix}lo{i}"), F.col(f"{prefix}hi{i}") if form != "flag" else None
    if form == "flag":
        text = F.when(low == 1, F.lit(NULL_TAG))
        if odd is not None:
            least, most = part("wlo"), part("whi")
            text = text.when(least < most, F.lit(f"d:{MULTIPLE}")).when(least.isNotNull(), F.concat(F.lit("d:"), least.cast("string")))
        return Piece(number, text, F.lit(False), rest, odd)
    several = F.coalesce(low != high, F.lit(False))
    if form == "time":
        return Piece(number, F.concat(F.lit("t:"), temporal_text(low, granularity)), several)
    return Piece(number, low, several, rest, odd)


def _limbs(df: DataFrame, side: str, i: int) -> list[str]:
    """The columns that hold a value's limbs, none where its type has no plain numbers."""
    return [c for c in (f"{side}l{i}_{j}" for j in range(LIMBS)) if c in df.columns]


def _total(grouped: DataFrame, name: str, side: str, i: int) -> Column:
    """The sum of a value's plain numbers and of its others; NULL where it has neither."""
    sums = [F.col(c) for c in _limbs(grouped, side, i)]
    others = F.coalesce(F.col(name).cast(SUM_TYPE), F.lit(0).cast(SUM_TYPE))
    return F.when(sums[0].isNull(), F.col(name)).otherwise(others + from_limbs(sums)).alias(name)


@dataclass(frozen=True)
class Comparison:
    """The outcome: ``rows`` (empty after a refusal), a one-row ``summary``, and ``all_rows``."""

    rows: DataFrame
    summary: DataFrame
    all_rows: DataFrame
    keys: tuple[str, ...]
    values: tuple[str, ...]
    text_values: frozenset[str]
    tagged_rows: DataFrame  # ``rows`` with the tagged keys ``tag0``, ``tag1`` … beside the readable ones
    summarise: Callable[[Sequence[Column]], DataFrame]  # the summary, with more aggregates over ``all_rows``

    def magnitude(self) -> Column:
        return magnitude(self.values)

    def worst_first(self, limit: int | None = None) -> DataFrame:
        """Findings before agreements, largest difference first. The cut comes after the ordering."""
        ordered = self.rows.orderBy(
            severity(F.col("status")).desc(), self.magnitude().desc(), F.col("composite_key")
        )
        return ordered if limit is None else ordered.limit(limit)

    def capped_summary(self, limit: int) -> DataFrame:
        """The complete counts, with the size of the full row list and whether ``limit`` cuts it."""
        total = F.col("matched") + F.col("mismatched") + F.col("only_source") + F.col("only_target")
        return self.summary.withColumn("total_rows", total).withColumn("rows_capped", total > F.lit(limit))

    def cells(self) -> DataFrame:
        """The rows with the key and the cells as arrays."""
        cells = [
            F.struct(
                F.lit(v).alias("label"),
                *[
                    quoted(f"{v}_{part}").alias(part)
                    for part in CELL_PARTS
                ],
            )
            for v in self.values
        ]
        empty = F.array().cast(
            "array<struct<label:string,source:string,target:string,source_num:decimal(37,9),"
            "target_num:decimal(37,9),delta:decimal(38,9),status:string>>"
        )
        return self.rows.select(
            F.array(*[quoted(k) for k in self.keys]).cast("array<string>").alias("key"),
            "composite_key",
            "status",
            "source_row_count",
            "target_row_count",
            (F.array(*cells) if cells else empty).alias("cells"),
        )

    def sample_keys(self, side: str, n: int = 3) -> DataFrame:
        """A few readable keys of one side, to show what a refused pairing looked like: the shortest, in text order."""
        present = F.col("source_row_count" if side == "source" else "target_row_count") > 0
        shown = F.concat_ws(" · ", *[quoted(k) for k in self.keys]).alias("sample")
        # A composite key starts with its first key's length, which as text puts 10 before 9.
        return self.all_rows.where(present).orderBy(F.length("composite_key"), "composite_key").select(shown).limit(n)


def magnitude(values) -> Column:
    gaps = [F.abs(F.coalesce(quoted(f"{v}_delta"), F.lit(0).cast("decimal(38,9)"))) for v in values]
    if not gaps:
        return F.lit(0).cast("decimal(38,9)")
    return gaps[0] if len(gaps) == 1 else F.greatest(*gaps)


def drift_ms(source: Side, target: Side) -> int:
    if source.executed_at is None or target.executed_at is None:
        return 0
    return int(abs((target.executed_at - source.executed_at).total_seconds()) * 1000)


def _columns(side: Side, names: list[str]) -> tuple[list[str], list[str]]:
    found = [resolve(side.df, n) for n in names]
    return [f for f in found if f], [n for n, f in zip(names, found) if f is None]


def _padded(side: Side, missing: list[str]) -> Side:
    return replace(side, df=side.df.select("*", *[F.lit(None).cast("string").alias(n.strip("[]")) for n in missing]))


def _rows_read(side: Side) -> Column:
    return F.lit(side.rows_seen).cast("bigint") if side.rows_seen is not None else side.df.agg(F.count("*")).scalar()


def compare(
    source: Side | DataFrame,
    target: Side | DataFrame,
    keys,
    values=(),
    tolerance: Tolerance = EXACT,
    normalize: Normalize = Normalize(),
    min_overlap: int = 1,
    max_keys: int | None = None,
    materialize: bool = False,
) -> Comparison:
    """Compare two sides at the grain of ``keys`` over the ``values``.

    ``keys`` and ``values`` are column names, (source, target[, label]) tuples or ``Pair``s. Nothing
    runs until the result is used, unless ``materialize`` asks for the grouped keys to be checkpointed,
    which lets the rows, the summary and a drill tree share one read of the sides. A truncated read, too fine a grain (``max_keys``), two empty
    sides and keys that never meet are refused: ``rows`` is empty and ``summary`` says why.
    """
    source = source if isinstance(source, Side) else Side(source)
    target = target if isinstance(target, Side) else Side(target)
    keys, values = pairs(keys), pairs(values)
    refused_side = (
        "both"
        if source.truncated and target.truncated
        else "source" if source.truncated else "target" if target.truncated else None
    )

    s_names, s_missing = _columns(source, [p.source for p in keys + values])
    t_names, t_missing = _columns(target, [p.target for p in keys + values])
    if refused_side:
        # A read cut short is refused before its columns are looked at; those it lacks count as blank.
        source, target = _padded(source, s_missing), _padded(target, t_missing)
        s_names, t_names = ([resolve(side.df, n) for n in names] for side, names in ((source, [p.source for p in keys + values]), (target, [p.target for p in keys + values])))
    elif s_missing or t_missing:
        raise ValueError(
            "missing columns: "
            + ", ".join([f"source {n}" for n in s_missing] + [f"target {n}" for n in t_missing])
        )
    s_types = [source.df.schema[n].dataType for n in s_names]
    t_types = [target.df.schema[n].dataType for n in t_names]
    nk = len(keys)

    raw, neat, number = (lambda i: F.col(f"raw{i}")), (lambda i: F.col(f"neat{i}")), (lambda i: F.col(f"number{i}"))
    key_forms = [_key(raw(i), s_types[i], raw(i), t_types[i], normalize, neat(i)) for i in range(nk)]
    forms = [_text_form(s_types[nk + i], t_types[nk + i]) for i in range(len(values))]

    def layout(prefix: str, df: DataFrame, names, types) -> DataFrame:
        # Trimmed text and parsed numbers are columns of their own steps, so each is worked out once a row.
        first = [quoted(n).alias(f"raw{i}") for i, n in enumerate(names)]
        for i, (n, dtype) in enumerate(zip(names, types)):
            if not (is_number(dtype) or is_temporal(dtype) or isinstance(dtype, T.NullType)):
                first.append(trimmed(quoted(n).cast("string")).alias(f"neat{i}"))
        rows = df.select(*first)
        # Plain numbers are summed in limbs of 64 bits; only the others are parsed as decimals.
        plain = {i: plain_units(raw(nk + i), types[nk + i]) for i in range(len(values))}
        plain = {i: parts for i, parts in plain.items() if parts is not None}
        rows = rows.select("*", *[c.alias(f"{part}{i}") for i, parts in plain.items() for part, c in zip(("whole", "part"), parts)])
        spell = {i: F.col(f"spell{i}") for i in range(nk, nk + len(values)) if f"neat{i}" in rows.columns}
        rows = rows.select("*", *[spelling_of(neat(i)).alias(f"spell{i}") for i in spell])
        numbers, parts = [], [comparable_number(raw(nk + i), types[nk + i], neat(nk + i), spell.get(nk + i)) for i in range(len(values))]
        for i, found in enumerate(parts):
            if i in plain:
                other = F.col(f"whole{i}").isNull()
                found = Number(*[None if c is None else F.when(other, c) for c in (found.main, found.rest, found.spelling)])
            numbers.append(found.main.alias(f"number{i}"))
            numbers.append((F.lit(None).cast(REST_TYPE) if found.rest is None else found.rest).alias(f"rest{i}"))
            numbers.append((F.lit(None).cast("string") if found.spelling is None else found.spelling).alias(f"odd{i}"))
        mine = prefix == "s"
        out = [(k.source if mine else k.target).alias(f"k{i}") for i, k in enumerate(key_forms)]
        out += [F.lit(1 if mine else 0).alias("sr"), F.lit(0 if mine else 1).alias("tr")]
        for i, form in enumerate(forms):
            out.append(number(i).alias(f"{prefix}n{i}"))
            if i in plain:
                out += [c.alias(f"{prefix}l{i}_{j}") for j, c in enumerate(limbs(F.col(f"whole{i}"), F.col(f"part{i}")))]
            odd = F.col(f"odd{i}")
            if form:
                known = F.coalesce(F.col(f"whole{i}").cast(INPUT_TYPE), number(i)) if i in plain else number(i)
                text = _text_value(raw(nk + i), types[nk + i], form, normalize, known, odd, neat(nk + i))
                out.append(text.alias(f"{prefix}t{i}"))
            if parts[i].rest is not None:
                out.append(F.col(f"rest{i}").alias(f"{prefix}r{i}"))
            if parts[i].spelling is not None and form in ("flag", "text"):
                out.append(F.when(odd.isNotNull(), F.xxhash64(odd).cast("decimal(20,0)")).alias(f"{prefix}o{i}"))
                if form == "flag":
                    out.append(odd.cast("double").alias(f"{prefix}w{i}"))
        return rows.select("*", *numbers).select(*out)

    stacked = layout("s", source.df, s_names, s_types).unionByName(
        layout("t", target.df, t_names, t_types), allowMissingColumns=True
    )
    # What each result column is made of; all of these can be worked out again from their own results.
    made = [("source_row_count", F.sum, "sr"), ("target_row_count", F.sum, "tr")]
    for i, form in enumerate(forms):
        for side in "st":
            made += [(c, F.sum, c) for c in (f"{side}n{i}", *_limbs(stacked, side, i))]
            if form:
                made.append((f"{side}lo{i}", F.min, f"{side}t{i}"))
            if form in ("time", "text"):
                made.append((f"{side}hi{i}", F.max, f"{side}t{i}"))
            made += [(f"{side}{kind}{i}", F.sum, f"{side}{kind}{i}") for kind in "ro" if f"{side}{kind}{i}" in stacked.columns]
            if f"{side}w{i}" in stacked.columns:
                made += [(f"{side}wlo{i}", F.min, f"{side}w{i}"), (f"{side}whi{i}", F.max, f"{side}w{i}")]
    by, cells = [f"k{i}" for i in range(nk)], stacked
    texts = {f"{side}t{i}" for i, form in enumerate(forms) if form == "text" for side in "st"}
    if texts:
        # Extremes of text need sorted rows. Equal texts of a key are merged by hash first, so few rows are sorted.
        cells = stacked.groupBy(*by, *sorted(texts)).agg(*[fn(c).alias(out) for out, fn, c in made if c not in texts])
        made = [(out, fn, c if c in texts else out) for out, fn, c in made]
    grouped = cells.groupBy(*by).agg(*[fn(c).alias(out) for out, fn, c in made])
    totals = {f"{side}n{i}": (side, i) for i in range(len(forms)) for side in "st" if _limbs(stacked, side, i)}
    held = {c for side, i in totals.values() for c in _limbs(stacked, side, i)}
    grouped = grouped.select(*[_total(grouped, c, *parts) if (parts := totals.get(c)) else F.col(c) for c in grouped.columns if c not in held])
    if nk == 0:
        grouped = grouped.where("source_row_count + target_row_count > 0")
    if materialize:
        grouped = checkpointed(grouped)

    tags = [k.tagged(f"k{i}", normalize.granularity) for i, k in enumerate(key_forms)]
    cells = [
        compare_cell(
            _piece("s", i, form, normalize.granularity, grouped.columns), _piece("t", i, form, normalize.granularity, grouped.columns), tolerance
        )
        for i, form in enumerate(forms)
    ]
    wrong = reduce(lambda a, b: a | b, [c["status"] == "mismatch" for c in cells], F.lit(False))
    status = (
        F.when(F.col("target_row_count") == 0, "onlySource")
        .when(F.col("source_row_count") == 0, "onlyTarget")
        .when(wrong, "mismatch")
        .otherwise("match")
    )
    names = tuple(p.name for p in keys)
    labels = tuple(p.name for p in values)
    shown = [*names, *RESERVED, *[f"{v}_{part}" for v in labels for part in CELL_PARTS]]
    if len({n.lower() for n in shown}) < len(shown):
        raise ValueError(f"keys {names} and values {labels} need labels that do not collide")
    tagged = grouped.select(
        *[t.alias(f"tag{i}") for i, t in enumerate(tags)],
        *[display_part(t).alias(n) for t, n in zip(tags, names)],
        composite_key(tags).alias("composite_key"),
        status.alias("status"),
        "source_row_count",
        "target_row_count",
        *[c[part].alias(f"{v}_{part}") for v, c in zip(labels, cells) for part in c],
    )

    all_rows = tagged.drop(*[f"tag{i}" for i in range(nk)])
    tally = grouped.withColumn("status", status)
    drift = drift_ms(source, target)
    read = (_rows_read(source), _rows_read(target)) if refused_side else None
    summary = _summarise(tally, refused_side, drift, min_overlap, max_keys, read=read)
    clear = F.lit(False) if refused_side else summary.select("refusal_kind").scalar().isNull()
    return Comparison(
        rows=all_rows.where(clear),
        summary=summary,
        all_rows=all_rows,
        keys=names,
        values=labels,
        text_values=frozenset(v for v, f in zip(labels, forms) if f),
        tagged_rows=tagged.where(clear),
        summarise=lambda extra: _summarise(all_rows, refused_side, drift, min_overlap, max_keys, extra, read),
    )


def _summarise(
    rows: DataFrame,
    truncated_side: str | None,
    drift: int,
    min_overlap: int,
    max_keys: int | None,
    extra: Sequence[Column] = (),
    read: tuple[Column, Column] | None = None,
) -> DataFrame:
    if truncated_side:
        rows = rows.where(F.lit(False))
    s, t = F.col("source_row_count"), F.col("target_row_count")
    # Counting a hash of the whole row keeps every column in this branch of the plan. The shuffle is
    # then the same one the rows use, and Spark runs it once; with pruned columns it would run twice.
    whole = F.xxhash64(*[c for c in rows.columns if c != "status"])
    counted = rows.agg(
        F.count_if(F.col("status") == "match").alias("matched"),
        F.count_if(F.col("status") == "mismatch").alias("mismatched"),
        F.count_if(F.col("status") == "onlySource").alias("only_source"),
        F.count_if(F.col("status") == "onlyTarget").alias("only_target"),
        F.count(F.when(s > 0, whole)).alias("source_keys"),
        F.count(F.when(t > 0, whole)).alias("target_keys"),
        F.count_if(s > 1).alias("source_duplicate_keys"),
        F.count_if(t > 1).alias("target_duplicate_keys"),
        F.coalesce(F.sum(s), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum(t), F.lit(0)).alias("target_rows"),
        F.count_if((s > 0) & (t > 0)).alias("overlap"),
        *extra,
    )
    more = counted.columns[len(counted.columns) - len(extra):] if extra else []
    sk, tk = F.col("source_keys"), F.col("target_keys")
    none = F.lit(None).cast("string")
    if truncated_side:
        kind, side = F.lit("truncated"), F.lit(truncated_side)
        message = F.lit(
            f"read cut short on {truncated_side}: the missing rows would show up as differences; filter or group more"
        )
    else:
        over_s = sk > max_keys if max_keys is not None else F.lit(False)
        over_t = tk > max_keys if max_keys is not None else F.lit(False)
        kind = (
            F.when(over_s | over_t, "grainTooFine")
            .when((sk == 0) & (tk == 0), "emptyBothSides")
            .when((sk > 0) & (tk > 0) & (F.col("overlap") < min_overlap), "noKeyOverlap")
        )
        side = F.when(over_s & over_t, "both").when(over_s, "source").when(over_t, "target")
        message = (
            F.when(kind == "grainTooFine", F.lit("more distinct keys than the limit: the keys name rows, not groups"))
            .when(kind == "emptyBothSides", F.lit("neither side has rows: nothing to compare"))
            .when(
                kind == "noKeyOverlap",
                F.format_string(
                    "too few of %d source keys meet %d target keys: check that the key columns hold the same thing",
                    sk,
                    tk,
                ),
            )
        )
    counts = [
        "matched", "mismatched", "only_source", "only_target", "source_keys", "target_keys",
        "source_duplicate_keys", "target_duplicate_keys",
    ]
    named = counted.select(
        "*",
        kind.cast("string").alias("refusal_kind"),
        F.coalesce(side, none).alias("refusal_side"),
        F.coalesce(message, none).alias("refusal_message"),
    )
    clear = F.col("refusal_kind").isNull()
    return named.select(
        *[F.when(clear, F.col(c)).otherwise(F.lit(0)).cast("bigint").alias(c) for c in counts],
        *[(F.col(c) if read is None else read[i]).cast("bigint").alias(c) for i, c in enumerate(("source_rows", "target_rows"))],
        F.lit(drift).cast("bigint").alias("drift_ms"),
        "refusal_kind",
        "refusal_side",
        "refusal_message",
        F.when(F.col("refusal_kind") == "noKeyOverlap", sk).cast("bigint").alias("refused_source_keys"),
        F.when(F.col("refusal_kind") == "noKeyOverlap", tk).cast("bigint").alias("refused_target_keys"),
        *more,
    )
