"""Key and value normalisation.

Two systems return the same key in different shapes: padded text, a date against a midnight
timestamp, ``1`` against ``"1"`` against ``1.0``, a bit against a boolean, another case. Each value
becomes one tagged text: ``n:`` missing, ``d:`` number, ``t:`` date, ``s:`` other text. The column
type picks the branch while the plan is built; only text columns pay for pattern tests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.functions.numbers import FINE_TYPE, INPUT_TYPE, REST_TYPE, below, exact, number_text, spelled, strip_fraction_zeros, summable, trimmed

NULL_TAG = "n:"

# The text shapes recognised as dates, numbers and identifiers.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"
ZONE_SUFFIX = r"(Z|[+-]\d{2}:?\d{2})$"
PLAIN_NUMBER = r"^-?\d+(\.\d+)?$"
LEADING_ZERO = r"^-?0\d"
LOOSE_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


@dataclass(frozen=True)
class Normalize:
    case_insensitive: bool = True
    trim: bool = True
    granularity: str = "date"  # or "datetime"

    def __post_init__(self):
        if self.granularity not in ("date", "datetime"):
            raise ValueError("granularity is 'date' or 'datetime'")


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def canonical_number(text: Column) -> Column:
    """Number text in one spelling, or NULL where it must stay text ("007" is an identifier)."""
    plain = text.rlike(PLAIN_NUMBER) & ~text.rlike(LEADING_ZERO)
    return F.when(plain, strip_fraction_zeros(text))


def utc(value: Column, dtype: T.DataType) -> Column:
    """A date or timestamp without zone, read in UTC whatever the session zone is."""
    if isinstance(dtype, T.TimestampType):
        return F.convert_timezone(None, F.lit("UTC"), value)
    return value


def temporal_text(value: Column, granularity: str) -> Column:
    if granularity == "date":
        return value.cast("date").cast("string")
    return F.replace(_second_text(value), F.lit(" "), F.lit("T"))


def _second_text(value: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` without a detour through the session zone, which may skip an hour."""
    return F.substring(value.cast("timestamp_ntz").cast("string"), 1, 19)


def to_second(value: Column) -> Column:
    return _second_text(value).cast("timestamp_ntz")


def zoned_text(text: Column, granularity: str) -> Column:
    """Text carrying a zone, as UTC. The zone is applied by hand so the session zone plays no part."""
    naive = F.substring(text, 1, 19).try_cast("timestamp_ntz")
    zone = F.regexp_replace(F.regexp_extract(text, ZONE_SUFFIX, 1), ":", "")
    minutes = F.when(zone == "Z", F.lit(0)).otherwise(
        (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"))
        * F.when(F.substring(zone, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    )
    return temporal_text(naive - F.make_dt_interval(mins=minutes), granularity)


def text_key(value: Column, opts: Normalize, neat: Column | None = None) -> Column:
    """The key of a text value; ``neat`` is its trimmed form where that is at hand."""
    text = value if not opts.trim else trimmed(value) if neat is None else neat
    folded = F.concat(F.lit("s:"), F.lower(text) if opts.case_insensitive else text)
    day = F.substring(text, 1, 10)
    if opts.granularity == "date":
        plain_date, naive = text, day
    else:
        plain_date = F.concat(text, F.lit("T00:00:00"))
        naive = F.concat(day, F.lit("T"), F.substring(text, 12, 8))
    # The first character settles most rows: text that does not start like a number or a date skips
    # the pattern tests.
    shaped = (
        F.when(text.rlike(ISO_DATE), F.concat(F.lit("t:"), plain_date))
        .when(
            text.rlike(ISO_DATETIME),
            F.coalesce(
                F.concat(
                    F.lit("t:"),
                    F.when(text.rlike(r":\d{2}(\.\d+)?" + ZONE_SUFFIX), zoned_text(text, opts.granularity)).otherwise(naive),
                ),
                folded,
            ),
        )
        .otherwise(F.coalesce(F.concat(F.lit("d:"), canonical_number(text)), folded))
    )
    starts_like_number = F.substring(text, 1, 1).isin(*"-0123456789")
    return F.when(value.isNull(), F.lit(NULL_TAG)).when(starts_like_number, shaped).otherwise(folded)


def normalize_key(value: Column, dtype: T.DataType, opts: Normalize = Normalize(), neat: Column | None = None) -> Column:
    """One value as tagged canonical text; never NULL."""
    if isinstance(dtype, T.NullType):
        return F.lit(NULL_TAG)
    if is_temporal(dtype):
        body = F.concat(F.lit("t:"), temporal_text(utc(value, dtype), opts.granularity))
    elif is_number(dtype):
        body = F.concat(F.lit("d:"), number_text(value, dtype))
        if is_float(dtype):
            body = F.when(~finite(value), F.lit(NULL_TAG)).otherwise(body)
    else:
        return text_key(value.cast("string"), opts, neat)
    return F.coalesce(body, F.lit(NULL_TAG))


def finite(value: Column) -> Column:
    return F.abs(value.cast("double")) < F.lit(float("inf"))  # NaN sorts above infinity in Spark


@dataclass(frozen=True)
class Number:
    """A value as a number: up to nine decimals, what lies below them (27 in all), and the spelling of a
    number that fits neither. Parts that a type cannot have are None; NULL parts are blank."""

    main: Column
    rest: Column | None = None
    spelling: Column | None = None


def comparable_number(value: Column, dtype: T.DataType, neat: Column | None = None, spell: Column | None = None) -> Number:
    """A value as an exact number; all parts are NULL for anything that is not one."""
    if isinstance(dtype, T.BooleanType):
        return Number(value.cast("int").cast(INPUT_TYPE))
    if is_temporal(dtype) or isinstance(dtype, T.NullType):
        return Number(F.lit(None).cast(INPUT_TYPE))
    if isinstance(dtype, T.IntegralType):
        return Number(exact(value))
    if isinstance(dtype, T.DecimalType):
        wide, deep = dtype.precision - dtype.scale > 29, dtype.scale > 9
        if not wide and not deep:
            return Number(exact(value))
        low = below(value) if deep else F.lit(0)
        rest = low.try_cast(REST_TYPE) if deep else F.lit(None).cast(REST_TYPE)
        main = summable(value - low) if deep else summable(value)
        fits = main.isNotNull() & (F.lit(True) if dtype.scale <= 27 else rest.cast(value_type(dtype)) == low)
        spelling = strip_fraction_zeros(value.cast("string")) if deep else value.cast("string")
        return _parts(value.isNotNull(), fits, main, rest, spelling)
    if isinstance(dtype, T.NumericType):
        # Most values have nine decimals at most: then nothing else is worked out. A float is its text.
        near, fine = summable(value), value.cast("string").try_cast(FINE_TYPE)
        plain = near.cast("double") == value.cast("double") if isinstance(dtype, T.DoubleType) else F.lit(False)
        return _deep(near, plain, fine, fine.cast(dtype) == value, spelled(value.cast("string")), finite(value))
    text = trimmed(value.cast("string")) if neat is None else neat
    spell = spelling_of(text) if spell is None else spell
    fine = text.try_cast(FINE_TYPE)
    return _deep(summable(text), spell.isNull(), fine, strip_fraction_zeros(fine.cast("string")) == spell, spell, text.rlike(LOOSE_NUMBER))


def spelling_of(text: Column) -> Column:
    """A number text in full where nine decimals may not hold it; NULL for most texts."""
    return F.when(text.rlike(r"\.\d{10}|[eE]|\d{28}") & text.rlike(LOOSE_NUMBER), spelled(text))


def value_type(dtype: T.DecimalType) -> str:
    return f"decimal({dtype.precision},{dtype.scale})"


def _parts(present: Column, fits: Column, main: Column, rest: Column, spelling: Column) -> Number:
    ok = present & fits
    return Number(F.when(ok, main), F.when(ok & (rest != 0), rest), F.when(present & ~fits, spelling))


def _deep(near: Column, plain: Column, fine: Column, whole: Column, spelling: Column, number: Column) -> Number:
    """``near`` and ``fine`` are a number with nine and with 27 decimals, ``plain`` and ``whole`` whether that is all of it."""
    low = below(fine)
    fits = near.isNotNull() & (plain | F.coalesce(whole, F.lit(False)))
    main = F.when(plain, near).otherwise(summable(fine - low))
    return _parts(F.coalesce(number, F.lit(False)), fits, main, F.when(~plain, low.try_cast(REST_TYPE)), spelling)


def display_part(tagged: Column) -> Column:
    """The readable part of a tagged key."""
    return F.when(F.startswith(tagged, F.lit(NULL_TAG)), F.lit("(blank)")).otherwise(
        F.regexp_replace(tagged, r"^[^:]*:", "")
    )


def composite_key(parts: list[Column]) -> Column:
    """Length-prefixed join of the parts, so no two different keys can spell the same text."""
    if not parts:
        return F.lit("")
    pieces = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.concat_ws("|", *pieces)
