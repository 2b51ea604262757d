"""Numeric helpers shared by the comparison, measure and profiling layers."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Values under comparison are carried with nine decimals. Sums are held one digit below Spark's
# maximum precision so that subtracting two of them still has room for all nine decimals.
INPUT_TYPE = "decimal(38,9)"
SUM_TYPE = "decimal(37,9)"
DELTA_TYPE = "decimal(38,9)"
# What lies below nine decimals is summed apart; both together are one number of 27 decimals.
REST_TYPE = "decimal(37,27)"
FINE_TYPE = "decimal(38,27)"

# The characters a text value is trimmed of.
WHITESPACE = (
    " \t\n\u000b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def exact(value: Column) -> Column:
    """Any number as a nine-decimal exact value; NULL when it does not fit."""
    return value.try_cast(INPUT_TYPE)


def summable(value: Column) -> Column:
    """The same, but NULL already where it does not fit a sum."""
    return value.try_cast(SUM_TYPE).cast(INPUT_TYPE)


def addable(value: Column) -> Column:
    """A number ready for an exact sum: not-a-number counts as blank, and one too large raises."""
    return F.when(~F.isnan(value.cast("double")), value.cast(INPUT_TYPE))


def exact_sum(value: Column) -> Column:
    """Sum without binary rounding. An overflow raises instead of turning into a quiet NULL."""
    return F.sum(addable(value)).cast(SUM_TYPE)


def safe_divide(numerator: Column, denominator: Column, alternate: Column | float | None = None) -> Column:
    """Division that yields ``alternate`` (NULL by default) when the denominator is zero or missing."""
    result = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    if alternate is None:
        return result
    return F.coalesce(result, alternate if isinstance(alternate, Column) else F.lit(alternate))


def truncate_number(value: Column) -> Column:
    """Whole part, rounded toward zero."""
    return value.cast("bigint")


def nearly_equal(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Equality relative to the larger magnitude, with a scale of at least one. NULL equals NULL."""
    x, y = a.cast("double"), b.cast("double")
    scale = F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
    close = F.abs(x - y) / scale < F.lit(tolerance)
    return F.coalesce(close, a.isNull() & b.isNull())


def spelled(text: Column) -> Column:
    """The text of any number, with or without an exponent, written out in full: one spelling for one value.

    Few rows need it; as a function over an array it adds no code to the rest of the plan's.
    """
    return F.get(F.transform(F.array(text), _spelled), F.lit(0))


def _spelled(text: Column) -> Column:
    exponent = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
    mantissa = F.regexp_extract(text, r"^[+-]?([0-9.]*)", 1)
    whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
    digits = F.concat(whole, part)
    short = F.ltrim(digits, F.lit("0"))
    point = F.length(whole) - (F.length(digits) - F.length(short)) + exponent  # digits before the point
    short = F.rtrim(short, F.lit("0"))
    many = F.length(short)
    plain = (
        F.when(point >= many, F.concat(short, F.repeat(F.lit("0"), point - many)))
        .when(point > 0, F.concat(F.left(short, point), F.lit("."), F.substring(short, point + 1, many)))
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), short))
    )
    return F.when(short == "", F.lit("0")).otherwise(F.concat(F.when(F.startswith(text, F.lit("-")), "-").otherwise(""), plain))


#: A limb holds six digits, so its sum fits 64 bits for nine million million rows.
LIMBS, LIMB = 4, 10**6
#: Below 10 to the power of the first, that many decimals make at most fifteen digits, which a double holds.
PLAIN_DECIMALS = ((6, 9), (9, 6), (11, 4), (13, 2), (15, 0))


def plain_units(value: Column, dtype: T.DataType) -> tuple[Column, Column] | None:
    """A number as whole units and billionths, both 64-bit; NULL where it isn't a plain one. None for types without.

    A double is plain if it is the double of a number of at most fifteen digits and nine decimals, which then
    is its shortest text: multiplied out to a whole number and divided again it is the same.
    """
    if isinstance(dtype, T.IntegralType):
        whole = value.cast("bigint")
        plain = (whole > -(10**15)) & (whole < 10**15)
        return F.when(plain, whole), F.when(plain, F.lit(0).cast("bigint"))
    if not isinstance(dtype, T.DoubleType):
        return None
    size = F.abs(value)
    pick = lambda of, kind: reduce(lambda so_far, p: F.when(size < 10.0 ** p[0], F.lit(of(p[1])).cast(kind)).otherwise(so_far), reversed(PLAIN_DECIMALS), F.lit(None).cast(kind))
    scale = pick(lambda d: 10.0**d, "double")
    scaled = F.rint(value * scale)
    units = F.when((size < 1e15) & (scaled / scale == value), scaled.cast("bigint"))
    step = pick(lambda d: 10**d, "bigint")
    # Division truncates toward zero, so both parts have the number's sign.
    return _whole_part(units, step), (units % step) * pick(lambda d: 10 ** (9 - d), "bigint")


def _whole_part(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def limbs(whole: Column, part: Column) -> list[Column]:
    """Billionths in limbs of six digits, the lowest first, from whole units and billionths."""
    thousand, limb = F.lit(1000).cast("bigint"), F.lit(LIMB).cast("bigint")
    upper = _whole_part(whole, thousand)
    return [part % limb, (whole % thousand) * thousand + _whole_part(part, limb), upper % limb, _whole_part(upper, limb)]


def from_limbs(sums: list[Column]) -> Column:
    """Sums of limbs as one number of nine decimals; carries come out of the addition."""
    tens = ["0.000000001", "0.001", "1000", "1000000000"]
    term = [(s.cast("decimal(20,0)") * F.lit(Decimal(t))) for s, t in zip(sums, tens)]
    low = (term[0].cast("decimal(33,9)") + term[1].cast("decimal(33,9)")).cast("decimal(34,9)") + term[2].cast("decimal(34,9)")
    return (term[3].cast("decimal(36,9)") + low.cast("decimal(35,9)")).cast("decimal(36,9)")


def below(value: Column) -> Column:
    """The part of a decimal below nine decimals, with its sign."""
    return value % F.lit(Decimal("0.000000001")).cast("decimal(10,9)")


def strip_fraction_zeros(text: Column) -> Column:
    """``1.50`` becomes ``1.5``, ``1.0`` becomes ``1`` and a zero loses its sign."""
    short = F.regexp_replace(text, r"\.0+$|(\.\d*?[1-9])0+$", "$1")
    return F.when(short == "-0", F.lit("0")).otherwise(short)


def number_text(value: Column, dtype: T.DataType) -> Column:
    """Shortest decimal text of a typed number, the same whichever numeric type carries it."""
    if isinstance(dtype, T.BooleanType):
        return value.cast("int").cast("string")
    if isinstance(dtype, T.IntegralType):
        return value.cast("string")
    if isinstance(dtype, T.DecimalType):
        text = value.cast("string")
        return strip_fraction_zeros(text) if dtype.scale > 0 else text
    x = value.cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < F.lit(1e15))
    # Within this range Spark writes a fraction without an exponent and without trailing zeros.
    short = (F.abs(x) >= F.lit(1e-3)) & (F.abs(x) < F.lit(1e7))
    # A float is the double of the same text, so that 0.1 is one value in either type.
    fine = spelled(value.cast("string"))
    return F.when(whole, x.cast("bigint").cast("string")).when(short, x.cast("string")).otherwise(fine)


def uniqueness(cardinality: Column, rows: Column) -> Column:
    """Distinct values per row, at most one; an empty table has none."""
    return F.when(rows > 0, F.least(F.lit(1.0), cardinality.cast("double") / rows)).otherwise(F.lit(0.0))


def shown_number(value: Column) -> Column:
    """A value as a report prints it: thousands separators, at most four decimals, blanks named."""
    grouped = F.regexp_replace(F.format_number(value.cast(SUM_TYPE), 4), r"\.0+$|(\.\d*?[1-9])0+$", "$1")
    return F.coalesce(grouped, F.lit("(blank)"))


def shown_delta(value: Column) -> Column:
    """A difference as a report prints it: dash for none, and dust below one millionth shown as zero."""
    return (
        F.when(value.isNull(), F.lit("—"))
        .when(F.abs(value) < F.lit(0.000001), F.lit("0"))
        .otherwise(shown_number(value))
    )
