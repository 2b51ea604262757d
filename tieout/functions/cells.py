"""Comparison of one value pair at one key."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tieout.functions.normalize import display_part
from tieout.functions.numbers import DELTA_TYPE, FINE_TYPE, REST_TYPE, SUM_TYPE, strip_fraction_zeros

MULTIPLE = "(multiple values)"

# How bad each row status is, worst highest.
SEVERITY = {"match": 0, "mismatch": 2, "onlySource": 3, "onlyTarget": 3}


@dataclass(frozen=True)
class Tolerance:
    """Absolute or relative slack. The source value is the denominator of the relative one."""

    absolute: float | Decimal = 0
    relative: float = 0.0


EXACT = Tolerance()
DEFAULT = Tolerance(absolute=Decimal("0.000001"))


def within(source: Column, target: Column, tol: Tolerance, rest: Column | None = None) -> Column:
    """Whether two numbers are close enough; ``rest`` is the difference of what lies below nine decimals."""
    gap = F.abs((target - source).cast(DELTA_TYPE))
    slack = Decimal(str(tol.absolute))
    ok = gap <= F.lit(slack).cast(DELTA_TYPE)
    if rest is not None:
        # Beyond this gap no rest decides, unless it is a sum of more rows than there are.
        fine = F.abs((target - source).try_cast(REST_TYPE) + rest)
        ok = F.when(rest.isNull() | (gap > F.lit(10**9)), ok).otherwise(fine <= F.lit(slack).cast(FINE_TYPE))
    if tol.relative > 0:
        ratio = F.try_divide(gap.cast("double"), F.abs(source).cast("double"))
        ok = ok | F.coalesce(ratio <= F.lit(float(tol.relative)), F.lit(False))
    return ok


@dataclass(frozen=True)
class Piece:
    """What one side gathered for one value: an exact sum, and the text it saw where there was any."""

    number: Column
    text: Column | None = None
    multiple: Column | None = None
    rest: Column | None = None  # the sum of what lies below nine decimals
    odd: Column | None = None  # a sum of hashes of numbers that fit no sum; they are compared one by one


def _shown(side: Piece) -> Column:
    number = strip_fraction_zeros(side.number.cast("string"))
    if side.text is None:
        return number
    return (
        F.when(side.multiple, F.lit(MULTIPLE))
        .when(side.text.isNotNull(), display_part(side.text))
        .otherwise(number)
    )


def compare_cell(source: Piece, target: Piece, tol: Tolerance) -> dict[str, Column]:
    """Shown values, exact values, difference and status of one cell.

    A cell is compared as text as soon as either side saw a value that is not a number; otherwise
    as numbers, where a blank counts as zero but is still shown blank.
    """
    zero = F.lit(0).cast(SUM_TYPE)
    a, b = F.coalesce(source.number, zero), F.coalesce(target.number, zero)
    both_blank = source.number.isNull() & target.number.isNull()
    delta = F.when(~both_blank, (b - a).cast(DELTA_TYPE))
    rests = [p.rest if p.rest is not None else F.lit(None).cast(REST_TYPE) for p in (source, target)]
    rest = None
    if source.rest is not None or target.rest is not None:
        nothing = F.lit(0).cast(REST_TYPE)
        rest = F.when(rests[0].isNotNull() | rests[1].isNotNull(), (F.coalesce(rests[1], nothing) - F.coalesce(rests[0], nothing)).cast(REST_TYPE))
    status = F.when(both_blank | within(a, b, tol, rest), F.lit("match")).otherwise(F.lit("mismatch"))
    numbers = status
    texts = [p for p in (source, target) if p.text is not None]
    if texts:
        as_text = F.lit(False)
        several = F.lit(False)
        for p in texts:
            as_text = as_text | p.text.isNotNull()
            several = several | p.multiple
        left = source.text if source.text is not None else F.lit(None).cast("string")
        right = target.text if target.text is not None else F.lit(None).cast("string")
        text_status = F.when(~several & left.eqNullSafe(right), F.lit("match")).otherwise(F.lit("mismatch"))
        odds = [p.odd if p.odd is not None else F.lit(None).cast("decimal(38,0)") for p in (source, target)]
        # Numbers that fit no sum must be the same ones on both sides, and what could be summed must agree too.
        odd = odds[0].isNotNull() | odds[1].isNotNull()
        same = odds[0].eqNullSafe(odds[1]) & left.eqNullSafe(right) & ~several & (numbers == "match")
        status = F.when(odd, F.when(same, F.lit("match")).otherwise(F.lit("mismatch"))).when(as_text, text_status).otherwise(status)
        delta = F.when(~as_text, delta)
    return {
        "source": _shown(source),
        "target": _shown(target),
        "source_num": source.number,
        "target_num": target.number,
        "delta": delta,
        "status": status,
    }


def severity(status: Column) -> Column:
    return F.when(status.isin("onlySource", "onlyTarget"), 3).when(status == "mismatch", 2).otherwise(0)
