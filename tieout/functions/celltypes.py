"""What kind of value a text cell holds, and turning the text into that kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tieout.functions.normalize import LOOSE_NUMBER, ZONE_SUFFIX
from tieout.functions.numbers import trimmed

# The words and shapes recognised in text cells, and the share that decides a column.
TRUE_WORDS = ["true", "yes", "t", "y"]
FALSE_WORDS = ["false", "no", "f", "n"]
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"
US_DATE = r"^\d{1,2}/\d{1,2}/\d{4}$"
US_DATETIME = r"^\d{1,2}/\d{1,2}/\d{4}[ T]\d{1,2}:\d{2}(:\d{2})?$"
NUMERIC = r"^[-+]?[$€£¥]?\s?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?%?$"
NUMBER_MARKS = r"[$€£¥,%\s]"
DECIDING_SHARE = 0.9

KINDS = ["integer", "decimal", "boolean", "date", "dateTime", "string"]


def is_blank(text: Column) -> Column:
    """Missing, empty or nothing but white space. A printable first character settles most cells."""
    printable = F.substring(text, 1, 1).between("!", "~")
    return text.isNull() | F.when(printable, False).otherwise(trimmed(text) == "")


def _us_iso_day(s: Column) -> Column:
    part = lambda i: F.regexp_extract(s, r"^(\d{1,2})/(\d{1,2})/(\d{4})", i)
    return F.concat_ws("-", part(3), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"))


def _us_day(s: Column) -> Column:
    return _us_iso_day(s).try_cast("date")


def _us_moment(s: Column) -> Column:
    clock = F.lpad(F.regexp_extract(s, r"[ T](\d{1,2}:.*)$", 1), F.when(s.rlike(r":\d{2}:"), 8).otherwise(5), F.lit("0"))
    return F.concat_ws(" ", _us_iso_day(s), clock).try_cast("timestamp_ntz")


def _iso_moment(s: Column) -> Column:
    zoned = s.rlike(r":\d{2}(\.\d+)?" + ZONE_SUFFIX)
    return F.when(zoned, F.convert_timezone(None, F.lit("UTC"), s.try_cast("timestamp"))).otherwise(s.try_cast("timestamp_ntz"))


def to_date(text: Column) -> Column:
    """An ISO or US date (or the day of a datetime); NULL for anything that is no calendar date."""
    s = trimmed(text)
    return (
        F.when(s.rlike(ISO_DATE), s.try_cast("date"))
        .when(s.rlike(US_DATE) | s.rlike(US_DATETIME), _us_day(s))
        .when(s.rlike(ISO_DATETIME), _iso_moment(s).cast("date"))
    )


def to_datetime(text: Column) -> Column:
    """An ISO or US datetime without zone; a zone in the text is applied, giving UTC."""
    s = trimmed(text)
    return (
        F.when(s.rlike(ISO_DATE) | s.rlike(ISO_DATETIME), _iso_moment(s))
        .when(s.rlike(US_DATE), _us_day(s).cast("timestamp_ntz"))
        .when(s.rlike(US_DATETIME), _us_moment(s))
    )


def cell_kind(text: Column) -> Column:
    """integer, decimal, boolean, date, dateTime or string; NULL for a blank cell."""
    return trimmed_kind(trimmed(text))


def trimmed_kind(s: Column) -> Column:
    """``cell_kind`` of text that is trimmed already.

    The first character decides which patterns are worth a try: most text is settled by a word list.
    """
    moment = F.when(s.rlike(ISO_DATETIME), s.try_cast("timestamp")).when(s.rlike(US_DATETIME), _us_moment(s))
    day = F.when(s.rlike(ISO_DATE), s.try_cast("date")).when(s.rlike(US_DATE), _us_day(s))
    dated = (
        F.when(F.length(s) < 8, "string")
        .when(F.contains(s, F.lit(":")), F.when(moment.isNotNull(), "dateTime").otherwise("string"))
        .otherwise(F.when(day.isNotNull(), "date").otherwise("string"))
    )
    number = F.when(F.contains(s, F.lit(".")), "decimal").otherwise("integer")
    numeric_start = F.substring(s, 1, 1).isin(*"0123456789+-$€£¥")
    word = F.when((F.length(s) <= 5) & F.lower(s).isin(TRUE_WORDS + FALSE_WORDS), "boolean").otherwise("string")
    return (
        F.when(s.isNull() | (s == ""), F.lit(None).cast("string"))
        .when(numeric_start, F.when(s.rlike(NUMERIC), number).otherwise(dated))
        .otherwise(word)
    )


def column_kind(counts: dict[str, Column]) -> Column:
    """The kind of a column from the counts of its cells: a kind needs nine tenths of the present ones."""
    filled = sum((counts[k] for k in KINDS[1:]), counts[KINDS[0]])
    enough = lambda n: n >= DECIDING_SHARE * filled
    numeric = counts["integer"] + counts["decimal"]
    temporal = counts["date"] + counts["dateTime"]
    return (
        F.when(filled == 0, "string")
        .when(enough(counts["boolean"]), "boolean")
        .when(enough(numeric), F.when(counts["decimal"] > 0, "decimal").otherwise("integer"))
        .when(enough(temporal), F.when(counts["dateTime"] > 0, "dateTime").otherwise("date"))
        .otherwise("string")
    )


def coerce(text: Column, kind: str) -> Column:
    """Text as its column's kind. Blank and unreadable cells are NULL; any word but a true one is false."""
    if kind in ("integer", "decimal"):
        plain = F.regexp_replace(text, NUMBER_MARKS, "")
        number = F.when(plain.rlike(LOOSE_NUMBER), plain)
        as_double = number.try_cast("double")
        value = as_double if kind == "decimal" else F.coalesce(number.try_cast("bigint"), as_double.try_cast("bigint"))
    elif kind == "boolean":
        value = F.lower(trimmed(text)).isin(TRUE_WORDS)
    elif kind == "date":
        value = to_date(text)
    elif kind == "dateTime":
        value = to_datetime(text)
    else:
        value = text
    return F.when(~is_blank(text), value)
