"""Date parsing for columns that mix several written forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderglass.functions.text import once, trimmed

_CLOCK = r"[T ]+(\d{1,2})(:\d{2}(?::\d{2}(?:\.\d{1,9})?)?) ?([AaPp][Mm])?(?:Z|[+-]\d{2}:?\d{2})?$"
_NAME_FIRST = r"^([A-Za-z]{3})[A-Za-z]*\.?[ -](\d{1,2})(?:st|nd|rd|th)?,?[ -]+(\d{4})$"
_DAY_FIRST = r"^(\d{1,2})(?:st|nd|rd|th)?[ -]([A-Za-z]{3})[A-Za-z]*\.?,?[ -](\d{2}|\d{4})$"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

# Rewrites to year-month-day, tried in order; a text no pattern fits stays as it is and fails the cast.
_YEAR_FIRST = (
    (r"^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?$", "$1-$2-$3"),
    (r"^(\d{4})[-/.年](\d{1,2})月?$", "$1-$2-01"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
)
_SHORT_YEARS = (
    (r"^(\d{1,2}[-/.]\d{1,2}[-/.])([0-6]\d)$", "$120$2"),
    (r"^(\d{1,2}[-/.]\d{1,2}[-/.])([7-9]\d)$", "$119$2"),
)
_YEAR_LAST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
_DAY_SURE = r"^(1[3-9]|2\d|3[01])[-/.](\d{1,2})[-/.](\d{4})$"
_MONTH_SURE = r"^(\d{1,2})[-/.](1[3-9]|2\d|3[01])[-/.](\d{4})$"

DATE_LIKE_PATTERN = (
    r"(?i)\d{4}[-/.年]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|"
    r"jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
)


def _rewritten(text: Column, rules) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _named_month(text: Column) -> Column:
    """``Jan 3, 2024``, ``3 January 2024`` or ``3-Jan-24`` as year-month-day."""
    parts = F.when(
        F.substring(text, 1, 1) > "9", F.regexp_replace(text, _NAME_FIRST, "$3-$1-$2")
    ).otherwise(F.regexp_replace(text, _DAY_FIRST, "$3-$2-$1"))
    return once(parts, _numbered_month)


def _numbered_month(parts: Column) -> Column:
    year, name, day = (F.split_part(parts, F.lit("-"), F.lit(i)) for i in (1, 2, 3))
    century = F.when(F.length(year) == 4, "").when(year < "70", "20").otherwise("19")
    month = ((F.instr(F.lit(_MONTHS), F.lower(name)) + 2) / 3).cast("int").cast("string")
    return F.concat(century, year, F.lit("-"), month, F.lit("-"), day)


def _clock(text: Column) -> Column:
    """The clock part as `` HH:mm...`` on 24 hours, or blank."""
    hour = F.regexp_extract(text, _CLOCK, 1).try_cast("int")
    half = F.lower(F.regexp_extract(text, _CLOCK, 3))
    hour = F.when(half == "am", hour % 12).when(half == "pm", hour % 12 + 12).otherwise(hour)
    return F.when(
        text.rlike(_CLOCK), F.concat(F.lit(" "), hour.cast("string"), F.regexp_extract(text, _CLOCK, 2))
    ).otherwise("")


def parse_date(
    column: Column,
    data_type: T.DataType | None = None,
    day_first: bool = False,
    swap_impossible: bool = True,
) -> Column:
    """A ``timestamp_ntz`` out of the written forms below; anything else is null.

    Year first (``2024-01-02``, ``2024/1/2``, ``2024年1月2日``), year last (``01/02/2024``), month names
    (``Jan 3 2024``, ``3-Jan-2024``), ``yyyyMMdd`` and a bare year, each with an optional clock time.
    Two-digit years mean 1970-2069. ``01/02/2024`` is January 2 unless ``day_first``. With
    ``swap_impossible`` a value whose month part exceeds 12 is read the other way round. Whole numbers are
    read as ``yyyyMMdd``, never as nanoseconds.
    """
    if isinstance(data_type, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return column.cast("timestamp_ntz")
    if isinstance(data_type, T.IntegralType):
        column = column.cast("string")
    elif isinstance(data_type, T.NumericType):
        column = column.cast("decimal(20,0)").cast("string")
    text = trimmed(column)

    month_first_form, day_first_form = "$3-$1-$2", "$3-$2-$1"
    year_last = [(_YEAR_LAST, day_first_form if day_first else month_first_form)]
    if swap_impossible:
        sure = (_MONTH_SURE, month_first_form) if day_first else (_DAY_SURE, day_first_form)
        year_last.insert(0, sure)
    timed = F.contains(text, F.lit(":"))  # without a colon there is no clock to look for
    day = F.when(timed, F.regexp_replace(text, _CLOCK, "")).otherwise(text)
    written = F.when(text.rlike("^[^:]*[A-Za-z]{3}"), _named_month(day)).otherwise(
        _rewritten(day, (*_YEAR_FIRST, *_SHORT_YEARS, *year_last))
    )
    clock = F.when(timed, _clock(text)).otherwise("")
    general = F.when(text.rlike(r"\d{4}|\d[-/.]\d|[A-Za-z]-\d\d"), F.concat(written, clock))

    # The common ten-character forms and plain ISO times skip every pattern.
    def mark(position: int) -> Column:
        return F.substring(text, position, 1)

    ten = F.length(text) == 10
    plain = (mark(5) == "-") & (mark(8) == "-") & (ten | ((F.length(text) >= 16) & (mark(-1) <= "9")))
    first, second = F.substring(text, 1, 2), F.substring(text, 4, 2)
    month, other = (second, first) if day_first else (first, second)
    if swap_impossible:
        month, other = F.when(month > "12", other).otherwise(month), F.when(month > "12", month).otherwise(other)
    readable = (
        F.when(plain, text)
        .when(ten & (mark(5) == "/") & (mark(8) == "/"), F.translate(text, "/", "-"))
        .when(ten & (mark(3) == "/") & (mark(6) == "/"), F.concat_ws("-", F.substring(text, 7, 4), month, other))
        .otherwise(general)
    )
    return readable.try_cast("timestamp_ntz")


def looks_like_date(column: Column, data_type: T.DataType | None = None) -> Column:
    if isinstance(data_type, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return F.lit(True)
    if isinstance(data_type, T.NumericType):
        return F.lit(False)
    return F.coalesce(trimmed(column).rlike(DATE_LIKE_PATTERN), F.lit(False))


def year_month(column: Column) -> Column:
    """``YYYY-MM`` of a date or time; null stays null."""
    return F.date_format(column, "yyyy-MM")
