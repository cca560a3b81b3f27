"""Number parsing and exact money sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderglass.functions.text import as_text, once, trimmed

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MONEY = T.DecimalType(38, 6)


def finite(column: Column) -> Column:
    """Null out NaN and the infinities, which would poison every later sum."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def strict_number(column: Column, data_type: T.DataType | None = None) -> Column:
    """The value as a double when the whole text is a number, else null.

    The pattern keeps out texts a JVM cast would accept and a CSV reader would not (``1d``, ``NaN``).
    """
    if isinstance(data_type, T.FractionalType) and not isinstance(data_type, T.DecimalType):
        return finite(column.cast("double"))
    if isinstance(data_type, T.NumericType):
        return column.cast("double")
    text = trimmed(column)
    return finite(F.when(text.rlike(NUMBER_PATTERN), text).try_cast("double"))


def lenient_number(column: Column, data_type: T.DataType | None = None, percentage: bool = False) -> Column:
    """A number out of messy text: currency words, thousands commas, ``(5)`` for -5, ``10%``.

    A text that already is a number keeps its value. Rates (``percentage=True``) divide ``%`` texts by 100.
    """
    if isinstance(data_type, T.NumericType):
        return strict_number(column, data_type)
    text = trimmed(column)
    signed = F.regexp_replace(text, r"^\([^0-9+\-.]*[+-]?(.*)\)$", "-$1")
    digits = F.regexp_replace(signed, r"[^0-9+\-.]", "")
    # Only digits, signs and dots are left here, so the cast accepts nothing but plain numbers.
    value = once(F.when(text.rlike(NUMBER_PATTERN), text).otherwise(digits).try_cast("double"), finite)
    if percentage:
        value = value / F.when(F.contains(text, F.lit("%")), 100.0).otherwise(1.0)
    return value


def symbol_free_number(column: Column) -> Column:
    """Profiling view of a number: drops currency signs, commas and spaces, nothing else."""
    return strict_number(F.regexp_replace(as_text(column), r"[$£€¥,\s]", ""))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Double division where a null on either side or a zero denominator gives 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def exact_sum(column: Column) -> Column:
    """Sum of doubles to the sixth decimal that does not depend on row order; an empty sum is 0.

    Whole units and millionths are summed as two longs, so the aggregate keeps fixed-width hash buffers
    (a DECIMAL buffer is several times slower) while two tasks that add the same rows in another order
    still agree to the last digit. Reconciliation at any size relies on that. Values of a trillion and more are
    summed as decimals of their own; what a DECIMAL(38, 6) cannot hold makes the sum null instead of an error.
    """
    column = column.cast("double")
    large = F.abs(column) >= 1e12
    usual = F.when(~large, column)
    whole = F.floor(usual)
    millionths = F.rint((usual - whole) * 1_000_000).cast("bigint")
    beyond = F.try_sum(F.when(large, column.try_cast(MONEY)))
    lost = F.count_if(large) != F.count(F.when(large, column.try_cast(MONEY)))
    total = F.sum(whole).cast("decimal(20,0)") + F.sum(millionths).cast("decimal(20,0)") * F.expr("0.000001BD")
    some = F.count_if(large) > 0
    return F.when(~some, F.coalesce(total, F.lit(0)).cast(MONEY)).when(~lost, (F.coalesce(total, F.lit(0)) + beyond).try_cast(MONEY))


def money_total(column: Column) -> Column:
    """Sum of an already exact money column over a summary table; an empty sum is 0."""
    return F.coalesce(F.sum(column), F.lit(0)).cast(MONEY)
