"""Text cleaning expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The texts a CSV reader treats as a missing cell.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Every character Unicode calls white space.
WHITE_SPACE = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000,
)))


def quoted(name: str) -> Column:
    """A column reference that survives dots and backticks in its name."""
    return F.col("`" + name.replace("`", "``") + "`")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once; in a branch or a filter every mention of it would compute it again."""
    return F.transform(F.array(value), use).getItem(0)


def as_text(column: Column) -> Column:
    return column.cast("string")


def trimmed(column: Column) -> Column:
    return F.btrim(as_text(column), F.lit(WHITE_SPACE))


def clean_text(column: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(trimmed(column), F.lit(""))


def is_present(column: Column) -> Column:
    """True or false, never null: the value is neither null nor blank."""
    return F.coalesce(trimmed(column) != "", F.lit(False))


def drop_missing_texts(df: DataFrame) -> DataFrame:
    """Turn the missing-cell texts of every string column into null, as a CSV read does."""
    texts = {name for name, kind in df.dtypes if kind == "string"}
    return df.select(*[
        F.when(~quoted(name).isin(*MISSING_TEXTS), quoted(name)).alias(name) if name in texts else quoted(name)
        for name in df.columns
    ])


def _units(amount: Column, digits: int) -> Column:
    """A value >= 0 in units of its last shown digit: half to even on the exact binary value."""
    scale, bits = 10**digits, 50
    whole = F.floor(amount)
    part = (amount - whole) * float(1 << bits)  # exact: only the exponent changes
    places = F.floor(part)
    scaled = places * scale
    units = F.shiftright(scaled, bits)
    rest = scaled - F.shiftleft(units, bits)
    units = whole * scale + units
    half = 1 << (bits - 1)
    above = (rest > half) | ((rest == half) & ((part > places) | (units % 2 == 1)))
    return units + F.when(above, 1).otherwise(0)


def money_text(column: Column) -> Column:
    """``$1,234.50``; negative amounts as ``-$1,234.50``."""
    amount = column.cast("double")
    units = _units(F.abs(amount), 2)
    return F.concat(
        F.when(amount < 0, "-$").otherwise("$"), F.format_string("%,d.%02d", F.floor(units / 100), units % 100)
    )


def percent_text(column: Column) -> Column:
    """``12.5%`` for 0.125."""
    share = column.cast("double") * 100
    units = _units(F.abs(share), 1)
    sign = F.when(share < 0, "-").otherwise("")
    return F.concat(sign, F.format_string("%d.%d%%", F.floor(units / 10), units % 10))


def month_text(year_month: Column) -> Column:
    """``2026-02`` as ``February 2026``."""
    return F.date_format(F.to_date(F.concat(year_month, F.lit("-01"))), "MMMM yyyy")
