"""Display names for numeric identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderglass.functions.numbers import strict_number
from orderglass.functions.text import clean_text, is_present, quoted, trimmed


def entity_label(column: Column, entity: str) -> Column:
    """``12.0`` as ``Customer 12``; blank stays null."""
    text = F.regexp_replace(trimmed(column), r"^(-?\d+)\.0+$", "$1")
    return F.concat(F.lit(entity + " "), F.nullif(text, F.lit("")))


def identifier_label(column: Column, entity: str) -> Column:
    """Like :func:`entity_label`, for mapped key columns: any whole number loses its decimals."""
    text = clean_text(column)
    number = strict_number(text)
    whole = F.when(number == F.floor(number), number.cast("decimal(38,0)").cast("string"))
    return F.concat(F.lit(entity + " "), F.coalesce(whole, text))


def numeric_only(df: DataFrame, name: str) -> Column:
    """One-row test, used as a scalar subquery: every present value is a number and at least one exists."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.lit(True)
    column = quoted(name)
    number = strict_number(column)
    verdict = df.agg(F.coalesce(F.bool_and(F.when(is_present(column), number.isNotNull())), F.lit(False)).alias("v"))
    return verdict.scalar()


def store_key_text(column: Column, data_type: T.DataType | None = None) -> Column:
    """Store ids: ``3.0`` and ``3`` are one store."""
    if isinstance(data_type, T.IntegralType):
        return column.cast("string")
    text = clean_text(column)
    return F.when(text.rlike(r"^[+-]?\d+\.0+$"), F.split_part(text, F.lit("."), F.lit(1))).otherwise(text)
