"""Three-valued boolean parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderglass.functions.text import as_text, trimmed

# Texts read as returned / not returned in a plain order file.
ORDER_FILE_TRUE = ("true", "yes", "y", "1", "returned")
ORDER_FILE_FALSE = ("false", "no", "n", "0", "", "not_returned")

# Texts read as returned / not returned in a mapped table.
MAPPED_TRUE = ("true", "yes", "y", "1", "returned", "return", "是", "已退货", "退货")
MAPPED_FALSE = ("false", "no", "n", "0", "not_returned", "not returned", "否", "未退货")


def _flag(column: Column, data_type: T.DataType | None, true_texts, false_texts) -> Column:
    if isinstance(data_type, T.BooleanType):
        return column
    text = F.lower(trimmed(column))
    return F.when(text.isin(*true_texts), True).when(text.isin(*false_texts), False)


def order_file_flag(column: Column, data_type: T.DataType | None = None) -> Column:
    """White space alone means false here; a null stays null."""
    return _flag(column, data_type, ORDER_FILE_TRUE, ORDER_FILE_FALSE)


def mapped_flag(column: Column, data_type: T.DataType | None = None) -> Column:
    """White space alone stays unknown here."""
    return _flag(column, data_type, MAPPED_TRUE, MAPPED_FALSE)


def is_whole_text(column: Column) -> Column:
    return as_text(column).rlike(r"^[+-]?[0-9]+$")
