"""Comparable forms of join keys."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderglass.functions.dates import parse_date
from orderglass.functions.numbers import NUMBER_PATTERN, strict_number
from orderglass.functions.text import as_text, quoted

# Key texts that mean "no key", and the characters that carry no width.
NULL_KEYS = ("", "nan", "none", "null", "<na>", "nat")
ZERO_WIDTH = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0xFEFF)))

KEY_KINDS = ("text", "numeric", "date")
LEADING_ZERO = r"^[+-]?0[0-9]+$"


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    """NFKC and case folding, which the JVM side has no function for."""
    return texts.map(lambda text: unicodedata.normalize("NFKC", text).casefold(), na_action="ignore")


def text_key(column: Column, unicode_text: bool = False) -> Column:
    """Trimmed, case-folded text with single spaces; the null tokens become null.

    ``unicode_text`` adds compatibility folding of full-width letters and the like. It moves every value
    through Arrow, so it is meant for columns that :func:`has_unicode` found to need it.
    """
    text = as_text(column)
    if unicode_text:
        text = F.translate(_folded(text), ZERO_WIDTH, "")
        text = F.regexp_replace(text, r"(?U)\s+", " ")
    else:
        text = F.regexp_replace(F.lower(text), r"\s+", " ")
    text = F.trim(text)
    return F.when(~text.isin(*NULL_KEYS), text)


def numeric_key(column: Column, unicode_text: bool = False) -> Column:
    """Whole numbers of any length digit by digit, other numbers to 15 significant digits; commas are dropped."""
    text = F.replace(text_key(column, unicode_text), F.lit(","), F.lit(""))
    digits = F.regexp_replace(text, r"^[+-]?0*([0-9]+?)(\.0*)?$", "$1")
    minus = F.when(F.startswith(text, F.lit("-")) & (digits != "0"), "-").otherwise("")
    whole = F.when(text.rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.concat(minus, digits))
    number = strict_number(text)
    whole_double = F.when((number == F.floor(number)) & (F.abs(number) < 1e37), number.try_cast("decimal(38,0)"))
    rounded = F.when(text.rlike(NUMBER_PATTERN), F.format_string("%.14e", number))
    return F.coalesce(whole, whole_double.cast("string"), rounded)


def canonical_key(
    column: Column, kind: str = "text", data_type: T.DataType | None = None, unicode_text: bool = False
) -> Column:
    """The comparison form of a key column, as text; null means the row has no key."""
    if kind not in KEY_KINDS:
        raise ValueError(f"Unknown key kind {kind!r}")
    if kind == "date":
        return F.date_format(parse_date(column, data_type), "yyyy-MM-dd")
    if isinstance(data_type, T.IntegralType):
        return as_text(column)
    if kind == "numeric":
        return numeric_key(column, unicode_text)
    return text_key(column, unicode_text)


def has_unicode(df: DataFrame, names: Sequence[str]) -> bool:
    """Whether any of the string columns holds a character beyond ASCII: one aggregate over those columns."""
    texts = [name for name in dict.fromkeys(names) if isinstance(df.schema[name].dataType, T.StringType)]
    if not texts:
        return False
    found = [F.bool_or(quoted(name).rlike(r"[^\x00-\x7f]")) for name in texts]
    return bool(df.agg(F.coalesce(F.greatest(*found), F.lit(False)) if len(found) > 1
                       else F.coalesce(found[0], F.lit(False))).first()[0])


def join_key_columns(
    left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], kinds: Sequence[str],
    unicode_text: bool | None = None,
) -> tuple[list[Column], list[Column]]:
    """Aligned key columns for an equi-join.

    Two whole-number columns stay numbers and two date columns stay dates, so the join uses them as they
    are. Everything else compares as canonical text.
    """
    if not len(left_on) == len(right_on) == len(kinds):
        raise ValueError("Both sides need the same number of key columns, each with a kind.")
    if unicode_text is None:
        unicode_text = has_unicode(left, left_on) or has_unicode(right, right_on)
    pairs = []
    for a, b, kind in zip(left_on, right_on, kinds):
        types = left.schema[a].dataType, right.schema[b].dataType
        if kind != "date" and all(isinstance(t, T.IntegralType) for t in types):
            pairs.append((quoted(a).cast("bigint"), quoted(b).cast("bigint")))
        elif kind == "date":
            pairs.append(tuple(F.to_date(parse_date(quoted(n), t)) for n, t in zip((a, b), types)))
        else:
            pairs.append(tuple(
                canonical_key(quoted(n), kind, t, unicode_text and isinstance(t, T.StringType))
                for n, t in zip((a, b), types)
            ))
    return [pair[0] for pair in pairs], [pair[1] for pair in pairs]
