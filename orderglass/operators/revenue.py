"""Standard order rows and their revenue columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderglass.functions.dates import parse_date, year_month
from orderglass.functions.flags import order_file_flag
from orderglass.functions.labels import entity_label, numeric_only
from orderglass.functions.numbers import strict_number
from orderglass.functions.text import quoted

ORDER_COLUMNS = (
    "order_id", "date", "customer_id", "product_id", "unit_price", "quantity", "discount_rate", "returned",
)
# Name column -> the entity in its labels, and the value where the column is missing.
NAMES = {"category": ("Category", "Unknown"), "customer_name": ("Customer", None), "product_name": ("Product", None)}
TYPED = "_typed_"
EXPENSE_COLUMNS = ("expense_id", "date", "expense_category", "amount")


class ColumnMappingError(ValueError):
    """A column mapping does not fit the table."""


def rename_columns(df: DataFrame, mapping: Mapping[str, str | None] | None) -> DataFrame:
    """Rename source columns to standard names; ``mapping`` is standard name -> source name."""
    wanted = {standard: str(source) for standard, source in (mapping or {}).items() if source not in (None, "")}
    sources = list(wanted.values())
    repeated = sorted({source for source in sources if sources.count(source) > 1})
    if repeated:
        raise ColumnMappingError(f"One source column is mapped to several standard fields: {', '.join(repeated)}")
    missing = [f"{source} -> {standard}" for standard, source in wanted.items() if source not in df.columns]
    if missing:
        raise ColumnMappingError(
            f"Mapped source columns not found: {', '.join(missing)}. Columns in the table: {', '.join(df.columns)}"
        )
    taken = [
        f"{source} -> {standard}" for standard, source in wanted.items()
        if source != standard and standard in df.columns
    ]
    if taken:
        raise ColumnMappingError(f"The standard column already exists in the table: {', '.join(taken)}")
    return df.withColumnsRenamed({source: standard for standard, source in wanted.items()})


def missing_columns(df: DataFrame, required: Sequence[str] = ORDER_COLUMNS) -> list[str]:
    return [name for name in required if name not in df.columns]


def _display_name(df: DataFrame, name: str, entity: str, numeric_names: Mapping[str, bool] | None) -> Column:
    column = quoted(name)
    known = None if numeric_names is None else numeric_names.get(name, False)
    if known is None:
        return F.when(numeric_only(df, name), entity_label(column, entity)).otherwise(column.cast("string"))
    return entity_label(column, entity) if known else column


def add_revenue(
    orders: DataFrame,
    numeric_names: Mapping[str, bool] | None = None,
    day_first: bool = False,
) -> DataFrame:
    """Typed order columns, display names, the four revenue columns and ``year_month``.

    Numeric category, customer and product names become labels such as ``Category 3``, but only when every
    present value of the column is a number. That is a property of the whole column: by default a scalar
    subquery tests it, and ``numeric_names`` hands over the answer when a profile already has it.
    """
    typed = {**_typed_columns(orders, day_first), **_name_columns(orders, numeric_names)}
    return _with_revenue(orders.withColumns(typed)).withColumn("year_month", year_month(F.col("date")))


def _typed_columns(orders: DataFrame, day_first: bool = False) -> dict[str, Column]:
    kinds = {field.name: field.dataType for field in orders.schema}
    return {
        "date": parse_date(quoted("date"), kinds["date"], day_first=day_first),
        "unit_price": strict_number(quoted("unit_price"), kinds["unit_price"]),
        "quantity": strict_number(quoted("quantity"), kinds["quantity"]),
        "discount_rate": strict_number(quoted("discount_rate"), kinds["discount_rate"]),
        "returned": order_file_flag(quoted("returned"), kinds["returned"]),
    }


def _name_columns(orders: DataFrame, numeric_names: Mapping[str, bool] | None) -> dict[str, Column]:
    names = {}
    for name, (entity, fallback) in NAMES.items():
        if name in orders.columns:
            names[name] = _display_name(orders, name, entity, numeric_names)
        elif fallback is not None:
            names[name] = F.lit(fallback)
        else:
            names[name] = entity_label(quoted(name.replace("_name", "_id")), entity)
    return names


def _with_revenue(typed: DataFrame) -> DataFrame:
    price, quantity, rate = F.col("unit_price"), F.col("quantity"), F.col("discount_rate")
    sellable = (price >= 0) & (quantity > 0)
    gross = F.when(sellable, price * quantity)
    discounted = F.when(rate.between(0, 1), F.col("gross_revenue") * (1 - rate))
    return (
        typed.withColumn("gross_revenue", gross)
        .withColumn("discounted_revenue", discounted)
        .withColumns({
            "discount_amount": F.col("gross_revenue") - F.col("discounted_revenue"),
            "final_revenue": F.when(
                F.col("returned") & F.col("discounted_revenue").isNotNull(), 0.0
            ).otherwise(F.col("discounted_revenue")),
        })
    )


def numeric_name_columns(orders: DataFrame) -> dict[str, bool]:
    """The answer :func:`add_revenue` takes as ``numeric_names``, found in one pass: for rows that many tables read."""
    found = [name for name in NAMES if name in orders.columns]
    return orders.sparkSession.range(1).select(*[numeric_only(orders, name).alias(name) for name in found]).first().asDict()


def with_typed(orders: DataFrame, day_first: bool = False) -> DataFrame:
    """Order rows with their typed columns and month beside the columns as read: one table to write for both."""
    typed = orders.withColumns({f"{TYPED}{name}": column for name, column in _typed_columns(orders, day_first).items()})
    return typed.withColumn(f"{TYPED}year_month", year_month(quoted(f"{TYPED}date")))


def rows_and_revenue(
    both: DataFrame, numeric_names: Mapping[str, bool] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The rows as read and what :func:`add_revenue` makes of them, both over a written :func:`with_typed`.

    Nothing is parsed again. The revenue columns are computed as they are read: they would more than double the copy.
    """
    columns = [name for name in both.columns if not name.startswith(TYPED)]
    rows = both.select(*map(quoted, columns))
    if numeric_names is None:
        numeric_names = numeric_name_columns(rows)
    typed = {name.removeprefix(TYPED): quoted(name) for name in both.columns if name.startswith(TYPED)}
    month = typed.pop("year_month")
    names = _name_columns(rows, numeric_names)
    enriched = both.select(
        *[typed.get(name, names.get(name, quoted(name))).alias(name) for name in columns],
        *[column.alias(name) for name, column in names.items() if name not in columns], month,
    )
    return rows, _with_revenue(enriched).withColumn("year_month", month).drop(f"{TYPED}year_month")
