"""Data quality counts, reconciliation and report status."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderglass.functions.numbers import MONEY, exact_sum, money_total
from orderglass.functions.text import quoted
from orderglass.operators.checks import checks_table
from orderglass.operators.duplicates import duplicate_groups
from orderglass.operators.revenue import ORDER_COLUMNS, missing_columns

TOLERANCE = 0.01

# Checks whose issues make the report fail, and checks that only ask for a review.
CRITICAL_CHECKS = (
    "invalid_unit_price_count", "invalid_quantity_count", "invalid_discount_rate_count",
    "discount_rate_out_of_range_count", "negative_unit_price_count", "non_positive_quantity_count",
    "gross_revenue_isna_count", "discounted_revenue_isna_count", "final_revenue_isna_count",
    "invalid_revenue_row_count",
)
WARNING_CHECKS = ("invalid_date_count", "invalid_returned_count")

QUALITY_SCHEMA = "section string, metric string, value_double double, value_text string"
VALIDATION_SCHEMA = (
    "check_name string, expected_value decimal(38,6), actual_value decimal(38,6), "
    "difference decimal(38,6), status string"
)


def raw_quality(
    orders: DataFrame,
    path: str = "",
    required: Sequence[str] = ORDER_COLUMNS,
) -> DataFrame:
    """The table as read: size, repeated rows, repeated order ids, and missing cells per column."""
    columns = [name for name in orders.columns if name != "source_row_number"]
    orders = orders.select(*map(quoted, columns))
    missing = missing_columns(orders, required)
    counts = {f"null_{i}": F.count_if(quoted(name).isNull()) for i, name in enumerate(columns)}
    one_row = orders.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()])
    repeats = duplicate_groups(orders, columns).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("repeats")
    )
    if "order_id" in columns:
        ids = orders.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
        id_repeats = ids.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).scalar()
    else:
        id_repeats = F.lit(None)
    one_row = one_row.withColumns({"repeats": repeats.scalar(), "id_repeats": id_repeats})

    def row(section: str, metric: str, number: Column | None = None, text: str | None = None) -> Column:
        return F.struct(
            F.lit(section).alias("section"), F.lit(metric).alias("metric"),
            (F.lit(None) if number is None else number).cast("double").alias("value_double"),
            F.lit(text).cast("string").alias("value_text"),
        )

    rows = [
        row("file", "file_path", text=path),
        row("file", "status", text="failed" if missing else "passed"),
        row("file", "row_count", F.col("rows")),
        row("file", "column_count", F.lit(len(columns))),
        row("duplicates", "duplicate_rows", F.col("repeats")),
        row("duplicates", "repeated_order_id_rows", F.col("id_repeats")),
    ]
    rows += [row("missing_required_columns", name, text="missing") for name in missing]
    rows += [row("missing_values", name, F.col(f"null_{i}")) for i, name in enumerate(columns)]
    return one_row.select(F.inline(F.array(*rows)))


def post_quality(enriched: DataFrame) -> DataFrame:
    """Twelve counts over the converted order rows, in one pass."""
    price, quantity, rate = F.col("unit_price"), F.col("quantity"), F.col("discount_rate")
    revenue = [F.col(name).isNull() for name in ("gross_revenue", "discounted_revenue", "final_revenue")]
    return checks_table(enriched, {
        "invalid_date_count": F.col("date").isNull(),
        "invalid_unit_price_count": price.isNull(),
        "invalid_quantity_count": quantity.isNull(),
        "invalid_discount_rate_count": rate.isNull(),
        "discount_rate_out_of_range_count": (rate < 0) | (rate > 1),
        "negative_unit_price_count": price < 0,
        "non_positive_quantity_count": quantity <= 0,
        "invalid_returned_count": F.col("returned").isNull(),
        "gross_revenue_isna_count": revenue[0],
        "discounted_revenue_isna_count": revenue[1],
        "final_revenue_isna_count": revenue[2],
        "invalid_revenue_row_count": revenue[0] | revenue[1] | revenue[2],
    })


def _measure_rows(row: DataFrame, side: str, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Long form ``check_name, expected_value, actual_value`` with one of the two sides filled."""
    null = F.lit(None).cast(MONEY)
    return row.select(F.inline(F.array(*[
        F.struct(
            F.lit(name).alias("check_name"),
            (value.cast(MONEY) if side == "expected" else null).alias("expected_value"),
            (value.cast(MONEY) if side == "actual" else null).alias("actual_value"),
        )
        for name, value in checks
    ])))


def _compared(sides: Sequence[DataFrame]) -> DataFrame:
    both = reduce(DataFrame.unionByName, sides).groupBy("check_name").agg(
        F.max("expected_value").alias("expected_value"), F.max("actual_value").alias("actual_value")
    )
    difference = (F.col("actual_value") - F.col("expected_value")).cast(MONEY)
    return both.withColumn("difference", difference).withColumn(
        "status",
        F.when(F.abs("difference") <= TOLERANCE, "passed").otherwise("failed"),
    )


def reconciliation(enriched: DataFrame, monthly: DataFrame, category: DataFrame, customer: DataFrame) -> DataFrame:
    """Tie every summary back to the order rows: ten checks and the revenue without a month.

    All sums are exact, so a difference is a real gap (a null key, a dropped row), never rounding noise.
    """
    dated = F.col("year_month").isNotNull()

    def both(column: str, name: str) -> list[Column]:
        return [
            exact_sum(F.col(column)).alias(name),
            exact_sum(F.when(dated, F.col(column))).alias(f"dated_{name}"),
        ]

    detail = enriched.agg(
        *both("final_revenue", "final"), *both("gross_revenue", "gross"),
        *both("discounted_revenue", "discounted"), *both("quantity", "units"),
        exact_sum(F.when(~dated, F.col("final_revenue"))).alias("undated_final"),
    )
    c = F.col
    expected = _measure_rows(detail, "expected", [
        ("monthly_summary_revenue_equals_enriched_orders_final_revenue", c("dated_final")),
        ("monthly_discounted_revenue_equals_enriched_orders_discounted_revenue", c("dated_discounted")),
        ("category_summary_revenue_equals_enriched_orders_final_revenue", c("final")),
        ("customer_summary_revenue_equals_enriched_orders_final_revenue", c("final")),
        ("monthly_gross_revenue_equals_enriched_orders_gross_revenue", c("dated_gross")),
        ("category_gross_revenue_equals_enriched_orders_gross_revenue", c("gross")),
        ("customer_gross_revenue_equals_enriched_orders_gross_revenue", c("gross")),
        ("monthly_units_equals_enriched_orders_units", c("dated_units")),
        ("category_units_equals_enriched_orders_units", c("units")),
        ("customer_units_equals_enriched_orders_units", c("units")),
        ("invalid_date_excluded_revenue", F.lit(0)),
    ])

    def totals(summary: DataFrame) -> DataFrame:
        names = ("revenue", "gross_revenue", "units") + (("discounted_revenue",) if summary is monthly else ())
        return summary.agg(*[money_total(F.col(name)).alias(name) for name in names])

    actual = [
        _measure_rows(totals(monthly), "actual", [
            ("monthly_summary_revenue_equals_enriched_orders_final_revenue", c("revenue")),
            ("monthly_discounted_revenue_equals_enriched_orders_discounted_revenue", c("discounted_revenue")),
            ("monthly_gross_revenue_equals_enriched_orders_gross_revenue", c("gross_revenue")),
            ("monthly_units_equals_enriched_orders_units", c("units")),
        ]),
        _measure_rows(totals(category), "actual", [
            ("category_summary_revenue_equals_enriched_orders_final_revenue", c("revenue")),
            ("category_gross_revenue_equals_enriched_orders_gross_revenue", c("gross_revenue")),
            ("category_units_equals_enriched_orders_units", c("units")),
        ]),
        _measure_rows(totals(customer), "actual", [
            ("customer_summary_revenue_equals_enriched_orders_final_revenue", c("revenue")),
            ("customer_gross_revenue_equals_enriched_orders_gross_revenue", c("gross_revenue")),
            ("customer_units_equals_enriched_orders_units", c("units")),
        ]),
        _measure_rows(detail, "actual", [("invalid_date_excluded_revenue", c("undated_final"))]),
    ]
    return _compared([expected, *actual]).withColumn(
        "status", F.when(c("check_name") == "invalid_date_excluded_revenue", "info").otherwise(c("status"))
    )


def store_reconciliation(enriched: DataFrame, stores: DataFrame) -> DataFrame:
    """Two more checks when a store summary exists."""
    names = (
        "store_summary_revenue_equals_enriched_orders_final_revenue",
        "store_summary_units_equals_enriched_orders_units",
    )
    detail = enriched.agg(
        exact_sum(F.col("final_revenue")).alias("revenue"), exact_sum(F.col("quantity")).alias("units")
    )
    summed = stores.agg(money_total(F.col("revenue")).alias("revenue"), money_total(F.col("units")).alias("units"))
    values = [F.col("revenue"), F.col("units")]
    return _compared([
        _measure_rows(detail, "expected", list(zip(names, values))),
        _measure_rows(summed, "actual", list(zip(names, values))),
    ])


def report_status(
    data_quality: DataFrame,
    post: DataFrame,
    validation: DataFrame,
    expense_checks: DataFrame | None = None,
) -> DataFrame:
    """One row: ready, review_required or failed, with the counts behind it.

    One bad row may be counted by several critical checks; the count orders reports by severity, it does
    not count rows.
    """
    def tally(df: DataFrame, name: str, amount: Column) -> DataFrame:
        return df.select(F.lit(name).alias("kind"), amount.cast("bigint").alias("n"))

    parts = [
        tally(data_quality.where(F.col("section") == "missing_required_columns"), "missing", F.lit(1)),
        tally(data_quality.where(F.col("metric") == "duplicate_rows"), "warning", F.col("value_double")),
        tally(validation.where(F.col("status") == "failed"), "validation", F.lit(1)),
        tally(post.where(F.col("check_name").isin(*CRITICAL_CHECKS)), "critical", F.col("issue_count")),
        tally(post.where(F.col("check_name").isin(*WARNING_CHECKS)), "warning", F.col("issue_count")),
    ]
    if expense_checks is not None:
        parts.append(tally(expense_checks, "warning", F.col("issue_count")))
    tallies = reduce(DataFrame.unionByName, parts)

    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    counts = tallies.agg(
        total("missing").alias("missing_required_columns"),
        total("validation").alias("validation_failed_count"),
        total("critical").alias("critical_issue_count"),
        total("warning").alias("warning_count"),
    )
    def verdict(status: str, reason: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    verdicts = (
        F.when(F.col("missing_required_columns") > 0, verdict("failed", "Required columns are missing."))
        .when(F.col("validation_failed_count") > 0, verdict("failed", "One or more validation checks failed."))
        .when(
            F.col("critical_issue_count") > 0,
            verdict("failed", "Critical data quality issues affect revenue calculations."),
        )
        .when(F.col("warning_count") > 0, verdict("review_required", "Warnings exist and should be reviewed."))
        .otherwise(verdict("ready", "All validations passed and no data quality warnings were found."))
    )
    return counts.withColumn("_v", verdicts).select(
        F.col("_v.status").alias("status"), F.col("_v.reason").alias("reason"), *counts.columns
    )


def quality_checks(data_quality: DataFrame, post: DataFrame) -> DataFrame:
    """Raw and converted quality in one table; columns of the other kind stay null."""
    return data_quality.unionByName(
        post.withColumn("section", F.lit("post_conversion")), allowMissingColumns=True
    )
