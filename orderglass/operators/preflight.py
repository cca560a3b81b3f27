"""Gates between the unified order rows and the report, and the audit of what they did."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderglass.functions.text import is_present
from orderglass.operators.mapping import (
    CUSTOMER_NOT_PROVIDED, CUSTOMER_PARTIAL, REQUIRED_FIELDS, RETURN_NOT_PROVIDED,
)

BLOCK, EXCLUDE_FROM_MONTHLY = "block", "exclude_from_monthly"
PRICE_REASON = "unit_price is missing, non-numeric, or negative"
QUANTITY_REASON = "quantity is missing, non-numeric, or not positive"
DATE_REASON = "date could not be parsed"
PREVIEW_COLUMNS = ("order_id", "date", "unit_price", "quantity", "discount_rate")
ISSUE_SCHEMA = "code string, field string, severity string, affected_row_count bigint, message string, excludable boolean"
AUDIT_SCHEMA = "section string, item string, value_double double, value_text string, notes string"


def _bad_price() -> Column:
    return ~F.coalesce(F.col("unit_price") >= 0, F.lit(False))


def _bad_quantity() -> Column:
    return ~F.coalesce(F.col("quantity") > 0, F.lit(False))


def _bad_row() -> Column:
    return _bad_price() | _bad_quantity()


def _reason() -> Column:
    return F.concat_ws("; ", F.when(_bad_price(), PRICE_REASON), F.when(_bad_quantity(), QUANTITY_REASON))


def excluded_rows(unified: DataFrame) -> DataFrame:
    """Rows without a usable price or quantity, each with its reasons."""
    return unified.where(_bad_row()).select(
        "unified_row_number", F.col("order_id").cast("string").alias("order_id"), _reason().alias("exclusion_reason")
    )


def kept_rows(unified: DataFrame) -> DataFrame:
    return unified.where(~_bad_row())


def issue_preview(unified: DataFrame, condition: Column, reason: Column, limit: int = 20) -> DataFrame:
    """The first bad rows by row number, for display; the counts and the exclusion list are complete."""
    shown = [name for name in PREVIEW_COLUMNS if name in unified.columns]
    return unified.where(condition).select(
        "unified_row_number", *shown, reason.alias("reason")
    ).orderBy("unified_row_number").limit(limit)


def price_quantity_preview(unified: DataFrame, limit: int = 20) -> DataFrame:
    return issue_preview(unified, _bad_row(), _reason(), limit)


def date_preview(unified: DataFrame, limit: int = 20) -> DataFrame:
    return issue_preview(unified, F.col("date").isNull(), F.lit(DATE_REASON), limit)


def preflight_counts(unified: DataFrame, exclude_bad_rows: bool = False) -> DataFrame:
    """One row of counts behind all gates; the gates after the exclusion only see the kept rows."""
    kept = ~_bad_row() if exclude_bad_rows else F.lit(True)
    rate = F.col("discount_rate")
    nulls = [
        F.count_if(kept & F.col(name).isNull()).alias(f"null_{name}")
        for name in REQUIRED_FIELDS if name in unified.columns
    ]
    return unified.agg(
        F.count(F.lit(1)).alias("unified_row_count"),
        F.count_if(_bad_row()).alias("bad_price_or_quantity"),
        F.count_if(kept).alias("calculation_row_count"),
        F.count_if(kept & ~is_present(F.col("order_id"))).alias("bad_order_id"),
        F.count_if(kept & ~F.coalesce(rate.between(0, 1), F.lit(False))).alias("bad_discount_rate"),
        F.count_if(kept & F.col("date").isNull()).alias("bad_date"),
        F.count_if(kept & F.col("returned").isNull()).alias("unknown_returned"),
        F.count_if(kept & F.col("returned").isNotNull()).alias("known_returned"),
        F.min(F.when(kept, F.col("date"))).alias("date_min"),
        F.max(F.when(kept, F.col("date"))).alias("date_max"),
        *nulls,
    )


@dataclass
class Preflight:
    """``rows`` holds the calculation rows even when the report cannot be generated."""

    can_generate: bool
    rows: DataFrame
    issues: DataFrame
    warnings: list[str]
    excluded: DataFrame
    price_quantity_preview: DataFrame
    date_preview: DataFrame
    counts: dict
    monthly_excluded_row_count: int


def run_preflight(
    unified: DataFrame,
    availability: Mapping[str, str],
    invalid_dates: str = BLOCK,
    exclude_bad_rows: bool = False,
    availability_notes: Mapping[str, str] | None = None,
) -> Preflight:
    """Decide whether the report may run. No row disappears unless the caller asked for it, and then with a reason.

    ``unified`` needs a ``unified_row_number``; ``availability`` is field name -> status.
    """
    if invalid_dates not in (BLOCK, EXCLUDE_FROM_MONTHLY):
        raise ValueError(f"Unknown invalid date action: {invalid_dates!r}")
    spark = unified.sparkSession
    n = preflight_counts(unified, exclude_bad_rows).first().asDict()
    issues: list[tuple] = []
    warnings: list[str] = []

    def critical(code: str, field: str, count: int, message: str, excludable: bool = False) -> None:
        issues.append((code, field, "critical", count, message, excludable))

    if n["bad_price_or_quantity"] and exclude_bad_rows:
        warnings.append(f"{n['bad_price_or_quantity']:,} row(s) were explicitly excluded from all report calculations.")
    elif n["bad_price_or_quantity"]:
        critical("invalid_price_or_quantity", "unit_price, quantity", n["bad_price_or_quantity"],
                 "Invalid unit_price or quantity rows must be fixed or explicitly excluded.", True)
    if n["bad_order_id"]:
        critical("invalid_order_id", "order_id", n["bad_order_id"],
                 "order_id contains missing or empty values and cannot be reported.")
    if n["bad_discount_rate"]:
        critical("invalid_discount_rate", "discount_rate", n["bad_discount_rate"],
                 "discount_rate must be present and within 0-1 for every calculation row.")
    if n["bad_date"] and invalid_dates == BLOCK:
        critical("invalid_date_decision_required", "date", n["bad_date"],
                 "Invalid dates require an explicit decision before report generation.")
    elif n["bad_date"]:
        warnings.append(f"{n['bad_date']:,} row(s) will be excluded from monthly analysis only.")
    returned = availability.get("returned", "provided")
    if returned in ("not_provided", "not_applicable"):
        if n["known_returned"]:
            critical("returned_availability_mismatch", "returned", n["known_returned"],
                     f"returned is marked {returned} but contains non-null values.")
        elif returned == "not_provided":
            warnings.append(RETURN_NOT_PROVIDED)
    elif n["unknown_returned"]:
        warnings.append(f"returned contains {n['unknown_returned']:,} unknown value(s).")
    customer = availability.get("customer_id", "provided")
    note = (availability_notes or {}).get("customer_id", "")
    if customer == "not_provided":
        warnings.append(CUSTOMER_NOT_PROVIDED)
    elif customer == "partially_provided":
        warnings += [text for text in (CUSTOMER_PARTIAL, note) if text]
    elif customer == "mapping_conflict":
        warnings.append(note or "Customer field mapping conflict. Customer analysis was skipped.")
    warnings += [
        f"Optional descriptive field {name} is unavailable."
        for name in ("customer_name", "product_name", "category") if name not in unified.columns
    ]
    if not n["calculation_row_count"]:
        critical("no_calculation_rows", "dataset", 0, "No rows remain for report calculations.")
    excluded = excluded_rows(unified)
    return Preflight(
        can_generate=not issues,
        rows=kept_rows(unified) if exclude_bad_rows else unified,
        issues=spark.createDataFrame(issues, ISSUE_SCHEMA),
        warnings=list(dict.fromkeys(warnings)),
        excluded=excluded if exclude_bad_rows else excluded.where(F.lit(False)),
        price_quantity_preview=price_quantity_preview(unified),
        date_preview=date_preview(kept_rows(unified) if exclude_bad_rows else unified),
        counts=n,
        monthly_excluded_row_count=n["bad_date"] if invalid_dates == EXCLUDE_FROM_MONTHLY else 0,
    )


def preparation_audit(
    fact_table: str,
    preflight: Preflight,
    availability: DataFrame,
    original_rows: int | None = None,
    merged_rows: int | None = None,
    approved: Sequence[tuple[str, str, str]] = (),
    rejected: Sequence[tuple[str, str, str]] = (),
) -> DataFrame:
    """What happened before the report: row counts, joins, mappings, exclusions by reason.

    ``approved`` and ``rejected`` list relationships as (item, value, notes).
    """
    spark, n = availability.sparkSession, preflight.counts
    unified = n["unified_row_count"]
    excluded = unified - n["calculation_row_count"]
    rows = [("fact_table", "selected_fact_table", None, fact_table, fact_table)]
    rows += [("row_counts", item, float(count), None, notes) for item, count, notes in (
        ("original_fact_rows", unified if original_rows is None else original_rows, "Before approved joins."),
        ("merged_dataset_rows", unified if merged_rows is None else merged_rows, "After safe many-to-one joins."),
        ("unified_orders_rows", unified, "Before explicit report exclusions."),
        ("excluded_rows", excluded, "Explicitly excluded from all calculations."),
        ("monthly_analysis_excluded_rows", preflight.monthly_excluded_row_count,
         "Invalid-date rows retained elsewhere but excluded from monthly analysis."),
        ("final_calculation_rows", n["calculation_row_count"], "Rows passed to the report."),
    )]
    rows += [("approved_relationship", item, None, value, notes) for item, value, notes in approved]
    rows += [("rejected_relationship", item, None, value, notes) for item, value, notes in rejected]
    fixed = spark.createDataFrame(rows, AUDIT_SCHEMA)
    mapped = availability.select(
        F.lit("field_mapping").alias("section"), F.col("field_name").alias("item"),
        F.lit(None).cast("double").alias("value_double"),
        F.coalesce("source_column", "availability_status").alias("value_text"), "notes",
    )
    reasons = preflight.excluded.groupBy("exclusion_reason").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("excluded_rows").alias("section"), F.col("exclusion_reason").alias("item"),
        F.col("n").cast("double").alias("value_double"), F.lit(None).cast("string").alias("value_text"),
        F.lit("User-confirmed exclusion.").alias("notes"),
    )
    return fixed.unionByName(mapped).unionByName(reasons)


def drop_selected_rows(orders: DataFrame, selected: DataFrame) -> DataFrame:
    """Orders without the source rows a reviewer picked (``source_row_number`` in ``selected``)."""
    return orders.join(selected.select("source_row_number").distinct(), "source_row_number", "left_anti")
