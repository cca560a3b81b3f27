"""Whole reports: the plain order report and the report over mapped, joined tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderglass.functions.numbers import MONEY
from orderglass.operators.anomalies import ANOMALY_SCHEMA, detect_anomalies
from orderglass.operators.duplicates import duplicate_rows, repeated_order_id_rows, repeated_order_ids
from orderglass.operators.facts import headline_facts
from orderglass.operators.finance import finance_tables
from orderglass.operators.mapping import (
    AVAILABILITY_SCHEMA, STORE_BY_NAME, STORE_NOT_PROVIDED, STORE_PARTIAL, FieldChoice, conversion_diagnostics,
    entity_conflict, field_availability, report_coverage, store_coverage_note, unified_orders,
)
from orderglass.operators.preflight import BLOCK, Preflight, preparation_audit, run_preflight
from orderglass.operators.quality import (
    VALIDATION_SCHEMA, post_quality, raw_quality, reconciliation, report_status, store_reconciliation,
)
from orderglass.operators.revenue import add_revenue, missing_columns, numeric_name_columns
from orderglass.operators.summary import order_summaries, store_status, store_summary
from orderglass.session import stage, stage_parts
from orderglass.sources.sink import visible, write_report
from orderglass.sources.tables import read_expenses, read_orders

Tables = dict[str, DataFrame]
CUSTOMER_CHECKS = (
    "customer_summary_revenue_equals_enriched_orders_final_revenue",
    "customer_gross_revenue_equals_enriched_orders_gross_revenue",
    "customer_units_equals_enriched_orders_units",
)


class ReportError(RuntimeError):
    """The report cannot be generated from this input."""


def order_report(
    orders: DataFrame, expenses: DataFrame | None = None, orders_path: str = "", expenses_path: str = "",
    numeric_names: Mapping[str, bool] | None = None, written: bool = False,
) -> Tables:
    """All tables of the plain report. ``orders`` needs a ``source_row_number`` for the duplicate tables.

    The enriched rows are written once and every table reads that copy, so the source is parsed a single time
    and each summary scans just its own columns. ``written`` says that ``orders`` are typed rows over a written copy
    already; a second copy is not made then. With required columns missing, all tables exist but are empty and the
    status says why.
    """
    spark = orders.sparkSession
    quality = raw_quality(orders, orders_path)
    if missing_columns(orders):
        post = spark.createDataFrame([], "check_name string, issue_count bigint, status string")
        validation = spark.createDataFrame([], VALIDATION_SCHEMA)
        empty = spark.createDataFrame([], "year_month string, revenue decimal(38,6)")
        finance = finance_tables(empty, None, expenses_path)
        return {
            **{name: spark.createDataFrame([], "year_month string") for name in (
                "enriched_orders", "monthly_summary", "category_summary", "customer_summary", "top_products")},
            "data_quality": quality,
            "post_conversion_data_quality": post,
            "validation_report": validation,
            "report_status": report_status(quality, post, validation),
            "duplicate_rows_detail": spark.createDataFrame(
                [], "duplicate_group_id bigint, source_row_number bigint, duplicate_group_count bigint, "
                "duplicate_row_count bigint"),
            "repeated_order_id_detail": spark.createDataFrame(
                [], "order_id string, occurrence_count bigint, rows_are_fully_identical boolean, note string"),
            "repeated_order_id_rows": spark.createDataFrame([], "order_id string, source_row_number bigint"),
            "anomalies": spark.createDataFrame([], ANOMALY_SCHEMA),
            **finance,
        }
    if written:
        known = numeric_name_columns(orders) if numeric_names is None else numeric_names
        return enriched_report(add_revenue(orders, known), quality, expenses, expenses_path)
    return enriched_report(stage(add_revenue(orders, numeric_names), "enriched"), quality, expenses, expenses_path)


def enriched_report(
    enriched: DataFrame, quality: DataFrame, expenses: DataFrame | None = None, expenses_path: str = "",
    stores: bool = False,
) -> Tables:
    """All tables over written order rows and the quality of the rows as read.

    What other tables are made of (summaries, checks, findings, cash flow) is written once and read from there, so
    the status, the reconciliation and the headline facts touch small tables only. The duplicate tables exist where
    the rows carry a ``source_row_number``.
    """
    summaries = order_summaries(enriched, stores)
    monthly, category, customer = (
        summaries[name] for name in ("monthly_summary", "category_summary", "customer_summary")
    )
    quality = stage(quality, "quality")
    post = stage(post_quality(enriched), "post-quality")
    validation = stage(reconciliation(enriched, monthly, category, customer), "validation")
    finance = finance_tables(monthly, expenses, expenses_path)
    duplicates = {
        "duplicate_rows_detail": duplicate_rows(enriched),
        "repeated_order_id_detail": repeated_order_ids(enriched),
        "repeated_order_id_rows": repeated_order_id_rows(enriched),
    } if "source_row_number" in enriched.columns else {}
    return {
        "data_quality": quality,
        "enriched_orders": enriched,
        **duplicates,
        "post_conversion_data_quality": post,
        **summaries,
        "anomalies": stage(detect_anomalies(enriched, monthly), "anomalies"),
        "validation_report": validation,
        "report_status": report_status(quality, post, validation, finance["expense_post_conversion_quality"]),
        **finance,
    }


def run_report(
    spark: SparkSession,
    orders_path: str,
    expenses_path: str | None = None,
    output: str | None = None,
    orders_columns: Mapping[str, str | None] | None = None,
    expenses_columns: Mapping[str, str | None] | None = None,
    transform: Callable[[Tables], Tables] | None = None,
    **read_options,
) -> Tables:
    """Read, compute and (with ``output``) write the plain report; ``transform`` may change the tables first."""
    orders = read_orders(spark, orders_path, orders_columns, **read_options)
    expenses = read_expenses(spark, expenses_path, expenses_columns, **read_options)
    tables = order_report(orders, expenses, orders_path, expenses_path or "")
    if transform is not None:
        tables = transform(tables)
    if output is not None:
        tables = written_report(tables, output)
    if not missing_columns(orders):
        tables["headline_facts"] = headline_facts(tables)
        if output is not None:
            write_report({"headline_facts": tables["headline_facts"]}, output)
    return tables


def written_report(tables: Tables, output: str) -> Tables:
    """Write the tables and return them as written, so that later readers do not compute them again."""
    spark = tables["enriched_orders"].sparkSession
    names = write_report(tables, output)
    read = {name: spark.read.schema(visible(tables[name]).schema).parquet(f"{output.rstrip('/')}/{name}") for name in names}
    return {**tables, **read}


def final_store_availability(availability: DataFrame, enriched: DataFrame) -> DataFrame:
    """Availability with the store record recomputed over the rows the report really used."""
    c = F.col
    mapped = availability.where(c("field_name") == "store_analysis")
    before = mapped.agg(
        F.max("availability_status").alias("s"), F.max("notes").alias("n"), F.max("source_column").alias("src"),
        F.coalesce(F.bool_and("user_confirmed"), F.lit(True)).alias("ok"),
    )
    conflict = F.coalesce(c("s") == "mapping_conflict", F.lit(False))
    coverage = store_coverage_note(c("provided_row_count"), c("total_row_count"))
    notes = (
        F.when(c("availability_status") == "not_provided", STORE_NOT_PROVIDED)
        .when(c("availability_status") == "partially_provided", F.concat(F.lit(STORE_PARTIAL + " "), coverage))
        .otherwise(coverage)
    )
    notes = F.when(c("grouped_by_name"), F.concat(notes, F.lit(" " + STORE_BY_NAME))).otherwise(notes)
    columns = {name: before.select(name).scalar() for name in ("s", "n", "src", "ok")}
    record = store_status(enriched).withColumns(columns).select(
        F.lit("store_analysis").alias("field_name"),
        F.when(conflict, c("s")).otherwise(c("availability_status")).alias("availability_status"),
        c("src").alias("source_column"),
        F.lit(None).cast("double").alias("default_value"),
        c("ok").alias("user_confirmed"),
        F.when(conflict, c("n")).otherwise(notes).alias("notes"),
        F.when(conflict, F.lit(0)).otherwise(c("provided_row_count")).cast("bigint").alias("provided_row_count"),
        c("total_row_count"),
    )
    names = [part.split(" ")[0] for part in AVAILABILITY_SCHEMA.split(", ")]
    others = availability.where(c("field_name") != "store_analysis")
    return others.select(*names).unionByName(record.select(*names))


def adapt_to_availability(tables: Tables, availability: DataFrame) -> Tables:
    """Switch off what the data cannot support and say so, instead of reporting zeros.

    The availability table has one row per field; it is the only thing read here on the driver.
    """
    tables, c = dict(tables), F.col
    enriched = tables["enriched_orders"]
    spark = enriched.sparkSession
    rows = final_store_availability(availability, enriched).collect()
    availability = spark.createDataFrame(rows, AVAILABILITY_SCHEMA)
    status = {row["field_name"]: row["availability_status"] for row in rows}
    tables["field_availability"] = availability
    tables["report_coverage"] = report_coverage(availability)
    adapted = False

    if status.get("store_analysis", "provided") in ("provided", "partially_provided"):
        tables["store_summary"] = stage_parts([store_summary(enriched)], "stores").orderBy(F.desc("revenue"), "_group")
        tables["validation_report"] = tables["validation_report"].unionByName(
            store_reconciliation(enriched, tables["store_summary"])
        )
        adapted = True

    if status.get("customer_id", "provided") != "provided":
        tables["customer_summary"] = tables["customer_summary"].limit(0)
        off = c("check_name").isin(*CUSTOMER_CHECKS)
        null = F.lit(None).cast(MONEY)
        tables["validation_report"] = tables["validation_report"].withColumns({
            **{name: F.when(~off, c(name)).otherwise(null) for name in (
                "expected_value", "actual_value", "difference")},
            "status": F.when(off, "not_applicable").otherwise(c("status")),
        })
        adapted = True

    returned = status.get("returned", "provided")
    if returned in ("not_provided", "not_applicable"):
        invalid = c("check_name") == "invalid_returned_count"
        extra = spark.createDataFrame([(
            "return_analysis_not_applicable" if returned == "not_applicable" else "return_analysis_not_available",
            0, "not_applicable" if returned == "not_applicable" else "not_available",
        )], "check_name string, issue_count bigint, status string")
        tables["post_conversion_data_quality"] = tables["post_conversion_data_quality"].withColumns({
            "issue_count": F.when(invalid, 0).otherwise(c("issue_count")),
            "status": F.when(invalid, "not_applicable").otherwise(c("status")),
        }).unionByName(extra)
        for name in ("monthly_summary", "category_summary", "customer_summary", "top_products"):
            if name in tables and "return_rate" in tables[name].columns:
                tables[name] = tables[name].drop("return_rate") if returned == "not_applicable" else (
                    tables[name].withColumn("return_rate", F.lit(None).cast("double"))
                )
        tables["anomalies"] = tables["anomalies"].where(c("anomaly_type") != "return_rate_over_15_percent")
        adapted = True

    if adapted:
        overall = report_status(
            tables["data_quality"], tables["post_conversion_data_quality"], tables["validation_report"],
            tables["expense_post_conversion_quality"],
        )
        if status.get("customer_id") == "mapping_conflict":
            review = c("status") != "failed"
            overall = overall.withColumns({
                "reason": F.when(review, "Customer field mapping conflict; customer analysis was skipped.").otherwise(
                    c("reason")),
                "warning_count": c("warning_count") + F.when(review, 1).otherwise(0),
                "status": F.when(review, "review_required").otherwise(c("status")),
            })
        tables["report_status"] = overall
    return tables


def mapped_report(
    source: DataFrame,
    choices: Sequence[FieldChoice],
    expenses: DataFrame | None = None,
    extensions: Sequence[str] = (),
    entities: Mapping[str, str] | None = None,
    invalid_dates: str = BLOCK,
    exclude_bad_rows: bool = False,
    fact_table: str = "",
    original_rows: int | None = None,
    merged_rows: int | None = None,
    approved: Sequence[tuple[str, str, str]] = (),
    rejected: Sequence[tuple[str, str, str]] = (),
    expenses_path: str = "",
) -> tuple[Tables, Preflight]:
    """The report over a joined table and a confirmed field mapping.

    ``source`` carries a ``source_row_number``. Blocked conversions and unresolved preflight issues raise
    :class:`ReportError`; nothing is dropped to get past them.
    """
    blocked = [
        row["standard_field"]
        for row in conversion_diagnostics(source, choices).where("status = 'blocked'").collect()
    ]
    if blocked:
        raise ReportError(f"Field conversion is blocked for: {', '.join(blocked)}")
    unified = unified_orders(source, choices, extensions, carry=["source_row_number"])
    # The written copy keeps its types: ids stay text, nothing is parsed a second time.
    unified = stage(unified.withColumn("unified_row_number", F.col("source_row_number") - 1), "unified")
    issues = (entity_conflict(entity, choices, entities) for entity in ("customer", "store"))
    availability = field_availability(unified, choices, *issues)
    found = availability.collect()
    preflight = run_preflight(
        unified, {row["field_name"]: row["availability_status"] for row in found}, invalid_dates, exclude_bad_rows,
        {row["field_name"]: row["notes"] for row in found},
    )
    if not preflight.can_generate:
        messages = [row["message"] for row in preflight.issues.select("message").collect()]
        raise ReportError(" ".join(messages))
    rows = preflight.rows.drop("unified_row_number")
    if "customer_id" not in rows.columns:
        rows = rows.withColumn("customer_id", F.lit(None).cast("string"))
    availability = availability.sparkSession.createDataFrame(found, AVAILABILITY_SCHEMA)
    tables = adapt_to_availability(order_report(rows, expenses, fact_table, expenses_path), availability)
    tables["data_preparation_summary"] = preparation_audit(
        fact_table, preflight, tables["field_availability"], original_rows, merged_rows, approved, rejected
    )
    tables["excluded_rows_detail"] = preflight.excluded
    return tables, preflight
