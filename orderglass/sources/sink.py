"""Writing a finished report."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tables of every report, in reading order, and those a mapped report adds.
REPORT_TABLES = (
    "report_status", "data_quality", "post_conversion_data_quality", "validation_report", "duplicate_rows_detail",
    "repeated_order_id_detail", "repeated_order_id_rows", "enriched_orders", "monthly_summary", "category_summary",
    "customer_summary", "top_products", "anomalies", "finance_status", "expense_post_conversion_quality", "finance_kpis",
    "expenses_enriched", "cash_flow_summary", "expense_category_breakdown", "largest_expense_categories",
    "cash_flow_warnings",
)
MAPPED_TABLES = ("data_preparation_summary", "field_availability", "report_coverage", "excluded_rows_detail")
OPTIONAL_TABLES = ("store_summary", "headline_facts")
MANIFEST = "version,published_at,names,schemas"


def visible(df: DataFrame) -> DataFrame:
    """``df`` without helper columns, whose names start with an underscore."""
    return df.select(*[f"`{column}`" for column in df.columns if not column.startswith("_")])


def write_report(tables: Mapping[str, DataFrame], folder: str, file_format: str = "parquet") -> list[str]:
    """One folder per table; returns the names written. Helper columns (leading underscore) stay out.

    A report without usable customer data has no customer table.
    """
    written, skipped = [], set()
    availability = tables.get("field_availability")
    if availability is not None and not availability.where(
        "field_name = 'customer_id' AND availability_status <> 'provided'"
    ).isEmpty():
        skipped.add("customer_summary")
    for name in (*REPORT_TABLES, *MAPPED_TABLES, *OPTIONAL_TABLES):
        df = tables.get(name)
        if df is None or name in skipped:
            continue
        visible(df).write.mode("overwrite").format(file_format).save(f"{folder.rstrip('/')}/{name}")
        written.append(name)
    return written


def publish_report(tables: Mapping[str, DataFrame], folder: str) -> str:
    """Write a report that readers see as a whole or not at all; returns its version.

    The tables go to a folder of their own, then one line that names them is appended to the manifest. A run that ends
    before that line leaves the report before it as the one :func:`published_report` reads. Nothing is overwritten.
    """
    spark = next(iter(tables.values())).sparkSession
    folder, version = folder.rstrip("/"), uuid.uuid4().hex
    names = write_report(tables, f"{folder}/versions/{version}")
    schemas = [visible(tables[name]).schema.json() for name in names]
    line = spark.createDataFrame(
        [(version, names, schemas)], "version string, names array<string>, schemas array<string>"
    ).withColumn("published_at", F.current_timestamp())
    # One file from one task: it is there as a whole or not at all.
    line.select(*MANIFEST.split(",")).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return version


def published_report(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the report that was published last; of two at one time, the one with the larger version."""
    folder = folder.rstrip("/")
    lines = spark.read.parquet(f"{folder}/manifest")
    last = lines.orderBy(F.desc("published_at"), F.desc("version")).first()
    return {
        name: spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(
            f"{folder}/versions/{last['version']}/{name}")
        for name, schema in zip(last["names"], last["schemas"])
    }
