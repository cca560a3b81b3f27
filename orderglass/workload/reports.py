"""Registered queries over summaries, quality, finance and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderglass.operators import anomalies as an
from orderglass.operators import duplicates as du
from orderglass.operators import finance as fi
from orderglass.operators import quality as qu
from orderglass.operators import summary as su
from orderglass.operators.revenue import add_revenue
from orderglass.session import stage
from orderglass.workload import inputs as io
from orderglass.workload.inputs import plain

# Discounts in the benchmark tables stop at 10 %, so the discount rule runs with a lower bar.
DISCOUNT_BAR = 0.08


def enriched_orders(spark, d):
    return plain(add_revenue(io.order_rows(spark, d)).drop("product_name", "customer_name"))


def dirty_enriched_orders(spark, d):
    return plain(io.dirty_enriched_rows(spark, d).select(
        "source_row_number", "order_id", "date", "category", "customer_name", "unit_price", "quantity",
        "discount_rate", "returned", "gross_revenue", "discounted_revenue", "final_revenue", "year_month",
    ))


def monthly_summary(spark, d):
    return plain(su.monthly_summary(io.enriched_rows(spark, d)))


def monthly_growth(spark, d):
    return plain(su.monthly_summary(io.enriched_rows(spark, d)).select(
        "year_month", "revenue", "previous_revenue", "revenue_growth_amount", "revenue_growth_rate",
        su.growth_is_meaningful().alias("growth_is_meaningful"),
    ))


def dirty_monthly_summary(spark, d):
    return plain(su.monthly_summary(io.dirty_enriched_rows(spark, d)).drop("average_discount_rate"))


def period_coverage(spark, d):
    orders = io.table(spark, d, "orders").select(
        F.col("o_orderdate").alias("date"), F.date_format("o_orderdate", "yyyy-MM").alias("year_month")
    )
    return plain(su.period_coverage(orders))


def category_summary(spark, d):
    return plain(su.category_summary(io.enriched_rows(spark, d)))


def dirty_category_summary(spark, d):
    return plain(su.category_summary(io.dirty_enriched_rows(spark, d)).drop("average_discount_rate"))


def customer_summary(spark, d):
    return plain(su.customer_summary(io.enriched_rows(spark, d, customer=True)))


def top_customers(spark, d):
    summary = su.customer_summary(io.enriched_rows(spark, d, customer=True), ordered=False)
    return plain(su.top_rows(summary, ["customer_id"], 10).select("customer_id", "customer_name", "revenue"))


def top_products(spark, d):
    return plain(su.top_products(io.enriched_rows(spark, d)))


def store_summary(spark, d):
    return plain(su.store_summary(io.enriched_rows(spark, d, store=True)).drop("_group"))


def _partly_assigned(spark, d):
    orders = io.enriched_rows(spark, d, store=True, numbered=True)
    shop = F.col("store_id")
    return orders.withColumns({
        "store_id": F.when(shop % 5 == 1, F.concat(shop.cast("string"), F.lit(".0"))).when(
            shop % 5 > 1, shop.cast("string")
        ),
        "store_name": F.when(shop % 10 != 0, F.col("store_name")).otherwise(" "),
    })


def store_summary_partial(spark, d):
    return plain(su.store_summary(_partly_assigned(spark, d)).drop("_group"))


def assigned_stores(spark, d):
    return plain(su.assigned_stores(su.store_summary(_partly_assigned(spark, d))).drop("_group"))


def store_status(spark, d):
    return su.store_status(_partly_assigned(spark, d))


def raw_quality(spark, d):
    return qu.raw_quality(io.staged_dirty_rows(spark, d), path="orders")


def post_quality(spark, d):
    return qu.post_quality(io.dirty_enriched_rows(spark, d))


def quality_checks(spark, d):
    rows = io.staged_dirty_rows(spark, d)
    return qu.quality_checks(
        qu.raw_quality(rows, path="orders"), qu.post_quality(add_revenue(rows, numeric_names=io.TEXT_NAMES))
    )


def _staged_dirty(spark, d):
    """Enriched rows that several summaries read: parsed and written once, as the report does it."""
    return stage(io.dirty_enriched_rows(spark, d), "enriched")


def _reconciled(enriched):
    return qu.reconciliation(
        enriched, su.monthly_summary(enriched), su.category_summary(enriched, ordered=False),
        su.customer_summary(enriched, ordered=False),
    )


def reconciliation(spark, d):
    return plain(_reconciled(_staged_dirty(spark, d)))


def store_reconciliation(spark, d):
    orders = _partly_assigned(spark, d)
    return plain(qu.store_reconciliation(orders, su.store_summary(orders, ordered=False)))


def report_status(spark, d):
    rows = io.staged_dirty_rows(spark, d)
    enriched = stage(add_revenue(rows, numeric_names=io.TEXT_NAMES), "enriched")
    return qu.report_status(
        qu.raw_quality(rows), qu.post_quality(enriched), _reconciled(enriched),
        fi.expense_quality(io.dirty_prepared_expenses(spark, d)),
    )


def duplicate_rows(spark, d):
    return plain(du.duplicate_rows(io.repeated_rows(spark, d)))


def repeated_order_ids(spark, d):
    return du.repeated_order_ids(io.repeated_rows(spark, d)).drop("note")


def repeated_order_id_rows(spark, d):
    return du.repeated_order_id_rows(io.repeated_rows(spark, d))


def sales_drops(spark, d):
    return an.sales_drops(su.monthly_summary(io.enriched_rows(spark, d)))


def high_returns(spark, d):
    return an.high_returns(su.monthly_summary(io.enriched_rows(spark, d)))


def high_discounts(spark, d):
    return an.high_discounts(io.enriched_rows(spark, d), DISCOUNT_BAR).select(
        "anomaly_type", "anomaly_label", "level", "period", "order_id", "metric_value", "threshold", "details"
    )


def anomalies(spark, d):
    enriched = _staged_dirty(spark, d)
    return an.anomaly_counts(an.detect_anomalies(enriched, su.monthly_summary(enriched)))


def prepared_expenses(spark, d):
    return plain(io.dirty_prepared_expenses(spark, d))


def expense_quality(spark, d):
    return fi.expense_quality(io.dirty_prepared_expenses(spark, d))


def expense_breakdown(spark, d):
    return plain(fi.expense_breakdown(io.dirty_prepared_expenses(spark, d)))


def largest_expense_categories(spark, d):
    return plain(fi.largest_expense_categories(fi.expense_breakdown(io.prepared_expenses(spark, d), ordered=False)))


def _flow(spark, d, dirty=False):
    expenses = io.dirty_prepared_expenses(spark, d) if dirty else io.prepared_expenses(spark, d)
    return fi.cash_flow_summary(su.monthly_summary(io.enriched_rows(spark, d)), expenses)


def cash_flow(spark, d):
    return plain(_flow(spark, d))


def cash_flow_overlapping(spark, d):
    return plain(_flow(spark, d, dirty=True))


def cash_flow_warnings(spark, d):
    return fi.cash_flow_warnings(_flow(spark, d, dirty=True))


def cash_flow_long(spark, d):
    return plain(fi.cash_flow_long(_flow(spark, d)))


def finance_kpis(spark, d):
    return fi.finance_kpis(_flow(spark, d), fi.expense_breakdown(io.prepared_expenses(spark, d), ordered=False))


def finance_status(spark, d):
    return fi.finance_status(io.dirty_expense_rows(spark, d), path="expenses")


QUERIES = {
    f.__name__: f
    for f in (
        enriched_orders, dirty_enriched_orders, monthly_summary, monthly_growth, dirty_monthly_summary,
        period_coverage, category_summary, dirty_category_summary, customer_summary, top_customers, top_products,
        store_summary, store_summary_partial, assigned_stores, store_status, raw_quality, post_quality,
        quality_checks, reconciliation, store_reconciliation, report_status, duplicate_rows, repeated_order_ids,
        repeated_order_id_rows,
        sales_drops, high_returns, high_discounts, anomalies, prepared_expenses, expense_quality,
        expense_breakdown, largest_expense_categories, cash_flow, cash_flow_overlapping, cash_flow_warnings,
        cash_flow_long, finance_kpis, finance_status,
    )
}
