"""Headline facts, dashboard indicators, actions and limitations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderglass.functions.numbers import exact_sum, money_total, safe_divide
from orderglass.operators.mapping import CUSTOMER_NOT_PROVIDED, CUSTOMER_PARTIAL
from orderglass.operators.summary import assigned_stores, complete_months

FACT_SCHEMA = "section string, metric string, label string, value_double double, value_text string"


def _fact(section: str, metric: str, label: Column | None = None, number: Column | None = None,
          text: Column | None = None) -> Column:
    def typed(column: Column | None, kind: str) -> Column:
        return (F.lit(None) if column is None else column).cast(kind)

    return F.struct(
        F.lit(section).alias("section"), F.lit(metric).alias("metric"), typed(label, "string").alias("label"),
        typed(number, "double").alias("value_double"), typed(text, "string").alias("value_text"),
    )


def _facts(row: DataFrame, *facts: Column) -> DataFrame:
    return row.select(F.inline(F.array(*facts)))


def _best(df: DataFrame, label: str, amount: str, lowest: bool = False) -> DataFrame:
    """One row: the label with the largest (or smallest) amount; ties go to the first label."""
    value = F.col(amount).cast("decimal(38,6)") if dict(df.dtypes)[amount].startswith("decimal") else F.col(amount)
    rank = F.struct((value if lowest else -value).alias("v"), F.col(label).alias("l"))
    best = df.where(F.col(amount).isNotNull()).agg(F.min_by(F.struct(label, amount), rank).alias("b"))
    return best.select(F.col(f"b.{label}").alias("label"), F.col(f"b.{amount}").alias("amount"))


SECTIONS = ("executive", "business", "status", "quality", "validation", "finance", "anomaly")


def _extreme(df: DataFrame, section: str, metric: str, label: str, amount: str, lowest: bool = False) -> DataFrame:
    found = _best(df, label, amount, lowest).where("label is not null")
    return _facts(found, _fact(section, metric, F.col("label"), F.col("amount")))


def _executive(tables: Mapping[str, DataFrame]) -> list[DataFrame]:
    """Totals come from the monthly table: undated rows are out, an order in two months counts in both."""
    monthly, c = tables["monthly_summary"], F.col
    complete = complete_months(monthly)
    totals = monthly.agg(
        money_total(c("revenue")).alias("revenue"), money_total(c("gross_revenue")).alias("gross"),
        money_total(c("discount_amount")).alias("discount"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"),
        money_total(c("units")).alias("units"),
    )
    from_nothing = (c("previous_revenue") == 0) & (c("revenue") != 0)
    return [
        _facts(
            totals,
            _fact("executive", "dated_revenue", number=c("revenue")),
            _fact("executive", "dated_orders", number=c("orders")),
            _fact("executive", "dated_units", number=c("units")),
            _fact("executive", "dated_aov", number=safe_divide(c("revenue"), c("orders"))),
            _fact("executive", "dated_discount", number=c("discount")),
            _fact("executive", "discount_impact_rate", number=safe_divide(c("discount"), c("gross"))),
        ),
        _extreme(complete, "executive", "strongest_complete_month", "year_month", "revenue"),
        _extreme(complete, "executive", "weakest_complete_month", "year_month", "revenue", lowest=True),
        _extreme(complete, "executive", "highest_growth_month", "year_month", "revenue_growth_rate"),
        _facts(
            monthly.where("is_partial_period"),
            _fact("executive", "partial_month", c("year_month"), text=c("partial_reason")),
        ),
        _facts(
            complete.where(from_nothing), _fact("executive", "growth_not_meaningful", c("year_month"), c("revenue")),
        ),
    ]


def _business(tables: Mapping[str, DataFrame]) -> list[DataFrame]:
    parts = [
        _extreme(tables["category_summary"], "business", "top_category", "category", "revenue"),
        _extreme(tables["customer_summary"], "business", "top_customer", "customer_name", "revenue"),
        _extreme(tables["top_products"], "business", "top_product", "product_name", "revenue"),
        _facts(
            tables["anomalies"].agg(F.count(F.lit(1)).alias("n")),
            _fact("business", "anomaly_count", number=F.col("n")),
        ),
    ]
    if tables.get("store_summary") is not None:
        stores = assigned_stores(tables["store_summary"])
        parts.append(_extreme(stores, "business", "top_store", "store_name", "revenue"))
    return parts


def _status(tables: Mapping[str, DataFrame]) -> list[DataFrame]:
    return [_facts(
        tables["report_status"], _fact("status", "report_status", F.col("status"), text=F.col("reason"))
    )]


def _quality(tables: Mapping[str, DataFrame]) -> list[DataFrame]:
    c = F.col
    return [
        _facts(
            tables["data_quality"].where(c("section") == "duplicates"),
            _fact("quality", "duplicates", c("metric"), c("value_double")),
        ),
        _facts(
            tables["post_conversion_data_quality"].where(
                (c("issue_count") > 0) | (c("check_name") == "invalid_date_count")
            ),
            _fact("quality", "order_check", c("check_name"), c("issue_count")),
        ),
        _facts(
            tables["expense_post_conversion_quality"].where(c("issue_count") > 0),
            _fact("quality", "expense_check", c("check_name"), c("issue_count")),
        ),
    ]


def _validation(tables: Mapping[str, DataFrame]) -> list[DataFrame]:
    validation, c = tables["validation_report"], F.col
    return [
        _facts(
            validation.agg(
                F.count_if(c("status") != "info").alias("checks"), F.count_if(c("status") == "failed").alias("failed")
            ),
            _fact("validation", "check_count", number=c("checks")),
            _fact("validation", "failed_check_count", number=c("failed")),
        ),
        _facts(
            validation.where(c("status") == "failed"),
            _fact("validation", "failed_check", c("check_name"), c("difference")),
        ),
        _facts(
            validation.where(c("status") == "info"), _fact("validation", "info", c("check_name"), c("actual_value"))
        ),
    ]


def _finance(tables: Mapping[str, DataFrame]) -> list[DataFrame]:
    flow, breakdown, c = tables["cash_flow_summary"], tables["expense_category_breakdown"], F.col
    largest = _best(breakdown, "expense_category", "total_expense").where("label is not null")
    share = breakdown.join(largest.select(c("label").alias("expense_category")), "expense_category", "left_semi")
    first = F.min(F.struct("year_month", "warning_type")).alias("w")
    return [
        _facts(
            tables["finance_status"].where(c("metric") == "finance_module_status"),
            _fact("finance", "finance_module_status", text=c("value_text")),
        ),
        _facts(tables["finance_kpis"], _fact("finance", "kpi", c("metric"), c("value_double"), c("value_text"))),
        _extreme(flow, "finance", "strongest_cash_flow_month", "year_month", "net_cash_flow"),
        _extreme(flow, "finance", "weakest_cash_flow_month", "year_month", "net_cash_flow", lowest=True),
        _facts(
            share, _fact("finance", "largest_category_share", c("expense_category"), c("share_of_expenses"))
        ),
        _facts(
            tables["cash_flow_warnings"].agg(first).where("w is not null"),
            _fact("finance", "first_cash_flow_warning", c("w.year_month"), text=c("w.warning_type")),
        ),
    ]


def _anomaly(tables: Mapping[str, DataFrame]) -> list[DataFrame]:
    return [_facts(
        first_anomalies(tables["anomalies"]), _fact("anomaly", "note", F.col("anomaly_label"), text=F.col("details"))
    )]


def headline_facts(tables: Mapping[str, DataFrame], sections: Sequence[str] = SECTIONS) -> DataFrame:
    """The statements of a written summary as rows.

    Each fact reads one report table, so pass tables that are already written rather than their definitions.
    """
    builders = {
        "executive": _executive, "business": _business, "status": _status, "quality": _quality,
        "validation": _validation, "finance": _finance, "anomaly": _anomaly,
    }
    return reduce(DataFrame.unionByName, [part for name in sections for part in builders[name](tables)])


def first_anomalies(anomalies: DataFrame, n: int = 10) -> DataFrame:
    """Month findings in time order, then order findings; the remaining columns settle ties."""
    return anomalies.orderBy(
        F.when(F.col("level") == "month", 0).otherwise(1), "period", "anomaly_type", "order_id", "details"
    ).limit(n)


def dashboard_kpis(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row over all order rows, dated or not."""
    enriched = tables["enriched_orders"]
    totals = enriched.agg(
        exact_sum(F.col("final_revenue")).alias("total_revenue"),
        F.countDistinct("order_id").alias("total_orders"),
        exact_sum(F.col("quantity")).alias("total_units"),
    )

    def top(name: str, label: str) -> Column:
        if tables.get(name) is None:
            return F.lit("")
        df = assigned_stores(tables[name]) if name == "store_summary" else tables[name]
        return F.coalesce(_best(df, label, "revenue").select("label").scalar(), F.lit(""))

    return totals.withColumns({
        "overall_aov": safe_divide(F.col("total_revenue"), F.col("total_orders")),
        "top_category": top("category_summary", "category"),
        "top_product": top("top_products", "product_name"),
        "top_customer": top("customer_summary", "customer_name"),
        "top_store": top("store_summary", "store_name"),
        "anomaly_count": tables["anomalies"].agg(F.count(F.lit(1)).alias("n")).scalar(),
    })


def store_extremes(stores: DataFrame) -> DataFrame:
    """The best and the weakest assigned store, when at least two exist."""
    ranked = assigned_stores(stores)
    several = ranked.agg((F.count(F.lit(1)) >= 2).alias("several")).scalar()

    def pick(name: str, lowest: bool) -> DataFrame:
        rank = F.struct((F.col("revenue") if lowest else -F.col("revenue")).alias("v"), F.col("_group"))
        best = ranked.agg(F.min_by(F.struct("store_name", "revenue", "revenue_share"), rank).alias("b"))
        return best.select(F.lit(name).alias("rank"), "b.*")

    return pick("top_store", False).unionByName(pick("lowest_store", True)).where(several)


def action_required(status: DataFrame, duplicate_groups: Column, anomalies: DataFrame, removed_rows: int = 0) -> DataFrame:
    """What a person should look at: a failed report, duplicate rows, every anomaly."""
    def rows(df: DataFrame, issue: Column, severity: str, impact: Column, action: str) -> DataFrame:
        return df.select(
            issue.alias("issue"), F.lit(severity).alias("severity"), impact.alias("business_impact"),
            F.lit(action).alias("suggested_action"),
        )

    failed = rows(
        status.where(F.col("status") == "failed"), F.lit("Report failed"), "Critical", F.col("reason"),
        "Fix the data quality issue, then generate the report again.",
    )
    repeated = rows(
        status.where((duplicate_groups > 0) & F.lit(removed_rows == 0)), F.lit("Duplicate rows"), "Review",
        F.lit("Revenue may be inflated if the duplicate rows are accidental."),
        "Review duplicate rows before using revenue numbers.",
    )
    found = rows(
        anomalies, F.col("anomaly_label"), "Warning", F.col("details"),
        "Open the Anomalies detail table and investigate the affected rows.",
    )
    return failed.unionByName(repeated).unionByName(found)


def data_limitations(availability: DataFrame, expenses_given: bool) -> DataFrame:
    """Analyses that are off because optional data is missing; cost data never exists in this model."""
    def status(field: str, column: str = "availability_status") -> Column:
        return F.max(F.when(F.col("field_name") == field, F.col(column)))

    found = availability.agg(
        F.coalesce(status("returned"), F.lit("provided")).alias("returned"),
        F.coalesce(status("customer_id"), F.lit("provided")).alias("customer"),
        status("customer_id", "notes").alias("customer_notes"),
    )

    def row(test: Column, limitation: Column, impact: str) -> Column:
        return F.when(test, F.struct(limitation.alias("limitation"), F.lit(impact).alias("impact")))

    return found.select(F.inline(F.array_compact(F.array(
        row(F.lit(not expenses_given), F.lit("Expense data was not provided"),
            "Finance and cash-flow analysis was skipped."),
        row(F.col("returned") == "not_provided", F.lit("Return data was not provided"),
            "Return rates and return anomalies were skipped."),
        row(F.col("customer") != "provided",
            F.when(F.col("customer") == "partially_provided", CUSTOMER_PARTIAL)
            .when(F.col("customer") == "mapping_conflict", F.col("customer_notes")).otherwise(CUSTOMER_NOT_PROVIDED),
            "Customer rankings and lifecycle analysis were skipped."),
        row(F.lit(True), F.lit("Cost data was not provided"), "Gross-margin analysis is not available."),
    ))))

