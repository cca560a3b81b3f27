"""Expenses, cash flow and finance indicators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderglass.functions.dates import parse_date, year_month
from orderglass.functions.numbers import MONEY, exact_sum, money_total, safe_divide, strict_number
from orderglass.functions.text import money_text, quoted
from orderglass.operators.checks import checks_table, metric_rows
from orderglass.session import stage

BREAKDOWN_SCHEMA = (
    "expense_category string, total_expense decimal(38,6), expense_count bigint, "
    "average_expense_amount double, share_of_expenses double"
)
CASH_FLOW_SCHEMA = (
    "year_month string, monthly_income decimal(38,6), monthly_expenses decimal(38,6), "
    "net_cash_flow decimal(38,6), profit_margin double, previous_net_cash_flow decimal(38,6), "
    "net_cash_flow_change_amount decimal(38,6), net_cash_flow_change_rate double, "
    "income_change_rate double, expense_change_rate double, cash_flow_warning string"
)
EMPTY_FINANCE_SCHEMAS = {
    "expense_post_conversion_quality": "check_name string, issue_count bigint, status string",
    "finance_kpis": "metric string, value_double double, value_text string",
    "expenses_enriched": (
        "expense_id string, date timestamp_ntz, expense_category string, amount double, vendor string, "
        "description string, year_month string"
    ),
    "cash_flow_summary": CASH_FLOW_SCHEMA,
    "expense_category_breakdown": BREAKDOWN_SCHEMA,
    "largest_expense_categories": BREAKDOWN_SCHEMA,
    "cash_flow_warnings": "year_month string, warning_type string, details string",
}

# The thresholds of the cash-flow rules.
LOW_MARGIN = 0.10
EXPENSE_JUMP = 0.20


def prepare_expenses(expenses: DataFrame, day_first: bool = False) -> DataFrame:
    """Typed expense rows; a missing category becomes ``Unknown``, missing text columns become blank."""
    kinds = {field.name: field.dataType for field in expenses.schema}
    typed = {
        "date": parse_date(quoted("date"), kinds["date"], day_first=day_first),
        "amount": strict_number(quoted("amount"), kinds["amount"]),
        "expense_category": F.coalesce(F.col("expense_category").cast("string"), F.lit("Unknown")),
    }
    typed.update({name: F.lit("") for name in ("vendor", "description") if name not in kinds})
    return expenses.withColumns(typed).withColumn("year_month", year_month(F.col("date")))


def usable_expenses(expenses: DataFrame) -> DataFrame:
    """Dated expenses with an amount of zero or more."""
    return expenses.where(F.col("year_month").isNotNull() & (F.col("amount") >= 0))


def expense_quality(expenses: DataFrame) -> DataFrame:
    amount = F.col("amount")
    return checks_table(expenses, {
        "invalid_expense_date_count": F.col("date").isNull(),
        "invalid_expense_amount_count": amount.isNull(),
        "negative_expense_amount_count": amount < 0,
        "expense_amount_isna_count": amount.isNull(),
    })


def expense_breakdown(expenses: DataFrame, ordered: bool = True) -> DataFrame:
    """Spending per category and its share of all usable spending."""
    usable = usable_expenses(expenses)
    total = usable.agg(exact_sum(F.col("amount")).alias("total"))
    summary = usable.groupBy("expense_category").agg(
        exact_sum(F.col("amount")).alias("total_expense"),
        F.countDistinct("expense_id").alias("expense_count"),
        F.count("amount").alias("_rows"),
    )
    result = summary.select(
        "expense_category",
        "total_expense",
        "expense_count",
        F.try_divide(F.col("total_expense").cast("double"), F.col("_rows")).alias("average_expense_amount"),
        safe_divide(F.col("total_expense"), total.scalar()).alias("share_of_expenses"),
    )
    return result.orderBy(F.desc("total_expense"), "expense_category") if ordered else result


def largest_expense_categories(breakdown: DataFrame, n: int = 5) -> DataFrame:
    return breakdown.orderBy(F.desc("total_expense"), "expense_category").limit(n)


def _warning_label() -> Column:
    income, spent = F.col("monthly_income"), F.col("monthly_expenses")
    label = F.concat_ws(
        "; ",
        F.when((income <= 0) & (spent > 0), "no_income_with_expenses"),
        F.when(F.col("net_cash_flow") < 0, "negative_cash_flow"),
        F.when((income > 0) & (F.col("profit_margin") < LOW_MARGIN), "low_profit_margin"),
        F.when(
            (F.col("_previous_expenses") > 0) & (F.col("expense_change_rate") > EXPENSE_JUMP),
            "expenses_up_over_20_percent",
        ),
    )
    return F.when(label == "", "ok").otherwise(label)


def cash_flow_summary(monthly: DataFrame, expenses: DataFrame) -> DataFrame:
    """Income against expenses per month; a month known to one side only keeps 0 for the other.

    The windows run over one row per month. The first month has a null change amount and 0 change rates.
    """
    income = monthly.select("year_month", F.col("revenue").alias("monthly_income"))
    spent = usable_expenses(expenses).groupBy("year_month").agg(
        exact_sum(F.col("amount")).alias("monthly_expenses")
    )
    in_order = W.orderBy("year_month")
    flow = income.join(spent, "year_month", "full").select(
        "year_month",
        F.coalesce("monthly_income", F.lit(0)).cast(MONEY).alias("monthly_income"),
        F.coalesce("monthly_expenses", F.lit(0)).cast(MONEY).alias("monthly_expenses"),
    ).withColumn("net_cash_flow", (F.col("monthly_income") - F.col("monthly_expenses")).cast(MONEY))
    flow = flow.withColumns({
        "previous_net_cash_flow": F.lag("net_cash_flow").over(in_order),
        "_previous_income": F.lag("monthly_income").over(in_order),
        "_previous_expenses": F.lag("monthly_expenses").over(in_order),
    }).withColumn(
        "net_cash_flow_change_amount", (F.col("net_cash_flow") - F.col("previous_net_cash_flow")).cast(MONEY)
    ).withColumns({
        "profit_margin": safe_divide(F.col("net_cash_flow"), F.col("monthly_income")),
        "net_cash_flow_change_rate": safe_divide(
            F.col("net_cash_flow_change_amount"), F.col("previous_net_cash_flow")
        ),
        "income_change_rate": safe_divide(
            F.col("monthly_income") - F.col("_previous_income"), F.col("_previous_income")
        ),
        "expense_change_rate": safe_divide(
            F.col("monthly_expenses") - F.col("_previous_expenses"), F.col("_previous_expenses")
        ),
    })
    return flow.withColumn("cash_flow_warning", _warning_label()).select(
        "year_month", "monthly_income", "monthly_expenses", "net_cash_flow", "profit_margin",
        "previous_net_cash_flow", "net_cash_flow_change_amount", "net_cash_flow_change_rate",
        "income_change_rate", "expense_change_rate", "cash_flow_warning",
    ).orderBy("year_month")


def cash_flow_warnings(flow: DataFrame) -> DataFrame:
    """One row per month and warning."""
    details = F.concat(
        F.lit("Income "), money_text(F.col("monthly_income")),
        F.lit(", expenses "), money_text(F.col("monthly_expenses")),
        F.lit(", net cash flow "), money_text(F.col("net_cash_flow")), F.lit("."),
    )
    return flow.where(F.col("cash_flow_warning") != "ok").select(
        "year_month",
        F.explode(F.split("cash_flow_warning", "; ")).alias("warning_type"),
        details.alias("details"),
    ).orderBy("year_month", "warning_type")


def cash_flow_long(flow: DataFrame) -> DataFrame:
    """Chart form: one row per month and series."""
    return flow.select(
        "year_month",
        F.col("monthly_income").alias("Income"),
        F.col("monthly_expenses").alias("Expenses"),
        F.col("net_cash_flow").alias("Net cash flow"),
    ).unpivot("year_month", ["Income", "Expenses", "Net cash flow"], "metric", "amount")


def finance_kpis(flow: DataFrame, breakdown: DataFrame) -> DataFrame:
    """Seven indicators; numbers are in ``value_double``, the one name in ``value_text``."""
    income, spent = money_total(F.col("monthly_income")), money_total(F.col("monthly_expenses"))
    totals = flow.agg(
        income.alias("income"), spent.alias("spent"),
        F.count_if(F.col("cash_flow_warning") != "ok").alias("warnings"),
    )
    # The smallest name wins among categories with the same total, as in the sorted breakdown.
    ranked = F.struct(-F.col("total_expense"), "expense_category")
    largest = breakdown.agg(
        F.min_by("expense_category", ranked).alias("name"), F.max("total_expense").alias("amount")
    )
    rows = totals.withColumns({
        "net": F.col("income") - F.col("spent"),
        "name": largest.select("name").scalar(),
        "amount": largest.select("amount").scalar(),
    })
    return metric_rows(rows, [
        ("total_income", F.col("income"), None),
        ("total_expenses", F.col("spent"), None),
        ("net_cash_flow", F.col("net"), None),
        ("profit_margin", safe_divide(F.col("net"), F.col("income")), None),
        ("warning_months", F.col("warnings"), None),
        ("largest_expense_category", None, F.coalesce(F.col("name"), F.lit(""))),
        ("largest_expense_category_amount", F.coalesce(F.col("amount"), F.lit(0)), None),
    ])


def finance_status(
    expenses: DataFrame | None,
    path: str = "",
    status: str | None = None,
    message: str | None = None,
    spark=None,
) -> DataFrame:
    """What was read: file, status, and size and completeness of the raw expense table."""
    if expenses is None:
        frame = spark.range(1)
        return metric_rows(frame, [
            ("expenses_file", None, F.lit(path)),
            ("finance_module_status", None, F.lit(status or "skipped")),
            ("message", None, F.lit(
                message or "No expenses file was found, so cash flow analysis was skipped."
            )),
        ])
    nulls = sum((F.count_if(quoted(name).isNull()) for name in expenses.columns), F.lit(0))
    ids = F.col("expense_id")
    facts = expenses.agg(
        F.count(F.lit(1)).alias("rows"),
        nulls.alias("nulls"),
        # A null id counts as one more distinct value.
        (F.count(F.lit(1)) - F.countDistinct(ids) - F.least(F.count_if(ids.isNull()), F.lit(1))).alias("repeats"),
    )
    return metric_rows(facts, [
        ("expenses_file", None, F.lit(path)),
        ("finance_module_status", None, F.lit(status or "passed")),
        ("message", None, F.lit(message or "Expenses file loaded successfully.")),
        ("expense_rows", F.col("rows"), None),
        ("expense_columns", F.lit(len(expenses.columns)), None),
        ("expense_missing_values", F.col("nulls"), None),
        ("duplicate_expense_ids", F.col("repeats"), None),
    ])


def finance_tables(
    monthly: DataFrame,
    expenses: DataFrame | None,
    path: str = "",
    required: Sequence[str] = ("expense_id", "date", "expense_category", "amount"),
) -> dict[str, DataFrame]:
    """All finance tables; without expenses they exist but are empty and the module reports ``skipped``."""
    spark = monthly.sparkSession
    if expenses is None:
        tables = {name: spark.createDataFrame([], schema) for name, schema in EMPTY_FINANCE_SCHEMAS.items()}
        tables["finance_status"] = finance_status(None, path, spark=spark)
        return tables
    missing = [name for name in required if name not in expenses.columns]
    if missing:
        raise ValueError(f"The expenses table lacks required columns: {', '.join(missing)}")
    # Five tables read the expenses and three the cash flow; both are written once.
    prepared = stage(prepare_expenses(expenses), "expenses")
    flow = stage(cash_flow_summary(monthly, prepared), "cash-flow").orderBy("year_month")
    breakdown = expense_breakdown(prepared)
    return {
        "finance_status": finance_status(expenses, path),
        "expense_post_conversion_quality": stage(expense_quality(prepared), "expense-quality"),
        "finance_kpis": finance_kpis(flow, breakdown),
        "expenses_enriched": prepared,
        "cash_flow_summary": flow,
        "expense_category_breakdown": breakdown,
        "largest_expense_categories": largest_expense_categories(breakdown),
        "cash_flow_warnings": cash_flow_warnings(flow),
    }
