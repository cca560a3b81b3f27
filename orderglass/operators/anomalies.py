"""Sales drops, high return rates and high discounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderglass.functions.text import money_text, month_text, percent_text

# The thresholds and wording of the anomaly rules.
SALES_DROP = -0.20
HIGH_RETURN_RATE = 0.15
HIGH_DISCOUNT = 0.30
DROP_LABEL = "Monthly revenue dropped by more than 20%"
RETURN_LABEL = "Monthly return rate exceeded 15%"
DISCOUNT_LABEL = "Order discount rate exceeded 30%"

ANOMALY_SCHEMA = (
    "anomaly_type string, anomaly_label string, level string, period string, order_id string, "
    "metric_value double, threshold double, affected_month string, previous_month string, "
    "previous_revenue double, current_revenue double, revenue_change double, percentage_change double, "
    "whether_current_period_is_partial boolean, details string"
)


def _shaped(df: DataFrame, **values) -> DataFrame:
    columns = []
    for part in ANOMALY_SCHEMA.split(", "):
        name, kind = part.split(" ")
        columns.append(values.get(name, F.lit(None)).cast(kind).alias(name))
    return df.select(*columns)


def sales_drops(monthly: DataFrame, threshold: float = SALES_DROP) -> DataFrame:
    """Months that lost at least 20 % against the previous observed month; a partial month never counts."""
    monthly = monthly.withColumn("previous_month", F.lag("year_month").over(W.orderBy("year_month")))
    rate = F.col("revenue_growth_rate")
    change = F.col("revenue").cast("double") - F.col("previous_revenue").cast("double")
    details = F.concat(
        month_text(F.col("year_month")), F.lit(" revenue decreased by "), percent_text(F.abs(rate)),
        F.lit(" compared with "), month_text(F.col("previous_month")),
        F.lit(", a reduction of "), money_text(F.abs(change)), F.lit("."),
    )
    return _shaped(
        monthly.where((rate <= threshold) & ~F.col("is_partial_period")),
        anomaly_type=F.lit("sales_drop_over_20_percent"), anomaly_label=F.lit(DROP_LABEL), level=F.lit("month"),
        period=F.col("year_month"), order_id=F.lit(""), metric_value=rate, threshold=F.lit(threshold),
        affected_month=F.col("year_month"), previous_month=F.col("previous_month"),
        previous_revenue=F.col("previous_revenue"), current_revenue=F.col("revenue"), revenue_change=change,
        percentage_change=rate, whether_current_period_is_partial=F.col("is_partial_period"), details=details,
    )


def high_returns(monthly: DataFrame, threshold: float = HIGH_RETURN_RATE) -> DataFrame:
    """Months whose return rate exceeds 15 %, partial months included."""
    rate = F.col("return_rate")
    return _shaped(
        monthly.where(rate > threshold),
        anomaly_type=F.lit("return_rate_over_15_percent"), anomaly_label=F.lit(RETURN_LABEL),
        level=F.lit("month"), period=F.col("year_month"), order_id=F.lit(""), metric_value=rate,
        threshold=F.lit(threshold), affected_month=F.col("year_month"),
        whether_current_period_is_partial=F.col("is_partial_period"),
        details=F.concat(F.lit("Monthly return rate was "), percent_text(rate), F.lit(".")),
    )


def high_discounts(enriched: DataFrame, threshold: float = HIGH_DISCOUNT) -> DataFrame:
    """Order rows with a discount above 30 %, impossible rates included."""
    rate = F.col("discount_rate")
    return _shaped(
        enriched.where(rate > threshold),
        anomaly_type=F.lit("discount_rate_over_30_percent"), anomaly_label=F.lit(DISCOUNT_LABEL),
        level=F.lit("order"), period=F.col("year_month"), order_id=F.col("order_id"), metric_value=rate,
        threshold=F.lit(threshold),
        details=F.concat(
            F.lit("Product "), F.col("product_id").cast("string"), F.lit(" had a "), percent_text(rate),
            F.lit(" discount."),
        ),
    )


def detect_anomalies(enriched: DataFrame, monthly: DataFrame) -> DataFrame:
    return (
        sales_drops(monthly)
        .unionByName(high_returns(monthly))
        .unionByName(high_discounts(enriched))
    )


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("anomaly_label").agg(F.count(F.lit(1)).alias("anomaly_count"))
