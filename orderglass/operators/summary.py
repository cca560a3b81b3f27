"""Revenue summaries by month, category, customer, product and store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderglass.functions.labels import store_key_text
from orderglass.functions.numbers import MONEY, exact_sum, safe_divide
from orderglass.functions.text import clean_text, quoted
from orderglass.session import key_slices, slice_count, stage_parts

UNASSIGNED_STORE = "Unassigned Store"
DISTINCT_ORDERS = "count(DISTINCT order_id) FILTER (WHERE order_id IS NOT NULL)"

MONTHLY_COLUMNS = (
    "year_month", "gross_revenue", "discount_amount", "discounted_revenue", "revenue", "orders", "units", "AOV",
    "return_rate", "average_discount_rate", "discount_impact_rate", "period_start", "period_end",
    "observed_min_date", "observed_max_date", "observed_day_count", "calendar_day_count", "is_partial_period",
    "partial_reason", "previous_revenue", "revenue_growth_amount", "revenue_growth_rate",
)
CUSTOMER_KEYS = ("customer_id", "customer_name")
PRODUCT_KEYS = ("product_id", "product_name", "category")
STORE_COLUMNS = ("store_id", "store_name", "revenue", "orders", "units", "aov", "revenue_share")


def _measures() -> list[Column]:
    returned = F.col("returned").cast("double")
    return [
        exact_sum(F.col("gross_revenue")).alias("gross_revenue"),
        exact_sum(F.col("discount_amount")).alias("discount_amount"),
        exact_sum(F.col("discounted_revenue")).alias("discounted_revenue"),
        exact_sum(F.col("final_revenue")).alias("revenue"),
        exact_sum(F.col("quantity")).alias("units"),
        F.try_divide(F.sum(returned), F.count(returned)).alias("return_rate"),
        F.try_divide(exact_sum(F.col("discount_rate")).cast("double"), F.count("discount_rate")).alias(
            "average_discount_rate"
        ),
    ]


def _with_orders(rows: DataFrame, keys: Sequence[str], measures: Sequence[Column]) -> DataFrame:
    """The measures per key and the number of distinct orders, from one scan.

    A plain distinct count would shuffle every sum once per (key, order) pair, which is about once per row. With a
    filter, Catalyst expands each row in two, one for the sums and one for the order, so the sums shrink to one row
    per key and task, and only bare pairs are shuffled, spread over all tasks however hot a key is.
    """
    return rows.groupBy(*map(quoted, keys)).agg(*measures, F.expr(DISTINCT_ORDERS).alias("orders"))


MEASURES = (
    "gross_revenue", "discount_amount", "discounted_revenue", "revenue", "orders", "units", "return_rate",
    "average_discount_rate",
)


def _with_ratios(summary: DataFrame) -> DataFrame:
    return summary.withColumns({
        "AOV": safe_divide(F.col("revenue"), F.col("orders")),
        "discount_impact_rate": safe_divide(F.col("discount_amount"), F.col("gross_revenue")),
    })


def _known_keys(orders: DataFrame, keys: Sequence[str]) -> DataFrame:
    return orders.where(reduce(lambda a, b: a & b, [quoted(key).isNotNull() for key in keys]))


def summarize_orders(orders: DataFrame, keys: Sequence[str], ordered: bool = True) -> DataFrame:
    """Revenue, discount, order, unit and return measures per key, best revenue first.

    Rows with a null key are left out; the reconciliation report then shows the gap. ``ordered=False`` skips the
    final sort.
    """
    return _ranked(_with_orders(_known_keys(orders, keys), keys, _measures()), keys, ordered)


def _ranked(sums: DataFrame, keys: Sequence[str], ordered: bool = True) -> DataFrame:
    summary = _with_ratios(sums.select(*map(quoted, keys), *MEASURES))
    return summary.orderBy(F.desc("revenue"), *map(quoted, keys)) if ordered else summary


def category_summary(orders: DataFrame, ordered: bool = True) -> DataFrame:
    return summarize_orders(orders, ["category"], ordered)


def customer_summary(orders: DataFrame, ordered: bool = True) -> DataFrame:
    return summarize_orders(orders, CUSTOMER_KEYS, ordered)


def top_rows(summary: DataFrame, keys: Sequence[str], n: int = 10, measure: str = "revenue") -> DataFrame:
    """The ``n`` largest rows; the keys break ties."""
    return summary.orderBy(F.desc(measure), *map(quoted, keys)).limit(n)


def top_products(orders: DataFrame, n: int = 10) -> DataFrame:
    return top_rows(summarize_orders(orders, PRODUCT_KEYS, ordered=False), PRODUCT_KEYS, n)


def _coverage_measures() -> list[Column]:
    day = F.to_date("date")
    # A month has at most 31 days, so a bit per day counts distinct days without a distinct aggregate.
    days = F.bit_or(F.call_function("shiftleft", F.lit(1), F.dayofmonth(day) - 1))
    return [
        F.min(day).alias("observed_min_date"),
        F.max(day).alias("observed_max_date"),
        F.bit_count(days).cast("bigint").alias("observed_day_count"),
    ]


def _with_coverage(monthly: DataFrame) -> DataFrame:
    """Calendar bounds and the partial-month rule; only the first and last observed month can be partial."""
    in_order = W.orderBy("year_month")
    start = F.to_date(F.concat("year_month", F.lit("-01")))
    monthly = monthly.withColumns({
        "period_start": start,
        "period_end": F.last_day(start),
        "calendar_day_count": F.dayofmonth(F.last_day(start)).cast("bigint"),
        "_first": F.lag("year_month").over(in_order).isNull(),
        "_last": F.lead("year_month").over(in_order).isNull(),
    })
    late = F.col("_first") & (F.col("observed_min_date") > F.col("period_start"))
    early = F.col("_last") & (F.col("observed_max_date") < F.col("period_end"))
    return monthly.withColumns({
        "is_partial_period": late | early,
        "partial_reason": F.when(
            early, F.concat(F.lit("Partial month through "), F.date_format("observed_max_date", "yyyy-MM-dd"))
        ).when(
            late, F.concat(F.lit("Partial month starting "), F.date_format("observed_min_date", "yyyy-MM-dd"))
        ).otherwise(""),
    }).drop("_first", "_last")


def period_coverage(orders: DataFrame) -> DataFrame:
    """Observed days per month against the calendar."""
    monthly = orders.where(F.col("date").isNotNull()).groupBy("year_month").agg(*_coverage_measures())
    return _with_coverage(monthly).select(
        "year_month", "period_start", "period_end", "observed_min_date", "observed_max_date",
        "observed_day_count", "calendar_day_count", "is_partial_period", "partial_reason",
    ).orderBy("year_month")


def monthly_summary(orders: DataFrame) -> DataFrame:
    """Sales per observed month with calendar coverage and change against the previous observed month.

    The unpartitioned windows run over one row per month, never over orders.
    """
    months = _known_keys(orders, ["year_month"])
    return _monthly(_with_orders(months, ["year_month"], [*_measures(), *_coverage_measures()]))


def _monthly(sums: DataFrame) -> DataFrame:
    monthly = _with_ratios(sums)
    previous = F.lag("revenue").over(W.orderBy("year_month"))
    monthly = _with_coverage(monthly).withColumn("previous_revenue", previous)
    return monthly.withColumns({
        "revenue_growth_amount": (F.col("revenue") - F.col("previous_revenue")).cast(MONEY),
        "revenue_growth_rate": F.try_divide(
            F.col("revenue").cast("double"), F.col("previous_revenue").cast("double")
        ) - 1,
    }).select(*MONTHLY_COLUMNS).orderBy("year_month")


def growth_is_meaningful() -> Column:
    """False where revenue grew from nothing, so that a percentage says nothing."""
    return F.coalesce(F.col("previous_revenue") != 0, F.lit(False))


def complete_months(monthly: DataFrame) -> DataFrame:
    return monthly.where(~F.coalesce(F.col("is_partial_period"), F.lit(False)))


def _store_groups(orders: DataFrame) -> DataFrame:
    key = F.lit(None).cast("string")
    if "store_id" in orders.columns:
        key = store_key_text(F.col("store_id"), orders.schema["store_id"].dataType)
    name = clean_text(F.col("store_name")) if "store_name" in orders.columns else F.lit(None).cast("string")
    return orders.withColumns({"_store_id": key, "_store_name": name}).withColumn(
        "_group",
        F.when(F.col("_store_id").isNotNull(), F.concat(F.lit("id:"), F.col("_store_id")))
        .when(F.col("_store_name").isNotNull(), F.concat(F.lit("name:"), F.col("_store_name")))
        .otherwise(""),
    )


def store_summary(orders: DataFrame, ordered: bool = True) -> DataFrame:
    """Revenue per store; the key is the id, else the name, else the unassigned group.

    A store is labelled with the name on its earliest row (by ``source_row_number``; without row numbers,
    the alphabetically first name). ``revenue_share`` divides by a scalar subquery over the summary, so no
    task ever holds all stores.
    """
    numbered = "source_row_number" in orders.columns
    name = F.min_by("_store_name", "source_row_number") if numbered else F.min("_store_name")
    grouped = _store_groups(orders)
    if numbered:
        # min_by keeps a row whose name is null, so the row number only counts where a name is present.
        grouped = grouped.withColumn(
            "source_row_number", F.when(F.col("_store_name").isNotNull(), F.col("source_row_number"))
        )
    stores = _with_orders(grouped, ["_group"], [
        F.max("_store_id").alias("store_id"),
        name.alias("_name"),
        exact_sum(F.col("final_revenue")).alias("revenue"),
        exact_sum(F.col("quantity")).alias("units"),
    ])
    return _stores(stores, exact_sum_of_orders(orders).scalar(), ordered)


def _stores(sums: DataFrame, grand_total: Column, ordered: bool = True) -> DataFrame:
    stores = sums.withColumns({
        "store_name": F.when(F.col("_group") == "", UNASSIGNED_STORE)
        .otherwise(F.coalesce("_name", F.concat(F.lit("Store "), F.col("store_id")))),
        "aov": safe_divide(F.col("revenue"), F.col("orders")),
        "revenue_share": safe_divide(F.col("revenue"), grand_total),
    })
    result = stores.select("_group", *STORE_COLUMNS)
    return result.orderBy(F.desc("revenue"), "_group") if ordered else result


def exact_sum_of_orders(orders: DataFrame) -> DataFrame:
    return orders.agg(exact_sum(F.col("final_revenue")).alias("total"))


#: The key columns of each summary that :func:`order_summaries` builds; no key at all is the total of all rows.
SUMMARY_KEYS = {
    "monthly_summary": ("year_month",), "category_summary": ("category",), "customer_summary": CUSTOMER_KEYS,
    "products": PRODUCT_KEYS, "total": (), "stores": ("_group",), "store_names": ("_group", "_store_name"),
}


def _grouped(rows: DataFrame, sets: Mapping[str, Sequence[str]], measures: Sequence[Column]) -> DataFrame:
    """The measures of several summaries from one scan; ``_summary`` names the one, keys of the others are null."""
    columns = list(dict.fromkeys(key for keys in sets.values() for key in keys))
    # Spark's grouping id has one bit per column, the first column highest, set where the column is left out.
    ids = [sum((key not in keys) << place for place, key in enumerate(reversed(columns))) for keys in sets.values()]
    grouped = rows.groupingSets([[quoted(key) for key in keys] for keys in sets.values()], *map(quoted, columns)).agg(
        F.grouping_id().alias("_id"), *measures
    )
    named = F.create_map(*[F.lit(part) for pair in zip(ids, sets) for part in pair])
    return grouped.withColumn("_summary", named[F.col("_id").cast("int")]).drop("_id")


def order_summaries(orders: DataFrame, stores: bool = False) -> dict[str, DataFrame]:
    """Monthly, category, customer and product summaries, with ``stores`` also that of the stores, from two jobs.

    ``orders`` should be a written table: one job reads its sums, another only order ids and keys, however many
    summaries there are. Grouping sets send each row to every summary inside its task; there the sums shrink to one
    row per key before anything is shuffled, so only bare (key, order) pairs travel. A store's names are a grouping
    set of their own with the first row of each, so that all buffers have a fixed width. Both results are written, a
    folder per summary, and each table reads its own rows. The results are those of the single functions.

    Where most keys are rare their sums do not shrink in a task, so over a large table both jobs run slice by slice of
    the keys.
    """
    names = [name for name in SUMMARY_KEYS if stores or not name.startswith("store")]
    measures = [*_measures(), *_coverage_measures()]
    if stores:
        orders = _store_groups(orders)
        first = F.col("source_row_number") if "source_row_number" in orders.columns else F.lit(0).cast("bigint")
        measures.append(F.min(first).alias("_first_row"))
    counted = [name for name in names if name not in ("total", "store_names")]
    keys = list(dict.fromkeys(key for name in counted for key in SUMMARY_KEYS[name]))
    by_order = {name: (*SUMMARY_KEYS[name], "order_id") for name in counted}
    pairs = _grouped(orders.where("order_id is not null").select(*map(quoted, keys), "order_id"), by_order, [])
    found_orders = pairs.groupBy("_summary", *map(quoted, keys)).agg(F.count(F.lit(1)).alias("orders"))
    found_sums = _grouped(orders, {name: SUMMARY_KEYS[name] for name in names}, measures)
    slices = slice_count(orders)
    sums = stage_parts(key_slices(found_sums, [*map(quoted, keys)], slices), "summaries", ("_summary",))
    # A bare pair is about a quarter of a row of sums.
    pair_slices = key_slices(found_orders, [*map(quoted, keys)], (slices + 1) // 2)
    counts = stage_parts(pair_slices, "summary-orders", ("_summary",))

    def part(name: str) -> DataFrame:
        own = SUMMARY_KEYS[name]
        of_sums, of_counts = (_known_keys(rows.where(F.col("_summary") == name), own) for rows in (sums, counts))
        met = of_sums.join(of_counts.select(*map(quoted, own), "orders"), list(own), "left")
        return met.withColumn("orders", F.coalesce("orders", F.lit(0)))

    found = {
        "monthly_summary": _monthly(part("monthly_summary")),
        "category_summary": _ranked(part("category_summary"), SUMMARY_KEYS["category_summary"]),
        "customer_summary": _ranked(part("customer_summary"), CUSTOMER_KEYS),
        "top_products": top_rows(_ranked(part("products"), PRODUCT_KEYS, ordered=False), PRODUCT_KEYS),
    }
    if stores:
        total = sums.where("_summary = 'total'").agg(F.max("revenue")).scalar()
        labels = _known_keys(sums.where("_summary = 'store_names'"), SUMMARY_KEYS["store_names"]).groupBy("_group").agg(
            F.min_by("_store_name", F.struct("_first_row", "_store_name")).alias("_name")
        )
        key = F.when(F.startswith("_group", F.lit("id:")), F.substr("_group", F.lit(4)))
        named = part("stores").drop("_store_name").join(labels, "_group", "left").withColumn("store_id", key)
        found["store_summary"] = _stores(named, total)
    return found


def assigned_stores(stores: DataFrame) -> DataFrame:
    """Stores that can be ranked. The group key decides: a real store may be called Unassigned Store.

    A written summary has no group key any more; there, a store with an id is always a real one.
    """
    if "_group" in stores.columns:
        return stores.where(F.col("_group") != "")
    return stores.where(F.col("store_id").isNotNull() | (F.col("store_name") != UNASSIGNED_STORE))


def store_status(orders: DataFrame) -> DataFrame:
    """One row: rows with store data, all rows, and the resulting availability."""
    grouped = _store_groups(orders)
    counts = grouped.agg(
        F.count_if(F.col("_group") != "").alias("provided_row_count"),
        F.count(F.lit(1)).alias("total_row_count"),
        F.count("_store_id").alias("_ids"),
    )
    provided, total = F.col("provided_row_count"), F.col("total_row_count")
    return counts.select(
        F.when(provided == 0, "not_provided").when(provided < total, "partially_provided").otherwise("provided")
        .alias("availability_status"),
        provided, total,
        ((provided > 0) & (F.col("_ids") == 0)).alias("grouped_by_name"),
    )
