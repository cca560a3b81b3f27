"""Standard order and expense tables derived from the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderglass.operators.finance import prepare_expenses
from orderglass.operators.revenue import add_revenue, with_typed
from orderglass.session import in_slice, slice_count, stage_parts
from orderglass.sources.tables import spread, with_row_numbers

# Neither brand, part name nor customer name is a number in these tables, so no query needs to test that
# again; ``enriched_orders`` runs the test itself.
TEXT_NAMES: dict[str, bool] = {}

#: A slice of the order lines, number and count.
Part = tuple[int, int]
WHOLE: Part = (0, 1)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their original position: header line 1, first row 2."""
    lines = with_row_numbers(spark, f"{folder}/lineitem.parquet", file_format="parquet")
    return spread(lines, table(spark, folder, "lineitem"))


def order_rows(
    spark: SparkSession, folder: str, customer: bool = False, store: bool = False, numbered: bool = False,
    part: Part = WHOLE,
) -> DataFrame:
    """Line items as order rows in the standard schema, with date and customer from the order table.

    The lines are shuffled once per joined table and get wider each time. So customers meet the orders, not the lines,
    and the orders, the widest of all, come last; rows of one order then stand together, which packs well.
    """
    lines = numbered_lines(spark, folder) if numbered else spread(table(spark, folder, "lineitem"))
    if part[1] > 1:
        lines = lines.where(in_slice(*part, "l_orderkey"))
    goods = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines
    columns = {
        "order_id": F.col("l_orderkey"),
        "date": F.col("o_orderdate"),
        "customer_id": F.col("o_custkey"),
        "product_id": F.col("l_partkey"),
        "product_name": F.col("p_name"),
        "category": F.col("p_brand"),
        "unit_price": F.col("p_retailprice"),
        "quantity": F.col("l_quantity"),
        "discount_rate": F.col("l_discount"),
        "returned": F.col("l_returnflag") == "R",
    }
    if numbered:
        columns["source_row_number"] = F.col("source_row_number")
    if customer:
        people = table(spark, folder, "customer").select("c_custkey", "c_name")
        orders = orders.join(people, orders.o_custkey == people.c_custkey, "left")
        columns["customer_name"] = F.col("c_name")
    if store:
        shops = table(spark, folder, "supplier").select("s_suppkey", "s_name")
        joined = joined.join(shops, joined.l_suppkey == shops.s_suppkey, "left")
        columns["store_id"] = F.col("l_suppkey")
        columns["store_name"] = F.col("s_name")
    joined = joined.join(goods, joined.l_partkey == goods.p_partkey, "left")
    joined = joined.join(orders, joined.l_orderkey == orders.o_orderkey, "left")
    return joined.select(*[column.alias(name) for name, column in columns.items()])


def staged_parts(spark: SparkSession, folder: str, build: Callable[[Part], DataFrame], name: str) -> DataFrame:
    """``build`` of each slice of the order lines, joined and written one after another into one table."""
    count = slice_count(table(spark, folder, "lineitem"))
    return stage_parts((build((number, count)) for number in range(count)), name)


def enriched_rows(spark: SparkSession, folder: str, **parts: bool) -> DataFrame:
    return add_revenue(order_rows(spark, folder, **parts), numeric_names=TEXT_NAMES)


def dirty_order_rows(spark: SparkSession, folder: str, part: Part = WHOLE) -> DataFrame:
    """Order rows as a messy text file would hold them; every fault follows from a key by formula."""
    rows = order_rows(spark, folder, numbered=True, part=part).withColumn(
        "_shop", F.col("product_id") + F.col("order_id")
    )
    order, product, shop = F.col("order_id"), F.col("product_id"), F.col("_shop")
    return rows.select(
        "source_row_number",
        F.when(order % 97 != 0, order.cast("string")).alias("order_id"),
        F.when(order % 17 == 0, "not-a-date")
        .when(order % 19 == 0, F.lit(None))
        .when(order % 3 == 0, F.date_format("date", "yyyy/MM/dd"))
        .when(order % 3 == 1, F.date_format("date", "MM/dd/yyyy"))
        .otherwise(F.date_format("date", "yyyy-MM-dd")).alias("date"),
        F.col("customer_id").cast("string").alias("customer_id"),
        product.cast("string").alias("product_id"),
        "product_name",
        F.when(product % 59 != 0, F.col("category")).alias("category"),
        F.when(product % 41 == 0, F.lit(None))
        .when(product % 43 == 0, "abc")
        .when(product % 47 == 0, "-5")
        .otherwise(F.col("unit_price").cast("string")).alias("unit_price"),
        F.when(order % 53 == 0, "0").otherwise(F.col("quantity").cast("string")).alias("quantity"),
        F.when(shop % 29 == 0, "1.25")
        .when(shop % 31 == 0, "none given")
        .otherwise(F.col("discount_rate").cast("string")).alias("discount_rate"),
        F.when(F.col("returned"), "yes").when(shop % 7 == 0, "unknown").otherwise("no").alias("returned"),
    )


def staged_dirty_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The messy order rows joined and written once, for the quality counts, which read them several times."""
    return staged_parts(spark, folder, lambda part: dirty_order_rows(spark, folder, part), "rows")


def staged_dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The messy order rows joined, parsed and written once, for tables over both the rows as read and the revenue."""
    return staged_parts(spark, folder, lambda part: with_typed(dirty_order_rows(spark, folder, part)), "orders")


def staged_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Order rows with customer and store, written once with their typed columns."""
    return staged_parts(
        spark, folder, lambda part: with_typed(order_rows(spark, folder, customer=True, store=True, part=part)), "orders"
    )


def dirty_enriched_rows(spark: SparkSession, folder: str) -> DataFrame:
    return add_revenue(dirty_order_rows(spark, folder), numeric_names=TEXT_NAMES)


def repeated_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with every 25th order loaded twice; the copies are numbered after the originals."""
    lines = numbered_lines(spark, folder).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount_rate"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), "source_row_number",
    )
    # Row numbers start at 2 and have no gaps, so the copies follow the last one.
    last = lines.agg(F.max("source_row_number")).scalar()
    copies = lines.where(F.col("order_id") % 25 == 0).withColumn("source_row_number", F.col("source_row_number") + last)
    return lines.unionByName(copies)


def expense_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events as expenses."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("expense_id"), F.col("ts").alias("date"),
        F.col("event_type").alias("expense_category"), F.col("value").alias("amount"),
    )


def dirty_expense_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a messy expense file: repeated ids, bad dates and amounts, months that overlap the orders."""
    event = F.col("event_id")
    return table(spark, folder, "events").select(
        F.floor(event / 2).cast("bigint").alias("expense_id"),
        F.when(event % 13 == 0, "bad-date").otherwise(
            F.date_format(F.add_months(F.to_date("ts"), -(event % 96).cast("int")), "yyyy-MM-dd")
        ).alias("date"),
        F.when(event % 11 != 0, F.col("event_type")).alias("expense_category"),
        F.when(event % 23 == 0, "abc")
        .when(event % 29 == 0, F.concat(F.lit("-"), F.col("value").cast("string")))
        .otherwise(F.col("value").cast("string")).alias("amount"),
    )


def prepared_expenses(spark: SparkSession, folder: str) -> DataFrame:
    return prepare_expenses(expense_rows(spark, folder))


def dirty_prepared_expenses(spark: SparkSession, folder: str) -> DataFrame:
    return prepare_expenses(dirty_expense_rows(spark, folder))


def plain(df: DataFrame) -> DataFrame:
    """Comparable output: exact decimals as doubles, dates and times as text."""
    def column(field: T.StructField) -> Column:
        source = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            return source.cast("double").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(source, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(source, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        return source
    return df.select(*map(column, df.schema.fields))


# The benchmark columns under the names a sales database would use; names carry meaning for discovery.
BUSINESS_NAMES = {
    "lineitem": {
        "l_orderkey": "Order Key", "l_partkey": "Product Key", "l_suppkey": "Supplier ID",
        "l_linenumber": "Line Number", "l_quantity": "Quantity", "l_extendedprice": "Line Amount",
        "l_discount": "Discount Rate", "l_tax": "Tax", "l_returnflag": "Return Flag",
        "l_linestatus": "Line Status", "l_shipdate": "Ship Date",
    },
    "orders": {
        "o_orderkey": "Order Key", "o_custkey": "Customer Key", "o_orderstatus": "Order Status",
        "o_totalprice": "Order Total", "o_orderdate": "Order Date", "o_orderpriority": "Priority",
    },
    "customer": {
        "c_custkey": "Customer Key", "c_name": "Customer Name", "c_nationkey": "Country Code",
        "c_acctbal": "Balance", "c_mktsegment": "Segment",
    },
    "part": {
        "p_partkey": "Product Key", "p_name": "Product Name", "p_brand": "Product Category", "p_type": "Type",
        "p_size": "Size", "p_retailprice": "Unit Price",
    },
    "supplier": {
        "s_suppkey": "Supplier ID", "s_name": "Supplier Name", "s_nationkey": "Country Code",
        "s_acctbal": "Balance",
    },
    "nation": {"n_nationkey": "Country Code", "n_name": "Country Name", "n_regionkey": "Region Code"},
    "region": {"r_regionkey": "Region Code", "r_name": "Region Name"},
}


def business_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    return {
        name: spread(table(spark, folder, name)).withColumnsRenamed(BUSINESS_NAMES[name])
        for name in (names or tuple(BUSINESS_NAMES))
    }


def messy_source_rows(spark: SparkSession, folder: str, part: Part = WHOLE) -> DataFrame:
    """A joined source table in text form, as it would come out of an office tool: units, currency, percent."""
    rows = order_rows(spark, folder, customer=True, store=True, numbered=True, part=part)
    order, product = F.col("order_id"), F.col("product_id")
    price, quantity = F.col("unit_price"), F.col("quantity").cast("bigint").cast("string")
    percent = F.round(F.col("discount_rate") * 100).cast("bigint").cast("string")
    return rows.select(
        "source_row_number",
        order.cast("string").alias("Order Number"),
        F.when(order % 101 == 0, "soon")
        .when(order % 4 == 0, F.date_format("date", "yyyy/MM/dd"))
        .when(order % 4 == 1, F.date_format("date", "MMM d yyyy"))
        .when(order % 4 == 2, F.date_format("date", "MM/dd/yyyy"))
        .otherwise(F.date_format("date", "yyyy-MM-dd")).alias("Order Date"),
        F.when(product % 37 != 0, F.col("customer_id").cast("string")).otherwise("  ").alias("Customer Key"),
        F.col("customer_name").alias("Customer Name"),
        F.concat(F.lit(" P-"), product.cast("string"), F.lit(" ")).alias("Product Key"),
        F.col("product_name").alias("Product Name"),
        F.col("category").alias("Product Category"),
        F.when(product % 211 == 0, "ask")
        .when(product % 223 == 0, F.concat(F.lit("("), price.cast("string"), F.lit(")")))
        .when(product % 3 == 0, F.concat(F.lit("$"), F.format_number(price, 2)))
        .when(product % 3 == 1, F.concat(F.lit("EUR "), price.cast("string")))
        .otherwise(price.cast("string")).alias("Unit Price"),
        F.when(order % 103 == 0, "0").when(order % 2 == 0, F.concat(quantity, F.lit(" units")))
        .otherwise(quantity).alias("Quantity"),
        F.when(order % 2 == 0, F.concat(percent, F.lit("%"))).otherwise(
            F.col("discount_rate").cast("string")
        ).alias("Discount Rate"),
        F.when(F.col("returned"), F.when(order % 2 == 0, "退货").otherwise("Yes"))
        .when(product % 5 == 0, " ").when(product % 5 == 1, "未退货").otherwise("no").alias("Returned"),
        F.when(F.col("store_id") % 10 != 0, F.col("store_id").cast("string")).alias("Store Key"),
        F.col("store_name").alias("Store Name"),
    )
