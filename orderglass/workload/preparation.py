"""Registered queries over joins, discovery, mapping, preflight and finished reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderglass.functions.dates import parse_date
from orderglass.functions.flags import mapped_flag, order_file_flag
from orderglass.functions.keys import canonical_key
from orderglass.functions.labels import entity_label, identifier_label, numeric_only
from orderglass.functions.numbers import lenient_number, safe_divide
from orderglass.functions.text import is_present
from orderglass.operators import facts as fa
from orderglass.operators import finance as fi
from orderglass.operators import join_safety as js
from orderglass.operators import mapping as mp
from orderglass.operators import preflight as pf
from orderglass.operators import profile as pr
from orderglass.operators import quality as qu
from orderglass.operators import recommendation as rc
from orderglass.operators import summary as su
from orderglass.operators import anomalies as an
from orderglass.operators.discovery import discover_relationships
from orderglass.operators.duplicates import duplicate_groups
from orderglass.operators.revenue import rows_and_revenue
from orderglass.plans.join_plan import HEAVY_SHARE, JoinStep, TableRole, run_join_plan
from orderglass.plans.report import adapt_to_availability, enriched_report, order_report
from orderglass.session import key_slices, slice_count, stage_parts
from orderglass.sources.damage import text_damage
from orderglass.sources.tables import spread
from orderglass.workload import inputs as io
from orderglass.workload.inputs import plain

CHOICES = (
    mp.FieldChoice("order_id", source="Order Number"),
    mp.FieldChoice("date", source="Order Date"),
    mp.FieldChoice("product_id", source="Product Key"),
    mp.FieldChoice("unit_price", source="Unit Price"),
    mp.FieldChoice("quantity", source="Quantity"),
    mp.FieldChoice("discount_rate", source="Discount Rate"),
    mp.FieldChoice("customer_id", source="Customer Key"),
    mp.FieldChoice("returned", source="Returned"),
    mp.FieldChoice("customer_name", source="Customer Name"),
    mp.FieldChoice("product_name", source="Product Name"),
    mp.FieldChoice("category", source="Product Category"),
    mp.FieldChoice("store_id", source="Store Key"),
    mp.FieldChoice("store_name", "omit"),
)


# ---- conversions ---------------------------------------------------------------------------------------------

def convert_money(spark, d):
    rows = io.messy_source_rows(spark, d)
    return rows.select(
        "source_row_number", lenient_number(F.col("Unit Price")).alias("unit_price"),
        lenient_number(F.col("Quantity")).alias("quantity"),
        lenient_number(F.col("Discount Rate"), percentage=True).alias("discount_rate"),
    )


def convert_dates(spark, d):
    rows = io.messy_source_rows(spark, d)
    return plain(rows.select("source_row_number", parse_date(F.col("Order Date")).alias("date")))


def convert_returned(spark, d):
    text = F.col("Returned")
    return io.messy_source_rows(spark, d).groupBy(text.alias("text")).agg(
        F.bool_or(mapped_flag(text)).alias("mapped"), F.bool_or(order_file_flag(text)).alias("order_file"),
        F.count_if(is_present(text)).alias("present"), F.count(F.lit(1)).alias("n"),
    )


def entity_labels(spark, d):
    nations = io.table(spark, d, "customer").withColumn(
        "code", F.concat(F.col("c_nationkey").cast("string"), F.lit(".0"))
    )
    return nations.select(
        "c_custkey",
        F.when(numeric_only(nations, "code"), entity_label(F.col("code"), "Category")).otherwise(F.col("code"))
        .alias("nation"),
        F.when(numeric_only(nations, "c_mktsegment"), entity_label(F.col("c_mktsegment"), "Category"))
        .otherwise(F.col("c_mktsegment")).alias("segment"),
        identifier_label(F.col("code"), "Category").alias("mapped"),
    )


def safe_division(spark, d):
    lines = io.table(spark, d, "lineitem")
    return lines.groupBy("l_linenumber", "l_discount").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count(F.lit(1)).alias("n"),
    ).select(
        "l_linenumber", "l_discount", safe_divide(F.col("returned"), F.col("l_discount")).alias("per_discount"),
        safe_divide(F.lit(None), F.col("n")).alias("of_nothing"),
    )


# ---- joins ------------------------------------------------------------------------------------------------------

def _safety(frame):
    return plain(frame.drop("format_warnings", "block_reasons", "risk_flags").withColumn(
        "row_count_change", F.col("row_count_change").cast("bigint")
    ).withColumn("after_row_count", F.col("after_row_count").cast("bigint")))


def join_safety_lineitem_orders(spark, d):
    return _safety(js.join_safety(
        io.table(spark, d, "lineitem"), io.table(spark, d, "orders"), ["l_orderkey"], ["o_orderkey"], ["numeric"],
        "fact", "fact", "order_line", "order_header",
    ))


def join_safety_orders_lineitem(spark, d):
    return _safety(js.join_safety(
        io.table(spark, d, "orders"), io.table(spark, d, "lineitem"), ["o_orderkey"], ["l_orderkey"], ["numeric"],
        "fact", "fact",
    ))


def join_safety_composite(spark, d):
    lines = io.table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    return _safety(js.join_safety(lines, lines, keys, keys, ["numeric", "numeric"]))


def join_block_reasons(spark, d):
    found = js.join_safety(
        io.table(spark, d, "orders"), io.table(spark, d, "lineitem"), ["o_orderkey"], ["l_orderkey"], ["numeric"],
        "fact", "fact",
    )
    return found.select(F.explode("block_reasons").alias("block_reason"))


def _messy_customers(spark, d):
    """Customers whose key is written in another style on every third row."""
    key = F.col("c_custkey")
    return io.table(spark, d, "customer").select(
        F.when(key % 3 == 0, F.concat(F.lit("  CUST-"), key.cast("string"), F.lit(" ")))
        .when(key % 3 == 1, F.concat(F.lit("cust-"), key.cast("string")))
        .otherwise(F.concat(F.lit("Cust-"), key.cast("string"))).alias("code"),
        "c_name",
    )


def join_key_normalised(spark, d):
    orders = io.table(spark, d, "orders").select(
        F.when(F.col("o_custkey") % 7 == 0, " NULL ").otherwise(
            F.concat(F.lit("cUST-"), F.col("o_custkey").cast("string"))
        ).alias("code")
    )
    return _safety(js.join_safety(orders, _messy_customers(spark, d), ["code"], ["code"], ["text"]))


def key_forms(spark, d):
    """Canonical text, numeric and date keys of order columns written in several styles."""
    orders = io.table(spark, d, "orders")
    key = F.col("o_orderkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("0"), key.cast("string"), F.lit(".0"))).when(
        key % 3 == 1, F.concat(F.lit(" "), key.cast("string"))
    ).otherwise(F.format_number(key, 0))
    return orders.select(
        "o_orderkey", canonical_key(F.concat(F.lit(" Ab  "), text), "text").alias("text_key"),
        canonical_key(text, "numeric").alias("numeric_key"),
        canonical_key(F.date_format("o_orderdate", "MM/dd/yyyy"), "date").alias("date_key"),
    )


def leading_zero_warning(spark, d):
    people = io.table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("code"))
    orders = io.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("code"))
    return js.leading_zero_overlap(orders, people, "code", "code")


def key_sample_overlap(spark, d):
    shops = io.table(spark, d, "supplier")
    return js.sample_overlap(io.table(spark, d, "orders"), shops, "o_custkey", "s_suppkey", "numeric", sketch_keys=256)


STEPS = (
    JoinStep("lineitem", ("l_orderkey",), "orders", ("o_orderkey",), ("numeric",)),
    JoinStep("lineitem", ("l_partkey",), "part", ("p_partkey",), ("numeric",)),
    JoinStep("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",), ("numeric",)),
    JoinStep("orders", ("o_custkey",), "customer", ("c_custkey",), ("numeric",)),
    JoinStep("customer", ("c_nationkey",), "nation", ("n_nationkey",), ("numeric",)),
    JoinStep("nation", ("n_regionkey",), "region", ("r_regionkey",), ("numeric",)),
)
STEP_TABLES = ("lineitem", "orders", "part", "supplier", "customer", "nation", "region")
STEP_ROLES = {
    "lineitem": TableRole("fact", "order_line"), "orders": TableRole("fact", "order_header"),
    "part": TableRole("dimension", "product"), "supplier": TableRole("dimension", "supplier"),
    "customer": TableRole("dimension", "customer"), "nation": TableRole("dimension"),
    "region": TableRole("dimension", "region"),
}


def safe_join_chain(spark, d):
    tables = {name: io.table(spark, d, name) for name in STEP_TABLES}
    frame = run_join_plan(tables, "lineitem", STEPS, STEP_ROLES).frame
    names = {
        "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_quantity": "l_quantity",
        "orders.o_orderdate": "o_orderdate", "part.p_name": "p_name", "supplier.s_name": "s_name",
        "customer.c_name": "c_name", "nation.n_name": "n_name", "region.r_name": "r_name",
    }
    return plain(frame.select(*[F.col(f"`{source}`").alias(name) for source, name in names.items()]))


def _diagnostics(result):
    return plain(result.diagnostics.select(
        "step_id", "left_table", "right_table", "rows_before", F.col("rows_after").cast("bigint").alias("rows_after"),
        "matched_rows", "unmatched_rows", "match_rate", F.col("row_growth").cast("bigint").alias("row_growth"),
        "validation_status",
    ))


def join_step_diagnostics(spark, d):
    tables = {name: io.table(spark, d, name) for name in STEP_TABLES}
    # Every other customer has a wrong key, so the later steps of the chain meet unmatched rows.
    key = F.col("c_custkey")
    tables["customer"] = tables["customer"].withColumn("c_custkey", F.when(key % 2 == 0, key).otherwise(-key))
    return _diagnostics(run_join_plan(tables, "lineitem", STEPS, STEP_ROLES))


def refused_join(spark, d):
    tables = {name: io.table(spark, d, name) for name in ("orders", "lineitem", "customer")}
    steps = (
        JoinStep("orders", ("o_custkey",), "customer", ("c_custkey",), ("numeric",)),
        JoinStep("orders", ("o_orderkey",), "lineitem", ("l_orderkey",), ("numeric",)),
    )
    return _diagnostics(run_join_plan(tables, "orders", steps))


def composite_key_join(spark, d):
    """Order lines and the offers (part, supplier) they name: a number and a code in two spellings."""
    lines = io.table(spark, d, "lineitem").withColumn("shop", F.format_string(" s-%05d", "l_suppkey"))
    offers = lines.where("l_partkey % 4 <> 0").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("offer_lines"))
    offers = offers.select("l_partkey", F.format_string("S-%05d", "l_suppkey").alias("code"), "offer_lines")
    step = JoinStep("lines", ("l_partkey", "shop"), "offers", ("l_partkey", "code"), ("numeric", "text"))
    result = run_join_plan({"lines": lines, "offers": offers}, "lines", (step,))
    return result.frame.select("l_orderkey", "l_linenumber", F.col("`offers.offer_lines`").alias("offer_lines"))


def date_key_join(spark, d):
    """Orders and a calendar that writes its days as text."""
    orders = io.table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    days = orders.where(F.dayofweek(day) != 1).groupBy(F.date_format(day, "yyyy/MM/dd").alias("day")).agg(
        F.count(F.lit(1)).alias("day_orders"))
    step = JoinStep("orders", ("o_orderdate",), "days", ("day",), ("date",))
    result = run_join_plan({"orders": orders, "days": days}, "orders", (step,))
    return result.frame.select("o_orderkey", F.col("`days.day_orders`").alias("day_orders"))


def heavy_key_join(spark, d):
    """A join chain whose first key holds over a third of the lines; a fifth of the rest has no key."""
    line = io.table(spark, d, "lineitem")
    last = line.agg(F.max("l_partkey")).scalar()
    key = F.col("l_orderkey")
    lines = line.withColumn("l_partkey", F.when(key % 5 < 2, last).when(key % 5 != 2, F.col("l_partkey")))
    tables = {"lineitem": lines, **{name: io.table(spark, d, name) for name in ("part", "orders", "customer")}}
    steps = (STEPS[1], STEPS[0], STEPS[3])
    frame = run_join_plan(tables, "lineitem", steps, heavy_share=HEAVY_SHARE).frame
    return frame.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("`part.p_name`").alias("p_name"),
        F.col("`customer.c_name`").alias("c_name"),
    )


# ---- profile and discovery ------------------------------------------------------------------------------------

def column_profile(spark, d):
    return pr.profile_columns(io.business_tables(spark, d), exact="all").select(
        "table_id", "column_name", "position", "row_count", "non_null_count", "null_count", "null_rate",
        "unique_count", "unique_rate", "semantic_type", "is_key_like", "is_measure_like", "entity_role",
        "has_leading_zeros",
    )


def table_roles(spark, d):
    return pr.table_roles(pr.profile_columns(io.business_tables(spark, d))).select(
        "table_id", "row_count", "column_count", "entity_role", "role_guess", "role_confidence",
        F.concat_ws("; ", "role_evidence").alias("role_evidence"),
        F.col("role_score_breakdown.fact_score").alias("fact_score"),
        F.col("role_score_breakdown.dimension_score").alias("dimension_score"),
    )


def recommended_fact_table(spark, d):
    return pr.recommended_fact_table(pr.table_roles(pr.profile_columns(io.business_tables(spark, d))))


def relationship_candidates(spark, d):
    found = discover_relationships(io.business_tables(spark, d)).candidates
    return plain(found.select(
        "candidate_id", "relationship_kind", "expected_join_type", "confidence_score", "confidence_level", "match_rate",
        "distinct_overlap_rate", "left_key_uniqueness", "right_key_uniqueness", "right_null_key_count",
        "right_duplicate_key_count", "right_duplicate_row_count", "before_row_count",
        F.col("after_row_count").cast("bigint").alias("after_row_count"),
        F.col("row_count_change").cast("bigint").alias("row_count_change"), "many_to_many_risk", "row_inflation",
        "fact_to_fact_risk", "blocked", F.array_join("risk_flags", "; ").alias("risk_flags"), "status",
    ))


def candidate_overlaps(spark, d):
    """The value evidence of the single-column candidates that discovery accepts."""
    found = discover_relationships(io.business_tables(spark, d)).candidates
    return plain(found.where("relationship_kind = 'single_column'").select(
        "candidate_id", "match_rate", "distinct_overlap_rate", "left_key_uniqueness", "right_key_uniqueness",
        "before_row_count", F.col("after_row_count").cast("bigint").alias("after_row_count"), "expected_join_type",
        "blocked",
    ))


def mapping_evidence(spark, d):
    return pr.mapping_evidence(io.messy_source_rows(spark, d)).select(
        "column_name", "numeric_rate", "boolean_rate", "date_rate", "text_rate", "present_count"
    )


def field_recommendations(spark, d):
    source = io.messy_source_rows(spark, d).drop("source_row_number")
    return rc.recommend_fields(source).drop("score_breakdown", "explanation")


# ---- mapping, preflight and reports --------------------------------------------------------------------------

def _unified(spark, d, part=io.WHOLE):
    rows = mp.unified_orders(io.messy_source_rows(spark, d, part), CHOICES, carry=["source_row_number"])
    return rows.withColumn("unified_row_number", F.col("source_row_number") - 1)


def unified_orders(spark, d):
    return plain(_unified(spark, d))


def conversion_diagnostics(spark, d):
    return mp.conversion_diagnostics(io.messy_source_rows(spark, d), CHOICES).drop("output_type")


def preflight_counts(spark, d):
    return plain(pf.preflight_counts(_unified(spark, d), exclude_bad_rows=True))


def preflight_issues(spark, d):
    return pf.run_preflight(_unified(spark, d), {}, pf.BLOCK, False).issues


def excluded_rows(spark, d):
    return pf.excluded_rows(_unified(spark, d))


def kept_rows(spark, d):
    return plain(pf.kept_rows(_unified(spark, d)).select("unified_row_number", "order_id", "unit_price", "quantity"))


def issue_preview(spark, d):
    return plain(pf.price_quantity_preview(_unified(spark, d)))


def date_preview(spark, d):
    return plain(pf.date_preview(_unified(spark, d)))


def _availability(spark, d):
    return mp.field_availability(_unified(spark, d), CHOICES)


def field_availability(spark, d):
    return _availability(spark, d).drop("default_value")


def report_coverage(spark, d):
    return mp.report_coverage(_availability(spark, d))


def preparation_audit(spark, d):
    unified = _unified(spark, d)
    preflight = pf.run_preflight(unified, {}, pf.EXCLUDE_FROM_MONTHLY, True)
    return pf.preparation_audit("lineitem", preflight, _availability(spark, d))


def data_limitations(spark, d):
    return fa.data_limitations(_availability(spark, d), expenses_given=False)


def drop_selected_rows(spark, d):
    lines = io.numbered_lines(spark, d)
    selected = lines.where(F.col("l_orderkey") % 10 == 0).select("source_row_number")
    return pf.drop_selected_rows(lines, selected).select("source_row_number", "l_orderkey", "l_linenumber")


def text_damage_score(spark, d):
    return text_damage(spread(io.table(spark, d, "documents").select("source", "text")), ("source",))


def _report_tables(spark, d):
    """Order rows written once, their summaries and findings."""
    _, enriched = rows_and_revenue(io.staged_orders(spark, d), io.TEXT_NAMES)
    tables = {"enriched_orders": enriched, **su.order_summaries(enriched, stores=True)}
    return {**tables, "anomalies": an.detect_anomalies(enriched, tables["monthly_summary"])}


def headline_facts(spark, d):
    rows, enriched = rows_and_revenue(io.staged_orders(spark, d))
    tables = enriched_report(enriched, qu.raw_quality(rows, path="orders"), io.dirty_expense_rows(spark, d), stores=True)
    return fa.headline_facts(tables)


def dashboard_kpis(spark, d):
    return plain(fa.dashboard_kpis(_report_tables(spark, d)))


def store_extremes(spark, d):
    return plain(fa.store_extremes(su.store_summary(io.enriched_rows(spark, d, store=True), False)))


def action_required(spark, d):
    rows, enriched = rows_and_revenue(io.staged_dirty_orders(spark, d), io.TEXT_NAMES)
    # Each summary is written by a job of its own, so that their shuffles do not stand on disk together.
    monthly = stage_parts([su.monthly_summary(enriched)], "monthly")
    category = stage_parts([su.category_summary(enriched, False)], "category")
    customers = key_slices(enriched, su.CUSTOMER_KEYS, 1 + slice_count(enriched) // 4)
    customer = stage_parts((su.customer_summary(part, False) for part in customers), "customer")
    post = qu.post_quality(enriched)
    validation = qu.reconciliation(enriched, monthly, category, customer)
    status = qu.report_status(qu.raw_quality(rows), post, validation)
    columns = [name for name in enriched.columns if name != "source_row_number"]
    groups = duplicate_groups(enriched, columns).agg(F.count(F.lit(1)).alias("n")).scalar()
    table = fa.action_required(status, groups, an.detect_anomalies(enriched, monthly))
    return table.groupBy("issue", "severity", "suggested_action").agg(F.count(F.lit(1)).alias("n"))


def adapted_validation(spark, d):
    """The checks of a mapped report whose customer data is only partly there."""
    # Written once, as the mapped report does it: the checks read the rows many times.
    unified = io.staged_parts(spark, d, lambda part: _unified(spark, d, part), "unified")
    availability = spark.createDataFrame(mp.field_availability(unified, CHOICES).collect(), mp.AVAILABILITY_SCHEMA)
    rows = pf.kept_rows(unified).drop("unified_row_number")
    report = order_report(rows, None, numeric_names=io.TEXT_NAMES, written=True)
    tables = adapt_to_availability(report, availability)
    return plain(tables["validation_report"])


QUERIES = {
    f.__name__: f
    for f in (
        convert_money, convert_dates, convert_returned, entity_labels, safe_division, join_safety_lineitem_orders,
        join_safety_orders_lineitem, join_safety_composite, join_block_reasons, join_key_normalised, key_forms,
        leading_zero_warning, key_sample_overlap, safe_join_chain, join_step_diagnostics, refused_join,
        composite_key_join, date_key_join, heavy_key_join,
        column_profile, table_roles, recommended_fact_table, relationship_candidates, candidate_overlaps,
        mapping_evidence, field_recommendations, unified_orders, conversion_diagnostics, preflight_counts,
        preflight_issues, excluded_rows, kept_rows, issue_preview, date_preview, field_availability,
        report_coverage, preparation_audit, data_limitations, drop_selected_rows, text_damage_score,
        headline_facts, dashboard_kpis, store_extremes, action_required, adapted_validation,
    )
}
