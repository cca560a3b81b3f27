import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import fixtures as fx
from orderglass.operators import mapping as mp
from orderglass.operators.anomalies import detect_anomalies
from orderglass.operators.duplicates import duplicate_rows, numbered_in_order, repeated_order_id_rows, repeated_order_ids
from orderglass.operators.preflight import EXCLUDE_FROM_MONTHLY, run_preflight
from orderglass.operators.revenue import ColumnMappingError, add_revenue, missing_columns, rename_columns
from orderglass.operators import summary as su
from orderglass.operators.summary import monthly_summary, store_summary
from orderglass.plans.report import ReportError, mapped_report, order_report, run_report
from orderglass.workload import preparation, reports


def as_dict(df, key, value):
    return {row[key]: row[value] for row in df.collect()}


@pytest.fixture(scope="module")
def clean(spark):
    return order_report(fx.orders(spark, fx.CLEAN_ORDERS), fx.expenses(spark, fx.CLEAN_EXPENSES))


@pytest.fixture(scope="module")
def faulty(spark):
    return order_report(fx.orders(spark, fx.FAULTY_ORDERS), fx.expenses(spark, fx.FAULTY_EXPENSES))


def totals(tables):
    row = tables["monthly_summary"].agg(
        F.sum("revenue"), F.sum("orders"), F.sum("units"), F.sum("discount_amount")
    ).first()
    return tuple(float(v) for v in row)


def test_clean_case_totals(clean):
    assert totals(clean) == (2382.0, 6.0, 156.0, 98.0)
    kpis = as_dict(clean["finance_kpis"], "metric", "value_double")
    assert (kpis["total_expenses"], kpis["net_cash_flow"]) == (1250.0, 1132.0)


def test_clean_case_is_ready(clean):
    assert clean["report_status"].first()["status"] == "ready"
    assert {row["status"] for row in clean["validation_report"].collect()} == {"passed", "info"}
    assert clean["duplicate_rows_detail"].isEmpty()


def test_faulty_case(faulty):
    assert totals(faulty) == (702.0, 5.0, 86.0, 18.0)
    counts = as_dict(faulty["post_conversion_data_quality"], "check_name", "issue_count")
    assert counts == {
        "invalid_date_count": 1, "invalid_unit_price_count": 1, "invalid_quantity_count": 0,
        "invalid_discount_rate_count": 0, "discount_rate_out_of_range_count": 1, "negative_unit_price_count": 0,
        "non_positive_quantity_count": 1, "invalid_returned_count": 1, "gross_revenue_isna_count": 2,
        "discounted_revenue_isna_count": 3, "final_revenue_isna_count": 3, "invalid_revenue_row_count": 3,
    }
    assert faulty["report_status"].first()["status"] == "failed"
    kpis = as_dict(faulty["finance_kpis"], "metric", "value_double")
    assert (kpis["total_expenses"], kpis["net_cash_flow"]) == (250.0, 452.0)


def test_summaries_in_one_pass_equal_the_single_ones(spark):
    rows = fx.CLEAN_ORDERS + fx.FAULTY_ORDERS + fx.CLEAN_ORDERS[:2] + [
        (None, "2026-01-09", None, None, "P9", None, None, "1", "2", "0", "true"),
    ]
    shop = F.col("source_row_number") % 4
    orders = add_revenue(fx.orders(spark, rows)).withColumns({
        "store_id": F.when(shop > 1, shop.cast("string")),
        "store_name": F.when(shop == 3, F.concat(F.lit("S"), F.col("source_row_number").cast("string")))
        .when(shop == 0, "Only a name"),
    })
    found = su.order_summaries(orders, stores=True)
    single = {
        "monthly_summary": su.monthly_summary(orders), "category_summary": su.category_summary(orders),
        "customer_summary": su.customer_summary(orders), "top_products": su.top_products(orders),
        "store_summary": su.store_summary(orders),
    }
    for name, table in single.items():
        assert [row.asDict() for row in found[name].collect()] == [row.asDict() for row in table.collect()], name
    assert all(table.isEmpty() for table in su.order_summaries(orders.limit(0), stores=True).values())


def test_order_without_required_columns_fails_but_reports(spark):
    tables = order_report(fx.orders(spark, fx.CLEAN_ORDERS).drop("returned"))
    status = tables["report_status"].first()
    assert (status["status"], status["missing_required_columns"]) == ("failed", 1)
    assert tables["finance_kpis"].isEmpty()


def test_partial_months_and_growth(spark):
    rows = [
        ("1", "2026-01-10", "c", "n", "p", "x", "k", "100", "1", "0", "false"),
        ("2", "2026-03-31", "c", "n", "p", "x", "k", "50", "1", "0", "false"),
    ]
    enriched = add_revenue(fx.orders(spark, rows))
    months = monthly_summary(enriched).collect()
    assert [(m["year_month"], m["is_partial_period"], m["partial_reason"]) for m in months] == [
        ("2026-01", True, "Partial month starting 2026-01-10"), ("2026-03", False, ""),
    ]
    assert months[0]["previous_revenue"] is None and months[1]["revenue_growth_rate"] == -0.5
    found = detect_anomalies(enriched, monthly_summary(enriched)).collect()
    assert [(a["anomaly_type"], a["details"]) for a in found] == [(
        "sales_drop_over_20_percent",
        "March 2026 revenue decreased by 50.0% compared with January 2026, a reduction of $50.00.",
    )]


def test_one_month_partial_at_both_ends_names_the_later_gap(spark):
    rows = [("1", "2026-01-10", "c", "n", "p", "x", "k", "1", "1", "0", "false")]
    month = monthly_summary(add_revenue(fx.orders(spark, rows))).first()
    assert month["partial_reason"] == "Partial month through 2026-01-10"


def test_null_category_fails_reconciliation(spark):
    rows = [list(row) for row in fx.CLEAN_ORDERS]
    rows[0][6] = None
    tables = order_report(fx.orders(spark, [tuple(row) for row in rows]))
    failed = {r["check_name"] for r in tables["validation_report"].where("status = 'failed'").collect()}
    assert failed == {
        "category_summary_revenue_equals_enriched_orders_final_revenue",
        "category_gross_revenue_equals_enriched_orders_gross_revenue", "category_units_equals_enriched_orders_units",
    }


def test_numeric_names_become_labels(spark):
    rows = [(*row[:6], str(i), *row[7:]) for i, row in enumerate(fx.CLEAN_ORDERS)]
    enriched = add_revenue(fx.orders(spark, rows).drop("customer_name"))
    row = enriched.orderBy("source_row_number").first()
    assert (row["category"], row["customer_name"], row["product_name"]) == ("Category 0", "Customer C001", "Beans")
    assert add_revenue(fx.orders(spark, rows).drop("category")).first()["category"] == "Unknown"


def test_duplicates_are_whole_and_numbered(spark):
    rows = [fx.CLEAN_ORDERS[i] for i in (3, 1, 0, 1, 3, 3)]
    enriched = add_revenue(fx.orders(spark, rows))
    found = [(r["duplicate_group_id"], r["source_row_number"], r["duplicate_group_count"], r["duplicate_row_count"])
             for r in duplicate_rows(enriched).orderBy("source_row_number").collect()]
    assert found == [(2, 2, 2, 5), (1, 3, 2, 5), (1, 5, 2, 5), (2, 6, 2, 5), (2, 7, 2, 5)]


def test_repeated_ids_have_one_row_each_and_all_their_rows(spark):
    rows = [(i + 2, "hot" if i % 3 else f"id{i}", i % 2) for i in range(60)]
    rows += [(62, "pair", 1), (63, "pair", 1), (64, None, 1), (65, None, None)]
    df = spark.createDataFrame(rows, "source_row_number bigint, order_id string, v int")
    found = {r["order_id"]: (r["occurrence_count"], r["rows_are_fully_identical"]) for r in repeated_order_ids(df).collect()}
    assert found == {"hot": (40, False), "pair": (2, True), None: (2, False)}
    places = sorted(r["source_row_number"] for r in repeated_order_id_rows(df).collect())
    assert places == [i + 2 for i in range(60) if i % 3] + [62, 63, 64, 65]
    assert repeated_order_ids(df.limit(0)).isEmpty() and repeated_order_id_rows(df.limit(0)).isEmpty()


def test_global_numbering_matches_a_sort(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(7)
    found = numbered_in_order(df, [F.col("v")], "n").collect()
    assert [r["v"] for r in sorted(found, key=lambda r: r["n"])] == sorted(r["v"] for r in found)
    assert sorted(r["n"] for r in found) == list(range(1, 5001))


def test_column_mapping_errors(spark):
    df = fx.orders(spark, fx.CLEAN_ORDERS)
    for mapping in ({"order_id": "nope"}, {"a": "date", "b": "date"}, {"order_id": "date"}):
        with pytest.raises(ColumnMappingError):
            rename_columns(df, mapping)
    assert missing_columns(rename_columns(df.withColumnRenamed("date", "day"), {"date": "day"})) == []


def test_store_ids_names_and_unassigned(spark):
    rows = [("3.0", "A"), ("3", "B"), (None, "C"), (" ", None)]
    df = spark.createDataFrame(
        [(i, f"o{i}", a, b, 10.0, 1.0) for i, (a, b) in enumerate(rows)],
        "source_row_number bigint, order_id string, store_id string, store_name string, final_revenue double, quantity double",
    )
    found = {r["store_name"]: (r["store_id"], r["orders"], r["revenue_share"]) for r in store_summary(df).collect()}
    assert found == {"A": ("3", 2, 0.5), "C": (None, 1, 0.25), "Unassigned Store": (None, 1, 0.25)}


CHOICES = [
    mp.FieldChoice("order_id", source="Order Number"), mp.FieldChoice("date", source="Order Date"),
    mp.FieldChoice("product_id", source="SKU"), mp.FieldChoice("unit_price", source="Unit Price"),
    mp.FieldChoice("quantity", source="Quantity"), mp.FieldChoice("discount_rate", "default_zero"),
    mp.FieldChoice("returned", "not_provided"),
]


def source(spark, prices=("10", "20", "$30", "40"), quantities=("1", "2", "3", "4"), dates=("2026-01-01",) * 4):
    rows = [(i + 2, f"A-{i}", dates[i], f"00{i}", prices[i], quantities[i]) for i in range(4)]
    return spark.createDataFrame(
        rows, 'source_row_number bigint, `Order Number` string, `Order Date` string, SKU string, '
              '`Unit Price` string, Quantity string')


def test_mapped_report_switches_off_missing_analyses(spark):
    tables, preflight = mapped_report(source(spark), CHOICES, fact_table="Sales")
    assert preflight.can_generate and tables["customer_summary"].isEmpty()
    status = as_dict(tables["validation_report"], "check_name", "status")
    assert status["customer_units_equals_enriched_orders_units"] == "not_applicable"
    assert {r["return_rate"] for r in tables["monthly_summary"].collect()} == {None}
    assert {r["product_id"] for r in tables["enriched_orders"].collect()} == {"000", "001", "002", "003"}
    assert tables["report_status"].first()["status"] == "ready"
    assert as_dict(tables["report_coverage"], "analysis", "coverage_status") == {
        "Return analysis": "not_available", "Store analysis": "not_available",
    }
    audit = as_dict(tables["data_preparation_summary"], "item", "value_double")
    assert audit["final_calculation_rows"] == 4


def test_severe_conversion_failure_blocks(spark):
    with pytest.raises(ReportError, match="quantity"):
        mapped_report(source(spark, quantities=("bad", "bad", "3", "4")), CHOICES)


def test_preflight_only_drops_rows_on_request(spark):
    unified = mp.unified_orders(source(spark, prices=(None, "20", "30", "40"), dates=("bad",) + ("2026-01-01",) * 3),
                                CHOICES, carry=["source_row_number"])
    unified = unified.withColumn("unified_row_number", F.col("source_row_number") - 1)
    strict = run_preflight(unified, {"returned": "not_provided"})
    assert not strict.can_generate and strict.rows.count() == 4
    assert {r["code"] for r in strict.issues.collect()} == {"invalid_price_or_quantity", "invalid_date_decision_required"}
    loose = run_preflight(unified, {"returned": "not_provided"}, EXCLUDE_FROM_MONTHLY, True)
    assert loose.can_generate and loose.rows.count() == 3 and loose.excluded.first()["unified_row_number"] == 1


def test_mapping_plan_errors(spark):
    df = source(spark)
    with pytest.raises(mp.MappingError):
        mp.check_choices(df, CHOICES[1:])
    with pytest.raises(mp.MappingError):
        mp.check_choices(df, [*CHOICES, mp.FieldChoice("category", source="SKU")])
    with pytest.raises(mp.MappingError):
        mp.check_choices(df, [*CHOICES[:-1], mp.FieldChoice("returned", "omit")])


def test_customer_conflict_is_named():
    choices = [mp.FieldChoice("customer_id", source="Shipper ID")]
    assert "classified as shipper" in mp.entity_conflict("customer", choices)
    assert mp.entity_conflict("customer", [mp.FieldChoice("customer_id", source="Customer ID")]) is None


def test_csv_round_trip(spark, tmp_path):
    names = [part.split(" ")[0] for part in fx.ORDER_COLUMNS.split(", ")]
    lines = [";".join(names)] + [";".join("" if v is None else v for v in row) for row in fx.FAULTY_ORDERS]
    path = tmp_path / "orders.csv"
    path.write_text("\n".join(lines), encoding="utf-8")
    tables = run_report(spark, str(path), str(tmp_path / "none.csv"), str(tmp_path / "out"))
    assert [r["source_row_number"] for r in tables["enriched_orders"].orderBy("order_id").collect()] == list(range(2, 8))
    assert totals(tables) == (702.0, 5.0, 86.0, 18.0)
    assert as_dict(tables["finance_status"], "metric", "value_text")["finance_module_status"] == "skipped"
    facts = {(r["section"], r["metric"]): r for r in spark.read.parquet(str(tmp_path / "out/headline_facts")).collect()}
    assert facts[("executive", "dated_revenue")]["value_double"] == 702.0
    assert facts[("status", "report_status")]["label"] == "failed"


@pytest.mark.parametrize("module, name, query", [
    (preparation, "order_report", "adapted_validation"), (reports.qu, "raw_quality", "report_status"),
    (reports.qu, "raw_quality", "quality_checks"), (preparation.qu, "raw_quality", "action_required"),
])
def test_rows_that_are_read_many_times_are_joined_once(spark, tmp_path, monkeypatch, module, name, query):
    """Small tables of its own; the rows handed on are read from a written copy, not joined again by each reader."""
    rows = {
        "lineitem": "select 1L l_orderkey, 1L l_partkey, 1L l_suppkey, 1 l_linenumber, 2D l_quantity, 0.1D l_discount, 'N' l_returnflag",
        "orders": "select 1L o_orderkey, 1L o_custkey, timestamp_ntz'2024-01-02' o_orderdate",
        "part": "select 1L p_partkey, 'p' p_name, 'b' p_brand, 3D p_retailprice",
        "customer": "select 1L c_custkey, 'c' c_name", "supplier": "select 1L s_suppkey, 's' s_name",
        "events": "select 1L event_id, timestamp_ntz'2024-01-02' ts, 'e' event_type, 1D value",
    }
    for table, sql in rows.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{table}.parquet")
    real, given = getattr(module, name), []
    monkeypatch.setattr(module, name, lambda orders, *args, **more: (given.append(orders), real(orders, *args, **more))[1])
    contract.queries()[query](spark, str(tmp_path)).collect()
    assert given and not any("Join" in orders._jdf.queryExecution().optimizedPlan().toString() for orders in given)
