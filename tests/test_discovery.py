import math
import random

import pytest
from pyspark.sql import functions as F

from orderglass.operators import mapping as mp
from orderglass.operators import recommendation as rc
from orderglass.operators.discovery import (
    DiscoveryConfig, column_facts, discover_relationships, evaluate_candidate, named_pairs,
)
from orderglass.operators.join_safety import sample_overlap
from orderglass.operators.key_sketch import bottom_k, relative_error
from orderglass.operators.profile import column_statistics, merged_statistics, profile_columns, table_roles


def counts(spark, weights):
    return spark.createDataFrame([(0, key, n) for key, n in weights.items()], "spec int, key string, n bigint")


def test_sample_weights_add_up_to_the_rows(spark):
    weights = {f"k{i}": 1 + i % 7 for i in range(20_000)} | {"hot": 30_000}
    rows = bottom_k(counts(spark, weights), k=400).collect()
    assert len(rows) == 400 and any(r["key"] == "hot" for r in rows)
    total = sum(weights.values())
    assert abs(sum(r["weight"] for r in rows) - total) < 4 * relative_error(400) * total
    exact = bottom_k(counts(spark, dict(list(weights.items())[:50])), k=50).collect()
    assert all(r["weight"] == r["n"] for r in exact) and len(exact) == 50


def test_samples_of_parts_merge_to_that_of_the_whole(spark):
    weights = {f"k{i}": 1 + i % 5 for i in range(3_000)}
    whole = counts(spark, weights)
    halves = whole.withColumn("n", F.floor(F.col("n") / 2)).where("n > 0").unionByName(
        whole.withColumn("n", F.col("n") - F.floor(F.col("n") / 2))).groupBy("spec", "key").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, bottom_k(halves, k=100).collect())) == sorted(map(tuple, bottom_k(whole, k=100).collect()))


@pytest.mark.parametrize("matched", ["few heavy keys", "many light keys"])
def test_sampled_overlap_is_near_the_exact_one(spark, matched):
    heavy = spark.range(50_000).select((F.col("id") % 40).alias("k"))
    light = spark.range(20_000).select((F.col("id") + 1000).alias("k"))
    right = spark.range(40).select(F.col("id").alias("k")) if matched == "few heavy keys" else light
    exact = 50 / 70 if matched == "few heavy keys" else 20 / 70
    row = sample_overlap(heavy.unionByName(light), right, "k", "k", "numeric", sketch_keys=500).first()
    assert row["sampled_keys"] == 500 and abs(row["match_rate"] - exact) < 5 * row["relative_error"] * exact
    small = sample_overlap(heavy, right, "k", "k", "numeric", sketch_keys=500).first()
    assert (small["sampled_keys"], small["match_rate"]) == (40, 1.0 if matched == "few heavy keys" else 0.0)


def test_weak_pairs_are_found_by_rows_not_by_keys(spark):
    # A hundred keys hold nine tenths of the rows; most keys are unknown on the right.
    left = spark.range(90_000).select((F.col("id") % 100).alias("业务编码")).unionByName(
        spark.range(9_000).select((F.col("id") + 500_000).alias("业务编码")))
    right = spark.range(20_000).select(F.col("id").alias("主数据编码"))
    rows = discover_relationships({"明细": left, "档案": right}, DiscoveryConfig(sketch_keys=256)).candidate_rows
    assert [(r["candidate_id"], round(r["match_rate"], 4)) for r in rows] == [("明细[业务编码]->档案[主数据编码]", 0.9091)]


def test_a_chosen_composite_is_scored_and_an_unusable_part_refused(spark):
    lines = spark.range(60).select((F.col("id") % 5).alias("Order ID"), (F.col("id") % 3).alias("Line No"), F.lit(True).alias("Open"))
    lookup = spark.range(15).select((F.col("id") % 5).alias("Order ID"), (F.col("id") % 3).alias("Line No"), F.lit(True).alias("Open"))
    tables = {"OrderLines": lines, "LineLookup": lookup}
    found = discover_relationships(tables)
    row = evaluate_candidate(tables, found, "OrderLines", ["Order ID", "Line No"], "LineLookup", ["Order ID", "Line No"])
    assert (row["match_rate"], row["right_key_uniqueness"], row["relationship_kind"]) == (1.0, 1.0, "composite")
    assert row["left_columns"] == ["Order ID", "Line No"]
    with pytest.raises(ValueError, match="'Open' and 'Open'"):
        evaluate_candidate(tables, found, "OrderLines", ["Order ID", "Open"], "LineLookup", ["Order ID", "Open"])
    with pytest.raises(ValueError, match="to itself"):
        evaluate_candidate(tables, found, "OrderLines", ["Order ID"], "OrderLines", ["Order ID"])


def test_many_columns_meet_in_one_job(spark):
    wide = [F.col("id").alias(f"Customer Attribute {i} Key") for i in range(150)] + [F.col("id").alias("Store Key")]
    tables = {"a": spark.range(3).select(*wide), "b": spark.range(2).select(F.col("id").alias("Store Key"), F.col("id").alias("Note"))}
    profile = profile_columns(tables)
    pairs = named_pairs(column_facts(profile, table_roles(profile), list(tables)), 12.0)
    assert [(r["l_column_name"], r["r_column_name"], r["name"]["points"]) for r in pairs.collect()] == [("Store Key", "Store Key", 25.0)]


def test_statistics_of_days_merge_to_those_of_the_table(spark):
    df = spark.range(3_000).select(
        (F.col("id") % 700).alias("Order Key"), F.when(F.col("id") % 9 != 0, F.concat(F.lit("0"), F.col("id"))).alias("Code"),
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("Order Date"), F.lit("é").alias("Note"),
        (F.col("id") / 7).alias("Amount"),
    )
    whole = merged_statistics(column_statistics("t", df))
    days = merged_statistics(column_statistics("t", df.where("`Order Key` < 200")).unionByName(column_statistics("t", df.where("`Order Key` >= 200"))))
    plain = lambda stats: sorted(map(tuple, stats.drop("sketch").collect()))
    assert plain(whole) == plain(days)
    distinct = lambda stats: [r[0] for r in stats.orderBy("position").select(F.hll_sketch_estimate("sketch")).collect()]
    assert all(abs(a - b) <= 0.01 * a for a, b in zip(distinct(whole), distinct(days)))
    rows = {r["position"]: r for r in whole.collect()}
    assert (rows[1]["present"], rows[1]["numbers"], rows[1]["zeros"], rows[3]["foreign"], rows[2]["dates"]) == (2666, 2666, 2666, 3000, 3000)


def test_wide_tables_are_profiled_without_shuffling_cells(spark):
    df = spark.range(50).select(*[F.col("id").alias(f"c{i}") for i in range(500)])
    stats = column_statistics("t", df)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1 and "SinglePartition" in plan
    assert stats.schema.names[:3] == ["table_id", "position", "row_count"]


def test_one_to_one_is_the_greedy_matching(spark):
    pick = random.Random(4)
    rows = [(f"f{a}", f"c{b}", pick.randint(0, 6), i) for i, (a, b) in enumerate((a, b) for a in range(9) for b in range(12) if pick.random() < 0.6)]
    greedy, fields, columns = set(), set(), set()
    for field, column, score, i in sorted(rows, key=lambda r: (-r[2], r[3])):
        if field not in fields and column not in columns:
            greedy.add((field, column))
            fields.add(field)
            columns.add(column)
    df = spark.createDataFrame(rows, "field string, column string, score int, i int")
    found = rc.one_to_one(df, "field", "column", F.struct((-F.col("score")).alias("s"), "i"))
    assert {(r["field"], r["column"]) for r in found.collect()} == greedy
    assert rc.one_to_one(df.limit(0), "field", "column", F.struct("i")).count() == 0


def test_recommended_fields(spark):
    df = spark.createDataFrame(
        [("A1", "2026-01-02", "9.5", "2", "K1", "x", "n"), ("A2", "2026-01-03", "8", "1", "K2", "y", "m")],
        "`订单编号` string, `Order Date` string, `Sales Price` string, Qty string, SKU string, `Shipper ID` string, `Store Code` string",
    )
    rows = {r["standard_field"]: r for r in rc.recommend_fields(df).collect()}
    chosen = {field: rows[field]["recommended_source"] for field in mp.STANDARD_FIELDS}
    assert chosen == dict.fromkeys(mp.STANDARD_FIELDS) | {
        "order_id": "订单编号", "date": "Order Date", "unit_price": "Sales Price", "quantity": "Qty", "product_id": "SKU", "store_id": "Store Code",
    }
    assert [rows[f]["recommended_strategy"] for f in ("discount_rate", "returned", "customer_id", "category")] == ["default_zero", "not_provided", "not_provided", "omit"]
    assert rows["unit_price"]["score_breakdown"]["column_name_alias"] == 56.0 and math.isclose(rows["order_id"]["confidence_score"], 100.0)
    assert len(rc.choices_from(rc.recommend_fields(df))) == 13


def test_an_entity_of_another_kind_is_not_recommended(spark):
    df = spark.createDataFrame([("1", "a")], "`Supplier.Name` string, `Customer ID` string")
    rows = {r["standard_field"]: r["recommended_source"] for r in rc.recommend_fields(df).collect()}
    assert rows["customer_id"] == "Customer ID" and rows["customer_name"] is None and rows["product_name"] is None
    assert mp.entity_conflict("store", [mp.FieldChoice("store_id", source="Customer ID")]).startswith("Store field mapping conflict")
    assert mp.entity_conflict("store", [mp.FieldChoice("store_id", source="Whatever")]) is None
