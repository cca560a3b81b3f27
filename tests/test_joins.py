import itertools
import random

import pytest
from pyspark.sql import functions as F

from orderglass.functions.keys import canonical_key
from orderglass.operators.discovery import discover_relationships, evaluate_candidate
from orderglass.operators.join_safety import join_safety, leading_zero_overlap
from orderglass.operators.preflight import drop_selected_rows
from orderglass.plans.join_plan import JoinStep, run_join_plan
from orderglass.sources.damage import text_damage


def table(spark, column, keys, extra=()):
    names = [column, *[name for name, _ in extra]]
    rows = [tuple([key, *[values[i] for _, values in extra]]) for i, key in enumerate(keys)]
    return spark.createDataFrame(rows, names)


def test_safety_predicts_the_real_join(spark):
    rng = random.Random(7)
    for size in (1, 2, 30):
        left = [rng.choice([None, *range(size)]) for _ in range(40)]
        right = [rng.choice([None, *range(size + 2)]) for _ in range(25)]
        a = spark.createDataFrame([(k,) for k in left], "k int")
        b = spark.createDataFrame([(k,) for k in right], "k int")
        row = join_safety(a, b, ["k"], ["k"], ["numeric"]).first()
        joined = a.join(b.withColumnRenamed("k", "j"), F.col("k") == F.col("j"), "left").count()
        assert (row["before_row_count"], row["after_row_count"]) == (40, joined)
        assert row["match_rate"] == sum(k is not None and k in right for k in left) / 40
        assert row["right_null_key_count"] == right.count(None)
        repeats = lambda keys, k: keys.count(k) > 1
        assert row["many_to_many_risk"] == any(
            k is not None and repeats(left, k) and repeats(right, k) for k in set(left) & set(right))


def test_duplicate_right_key_is_blocked(spark):
    row = join_safety(
        table(spark, "k", [1, 1, 2, 3]), table(spark, "k", [1, 1, 2, 3]), ["k"], ["k"], ["numeric"]
    ).first()
    assert row["blocked"] and row["many_to_many_risk"] and (row["before_row_count"], row["after_row_count"]) == (4, 6)
    assert row["expected_join_type"] == "many_to_many"


def test_line_to_header_needs_twenty_percent(spark):
    left, right = table(spark, "k", [1, 90, 91, 92, 93, 94]), table(spark, "k", [1, 2, 3])
    args = (left, right, ["k"], ["k"], ["numeric"], "fact", "fact")
    low = join_safety(*args, "order_line", "order_header").first()
    assert low["risk_flags"] == ["order_line_to_header_low_match"] and not low["fact_to_fact_risk"]
    assert join_safety(*args).first()["risk_flags"] == ["fact_to_fact"]


def test_unicode_keys_meet(spark):
    left = table(spark, "code", ["ＡＢ１", " ab​2 ", "ab 3"])
    right = table(spark, "code", ["AB1", "Ab2", "AB 3"])
    assert join_safety(left, right, ["code"], ["code"]).first()["match_rate"] == 1.0


def test_leading_zero_warning(spark):
    row = leading_zero_overlap(table(spark, "a", ["001", "002"]), table(spark, "b", ["1", "2"]), "a", "b").first()
    assert (row["text_overlap"], row["numeric_overlap"]) == (0, 2) and row["format_warning"]


SNOWFLAKE = (
    JoinStep("lines", ("order",), "orders", ("id",), ("numeric",)),
    JoinStep("orders", ("cust",), "people", ("id",), ("text",)),
)


def snowflake(spark, people=("x", "y")):
    return {
        "lines": table(spark, "order", [1, 1, 2, 9]),
        "orders": table(spark, "id", [1, 2], [("cust", ["X", "z"])]),
        "people": table(spark, "id", list(people), [("name", [f"n{i}" for i in range(len(people))])]),
    }


def test_snowflake_keeps_rows_and_counts_matches(spark):
    result = run_join_plan(snowflake(spark), "lines", SNOWFLAKE)
    assert result.success and result.frame.count() == 4
    assert sorted(str(r["people.name"]) for r in result.frame.collect()) == ["None", "None", "n0", "n0"]
    found = [(r["matched_rows"], r["unmatched_rows"], r["row_growth"]) for r in result.diagnostics.orderBy("step_id").collect()]
    assert found == [(3, 1, 0), (2, 2, 0)]


def test_unsafe_step_returns_no_data(spark):
    result = run_join_plan(snowflake(spark, ("x", "x")), "lines", SNOWFLAKE)
    assert not result.success and result.frame is None
    last = result.diagnostics.orderBy("step_id").collect()[-1]
    assert last["validation_status"] == "blocked_preflight" and last["row_growth"] == 2


@pytest.mark.parametrize("steps, word", [
    ((JoinStep("a", ("k",), "b", ("k",)), JoinStep("c", ("k",), "b", ("k",))), "only once"),
    ((JoinStep("b", ("k",), "c", ("k",)), JoinStep("c", ("k",), "b", ("k",))), "cycle"),
    ((JoinStep("a", ("k",), "b", ("k",)), JoinStep("d", ("k",), "c", ("k",))), "Unreachable"),
    ((JoinStep("b", ("k",), "a", ("k",)),), "points back"),
    ((JoinStep("a", ("k",), "a", ("k",)),), "itself"),
    ((JoinStep("a", ("k",), "nope", ("k",)),), "unknown table"),
    ((), "At least one"),
])
def test_plan_rules(spark, steps, word):
    tables = {name: table(spark, "k", [1]) for name in "abcd"}
    result = run_join_plan(tables, "a", steps)
    assert not result.success and word in result.error_message


def test_single_table_plan_is_the_identity(spark):
    tables = {"a": table(spark, "k", [1, 2])}
    assert run_join_plan(tables, "a", ()).frame.count() == 2


def sales(spark):
    n = 40
    return {
        "Sales": table(spark, "Order Number", [f"S{i}" for i in range(n)], [
            ("Order Date", ["2026-01-01"] * n), ("CustomerKey", [i % 8 + 1 for i in range(n)]),
            ("ProductKey", [i % 5 + 1 for i in range(n)]), ("Amount", [float(i) for i in range(n)]),
        ]),
        "Customers": table(spark, "CustomerKey", list(range(1, 9)), [
            ("Customer Name", [f"n{i}" for i in range(8)]), ("Segment", ["s"] * 8)]),
    }


def test_discovery_finds_the_customer_key(spark):
    tables = sales(spark)
    found = discover_relationships(tables)
    best = found.candidate_rows[0]
    assert best["candidate_id"] == "Sales[CustomerKey]->Customers[CustomerKey]"
    assert best["confidence_score"] >= 80 and best["status"] == "pending" and not best["blocked"]
    again = evaluate_candidate(tables, found, "Sales", ["CustomerKey"], "Customers", ["CustomerKey"])
    assert again["confidence_score"] == best["confidence_score"]
    with pytest.raises(ValueError):
        evaluate_candidate(tables, found, "Sales", ["Order Date"], "Customers", ["CustomerKey"])


def test_disjoint_keys_give_no_candidate(spark):
    tables = sales(spark)
    tables["Customers"] = tables["Customers"].withColumn("CustomerKey", F.col("CustomerKey") + 100)
    assert discover_relationships(tables).candidate_rows == []


def test_composite_key(spark):
    keys = list(itertools.product(range(1, 6), range(1, 4)))
    tables = {
        "OrderLines": spark.createDataFrame([(a, b, 1.0) for a, b in keys * 2], "`Order ID` int, `Line No` int, Quantity double"),
        "LineLookup": spark.createDataFrame([(a, b, "t") for a, b in keys], "`Order ID` int, `Line No` int, note string"),
    }
    found = [r for r in discover_relationships(tables).candidate_rows if r["relationship_kind"] == "composite"]
    assert len(found) == 1 and found[0]["right_key_uniqueness"] == 1.0 and found[0]["expected_join_type"] == "many_to_one"


def test_weak_names_need_strong_values(spark):
    values = [f"X{i}" for i in range(1, 7)]
    tables = {
        "明细": table(spark, "业务编码", values * 2, [("数量", [1.0] * 12)]),
        "档案": table(spark, "主数据编码", values, [("说明", ["d"] * 6)]),
    }
    found = discover_relationships(tables).candidate_rows
    assert len(found) == 1 and found[0]["confidence_score"] < 80
    assert "weak_name_high_value_overlap" in found[0]["risk_flags"]


def test_drop_selected_rows(spark):
    rows = spark.range(5).withColumnRenamed("id", "source_row_number")
    assert drop_selected_rows(rows, rows.where("source_row_number > 2")).count() == 3


def test_text_damage(spark):
    good = spark.createDataFrame([("plain text",), ("été",)], "t string")
    bad = spark.createDataFrame([("Ã©Ã¡Ã³ �� Ã­Ã©Ã¡ Ã³Ã­Ã©",)] * 3, "t string")
    assert not text_damage(good).first()["looks_damaged"]
    assert text_damage(bad).first()["looks_damaged"]


def test_damage_is_a_share_of_the_values(spark):
    for n in (60, 6000):
        rows = spark.range(n).select(F.when(F.col("id") % 10 == 0, "锟斤拷 and more").otherwise("a plain value").alias("v"))
        found = text_damage(rows).first()
        assert (found["sequences"], found["damage_score"], found["looks_damaged"]) == (n // 10, 0.7, True)
    few = spark.range(60_000).select(F.when(F.col("id") < 6, "锟斤拷").otherwise("a plain value").alias("v"))
    assert text_damage(few).first()["damage_score"] == 0.0


def test_long_whole_numbers_stay_apart(spark):
    long = "1" * 45
    df = spark.createDataFrame([(long,), (long + ".00",), ("00" + long,), ("1" * 44 + "2",), ("-0",), ("-007",)], "k string")
    found = [r[0] for r in df.select(canonical_key(F.col("k"), "numeric")).collect()]
    assert found == [long, long, long, "1" * 44 + "2", "0", "-7"]


def test_every_equal_key_column_is_a_candidate(spark):
    columns = [F.col("id").alias("Order Key")] + [(F.col("id") * 7 + i).alias(f"Code {i} Key") for i in range(12)]
    left, right = spark.range(40).select(*columns), spark.range(40).select(*columns)
    found = discover_relationships({"Orders": left, "Codes": right}).candidates.where("left_columns = right_columns")
    assert found.where("relationship_kind = 'single_column'").count() == 13


def test_heavy_keys_are_dealt_over_all_tasks(spark):
    rows = [(i, 7 if i % 3 == 0 else None if i % 3 == 1 else i % 50) for i in range(3000)]
    lines = spark.createDataFrame(rows, "id int, shop int")
    shops = spark.createDataFrame([(i, f"s{i}", i % 3) for i in range(40)], "shop int, name string, town int")
    towns = spark.createDataFrame([(0, "a"), (1, None)], "town int, name string")
    steps = (JoinStep("lines", ("shop",), "shops", ("shop",), ("numeric",)),
             JoinStep("shops", ("town",), "towns", ("town",), ("numeric",)))
    tables = {"lines": lines, "shops": shops, "towns": towns}
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        plain = run_join_plan(tables, "lines", steps).frame
        dealt = run_join_plan(tables, "lines", steps, heavy_share=0.1).frame
        assert dealt.columns == plain.columns
        assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))

        def largest(frame):
            return max(r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect())

        one = {name: tables[name] for name in ("lines", "shops")}
        assert largest(run_join_plan(one, "lines", steps[:1]).frame) >= 1000
        assert largest(run_join_plan(one, "lines", steps[:1], heavy_share=0.1).frame) < 1000
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_heavy_share_without_heavy_keys(spark):
    lines = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, shop int")
    shops = spark.createDataFrame([(1, "a"), (3, "c")], "shop int, name string")
    step = JoinStep("lines", ("shop",), "shops", ("shop",), ("numeric",))
    frame = run_join_plan({"lines": lines, "shops": shops}, "lines", (step,), heavy_share=0.9).frame
    assert {(r["id"], r["shops.name"]) for r in frame.collect()} == {(1, "a"), (2, None), (3, None)}
    empty = run_join_plan({"lines": lines.limit(0), "shops": shops}, "lines", (step,), heavy_share=0.9).frame
    assert empty.count() == 0
