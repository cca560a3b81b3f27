import datetime

import pytest
from pyspark.sql import functions as F

from orderglass.functions.dates import parse_date
from orderglass.functions.flags import mapped_flag, order_file_flag
from orderglass.functions.keys import canonical_key, text_key
from orderglass.functions.labels import entity_label, identifier_label, numeric_only, store_key_text
from orderglass.functions.numbers import exact_sum, lenient_number, safe_divide, strict_number
from orderglass.functions.text import drop_missing_texts, is_present, money_text


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [row[0] for row in df.orderBy("i").select(expression(F.col("c"))).collect()]


def test_lenient_number(spark):
    texts = ["$1,299.50", "EUR 20.25", "2 units", "(5)", "($1,200)", "(-7)", "bad", "1d", "nan", "1e3", "1-2", None]
    expected = [1299.5, 20.25, 2.0, -5.0, -1200.0, -7.0, None, 1.0, None, 1000.0, None, None]
    assert values(spark, texts, lenient_number) == expected
    assert values(spark, ["10%", "0", "0.25", "5%"], lambda c: lenient_number(c, percentage=True)) == [
        pytest.approx(v) for v in (0.10, 0.0, 0.25, 0.05)
    ]


def test_strict_number_rejects_what_a_jvm_cast_accepts(spark):
    assert values(spark, ["1d", "Infinity", "NaN", " 7 ", "1,000", "abc", "1e999"], strict_number) == [
        None, None, None, 7.0, None, None, None
    ]


@pytest.mark.parametrize("text, expected", [
    ("2024-01-01", (2024, 1, 1)), ("2024/01/02", (2024, 1, 2)), ("2024-1-5", (2024, 1, 5)),
    ("Jan 3 2024", (2024, 1, 3)), ("January 3, 2024", (2024, 1, 3)), ("3-Jan-24", (2024, 1, 3)),
    ("01/02/2024", (2024, 1, 2)), ("13/02/2024", (2024, 2, 13)), ("1/2/24", (2024, 1, 2)),
    ("20240105", (2024, 1, 5)), ("2024年1月5日", (2024, 1, 5)), ("2024", (2024, 1, 1)),
    ("not-a-date", None), ("2024-02-30", None), ("12:30", None), ("", None),
])
def test_parse_date(spark, text, expected):
    found = values(spark, [text], parse_date)[0]
    assert found == (datetime.datetime(*expected) if expected else None)


def test_parse_date_options_and_clock(spark):
    assert values(spark, ["01/02/2024"], lambda c: parse_date(c, day_first=True)) == [datetime.datetime(2024, 2, 1)]
    assert values(spark, ["13/02/2024"], lambda c: parse_date(c, swap_impossible=False)) == [None]
    assert values(spark, ["1/2/2024 3:05 PM", "2024-01-05T13:04:05"], parse_date) == [
        datetime.datetime(2024, 1, 2, 15, 5), datetime.datetime(2024, 1, 5, 13, 4, 5)
    ]


def test_parse_date_names_each_step_once(spark):
    """A step that is mentioned several times runs several times, and the code outgrows what the JVM compiles."""
    plan = spark.range(1).select(parse_date(F.col("id").cast("string")).alias("date"))._jdf.queryExecution().analyzed()
    assert plan.toString().count("regexp_replace(") <= 20


def test_lenient_number_reads_its_text_once(spark):
    """A filter computes an expression as often as it is mentioned."""
    plan = spark.range(1).select(lenient_number(F.col("id").cast("string")).alias("n"))._jdf.queryExecution().analyzed()
    assert plan.toString().count("regexp_replace(") == 2
    assert values(spark, ["1e999", "(1,250.5)", "EUR 3"], lenient_number) == [None, -1250.5, 3.0]


def test_returned_texts_differ_between_routes(spark):
    texts = ["yes", "Returned", "0", " ", None, "unknown", "退货", "未退货"]
    assert values(spark, texts, order_file_flag) == [True, True, False, False, None, None, None, None]
    assert values(spark, texts, mapped_flag) == [True, True, False, None, None, None, True, False]


def test_present_and_missing_texts(spark):
    assert values(spark, ["a", " ", "　", None], is_present) == [True, False, False, False]
    df = spark.createDataFrame([("NA", "x"), ("null", "N/A"), ("ok", "")], "a string, b string")
    assert [tuple(row) for row in drop_missing_texts(df).collect()] == [(None, "x"), (None, None), ("ok", None)]


def test_safe_divide_and_money(spark):
    row = spark.range(1).select(
        safe_divide(F.lit(1), F.lit(0)), safe_divide(F.lit(None), F.lit(2)), safe_divide(F.lit(1), F.lit(4)),
        money_text(F.lit(-1234.5)),
    ).first()
    assert tuple(row) == (0.0, 0.0, 0.25, "-$1,234.50")


def test_exact_sum_does_not_depend_on_order(spark):
    df = spark.range(10_000).select((F.col("id") * 0.1 - 300).alias("v"))
    up, down = (df.orderBy(o).agg(exact_sum(F.col("v"))).first()[0] for o in (F.asc("v"), F.desc("v")))
    assert up == down == sum((i - 3000) for i in range(10_000)) / 10
    assert df.where("v > 1e9").agg(exact_sum(F.col("v"))).first()[0] == 0


def test_labels(spark):
    assert values(spark, ["12.0", " ", "x"], lambda c: entity_label(c, "Customer")) == ["Customer 12", None, "Customer x"]
    assert values(spark, ["12.0", "1.5"], lambda c: identifier_label(c, "Category")) == ["Category 12", "Category 1.5"]
    assert values(spark, ["3.0", "03", None], store_key_text) == ["3", "03", None]
    df = spark.createDataFrame([("1", "1", None), ("2.0", "x", None)], "a string, b string, c string")
    assert tuple(df.limit(1).select(*[numeric_only(df, n) for n in "abc"]).first()) == (True, False, False)


def test_keys(spark):
    texts = ["  A​B ", "ＡＢ", "a  b", "NaN", "ẞ"]
    assert values(spark, texts, lambda c: text_key(c, True)) == ["ab", "ab", "a b", None, "ss"]
    numbers = ["1,000", "1000.0", "1e3", "007", "1.50", "1.5", "12345678901234567", "x"]
    found = values(spark, numbers, lambda c: canonical_key(c, "numeric"))
    assert found[0] == found[1] == found[2] == "1000" and found[3] == "7"
    assert found[4] == found[5] and found[6] == "12345678901234567" and found[7] is None
    assert values(spark, ["01/05/2026", "2026-01-05 10:00"], lambda c: canonical_key(c, "date")) == ["2026-01-05"] * 2


def test_texts_round_half_to_even_on_the_exact_value(spark):
    from orderglass.functions.text import money_text, percent_text

    values = [0.3125, 0.3375, -0.0625, 0.0, 1.0, 0.12345, 1e-9, 12.00049]
    amounts = [318334.095, 1326389.17, -0.125, 0.375, 2.675, 0.0, 1234567890.005, -12.0]
    rows = spark.createDataFrame(list(zip(values, amounts, strict=True)), "v double, a double")
    found = rows.select(percent_text(rows.v).alias("p"), money_text(rows.a).alias("m")).collect()
    assert [r["p"] for r in found] == [f"{v * 100:.1f}%" for v in values]
    assert [r["m"] for r in found] == [("-" if a < 0 else "") + f"${abs(a):,.2f}" for a in amounts]


def test_sum_survives_absurd_values(spark):
    from orderglass.functions.numbers import exact_sum, strict_number

    rows = spark.createDataFrame([(1e19,), (0.25,), (None,)], "x double")
    assert float(rows.agg(exact_sum(rows.x).alias("s")).head()["s"]) == 1e19
    assert rows.unionAll(spark.createDataFrame([(1e60,)], "x double")).agg(exact_sum(F.col("x")).alias("s")).head()["s"] is None
    texts = spark.createDataFrame([("1e120",), ("1e999",), ("9" * 250,)], "t string")
    assert [r[0] for r in texts.select(strict_number(texts.t)).collect()] == [1e120, None, 1e250]
