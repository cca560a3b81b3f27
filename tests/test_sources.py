import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from orderglass.sources.sink import publish_report, published_report
from orderglass.sources.tables import (
    read_expenses, read_table, read_tables, sniff_delimiter, spread, unique_table_id, with_row_numbers,
)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_stays_text_and_missing_becomes_null(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,v\n001,NA\n2,\n3,x y\n")
    assert [tuple(r) for r in read_table(spark, path).collect()] == [("001", None), ("2", None), ("3", "x y")]


@pytest.mark.parametrize("delimiter", [";", "|", "\t", ","])
def test_delimiter(spark, tmp_path, delimiter):
    path = write(tmp_path / "a.csv", "\n".join(delimiter.join(row) for row in (("a", "b"), ("1", "2"), ("3", "4"))))
    assert sniff_delimiter(spark, path) == delimiter
    assert read_table(spark, path).columns == ["a", "b"]


def test_row_numbers_follow_file_order_over_many_blocks(spark, tmp_path):
    folder = tmp_path / "orders"
    folder.mkdir()
    for part in range(3):
        write(folder / f"part-{part}.csv", "n\n" + "\n".join(str(part * 1000 + i) for i in range(1000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = with_row_numbers(spark, str(folder), delimiter=",").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["source_row_number"], int(r["n"])) for r in rows) == [(i + 2, i) for i in range(3000)]


def test_parquet_row_numbers_and_existing_numbers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 500, 1, 4).write.parquet(path)
    rows = with_row_numbers(spark, path, file_format="parquet").collect()
    assert sorted(r["source_row_number"] for r in rows) == list(range(2, 502))
    kept = str(tmp_path / "k.parquet")
    spark.range(3).select((F.col("id") * 10).alias("source_row_number")).write.parquet(kept)
    assert sorted(r[0] for r in with_row_numbers(spark, kept).collect()) == [0, 10, 20]


def test_rows_of_one_file_stay_spread_while_they_are_numbered(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    pq.write_table(pa.table({"n": list(range(4000))}), path, row_group_size=500)
    # No table counts as small, as with a large one; a shuffle by file would make one piece of all rows.
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.files.maxPartitionBytes": "3000"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = with_row_numbers(spark, path).select("*", F.spark_partition_id().alias("p")).collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert sorted((r["source_row_number"], r["n"]) for r in rows) == [(i + 2, i) for i in range(4000)]
    assert len({r["p"] for r in rows}) > 1


def test_spread_counts_the_pieces_of_the_scan(spark):
    few, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, 64)
    numbered = few.join(F.broadcast(few.groupBy("id").count()), "id")
    assert spread(numbered, many) is numbered
    assert spread(numbered, few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_many_tables_get_unique_ids(spark, tmp_path):
    (tmp_path / "x").mkdir()
    a, b = write(tmp_path / "t.csv", "a\n1\n"), write(tmp_path / "x" / "t.csv", "a\n1\n")
    assert list(read_tables(spark, [a, b])) == ["t", "t#2"]
    assert unique_table_id("n", set()) == "n"


def test_expenses_may_be_absent_but_not_incomplete(spark, tmp_path):
    assert read_expenses(spark, str(tmp_path / "none.csv")) is None
    with pytest.raises(ValueError, match="amount"):
        read_expenses(spark, write(tmp_path / "e.csv", "expense_id,date,expense_category\n1,2026-01-01,Rent\n"))
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "none.csv"))


def test_spread_only_touches_small_scans(spark):
    few, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, 64)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(many) is many


def test_report_is_published_as_a_whole(spark, tmp_path):
    folder = str(tmp_path / "report")

    def tables(n):
        return {"report_status": spark.range(n), "monthly_summary": spark.range(2 * n).withColumn("_h", F.lit(1))}

    publish_report(tables(2), folder)
    broken = {**tables(5), "anomalies": spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))}
    with pytest.raises(Exception, match="lost"):
        publish_report(broken, folder)
    found = published_report(spark, folder)
    assert {name: df.count() for name, df in found.items()} == {"report_status": 2, "monthly_summary": 4}
    assert found["monthly_summary"].columns == ["id"]
    publish_report(tables(3), folder)
    assert published_report(spark, folder)["report_status"].count() == 3
    assert found["report_status"].count() == 2
