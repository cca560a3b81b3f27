"""What the reports leave on disk: one copy of the order rows, no shuffle files of a written part."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from orderglass import session
from orderglass.operators import duplicates as du

REPORTS = ("adapted_validation", "headline_facts", "dashboard_kpis", "action_required")
#: Null keys, an order twice, a customer twice, lines without a part, whole lines twice.
TABLES = {
    "lineitem": """select nullif(id % 11, 10) l_orderkey, nullif(id % 5, 4) l_partkey, id % 3 l_suppkey, int(id) l_linenumber,
        double(id % 4) l_quantity, id % 3 / 10D l_discount, if(id % 6 = 0, 'R', 'N') l_returnflag from range(60)
        union all select 2L, 1L, 1L, 1, 2D, 0.1D, 'N' from range(3)""",
    "orders": """select id % 9 o_orderkey, nullif(id % 4, 3) o_custkey,
        timestamp_ntz'2024-01-02' + make_dt_interval(int(id * 9)) o_orderdate from range(10)""",
    "part": "select id p_partkey, 'p' || id p_name, 'b' || id % 2 p_brand, 3D + id p_retailprice from range(4)",
    "customer": "select id % 3 c_custkey, 'c' || id c_name from range(4)",
    "supplier": "select id s_suppkey, 's' || id s_name from range(3)",
    "events": "select id event_id, timestamp_ntz'2024-01-02' ts, 'e' event_type, 1D value from range(5)",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    for name, sql in TABLES.items():
        spark.sql(sql).coalesce(1).write.parquet(f"{top}/{name}.parquet")
    return str(top)


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(place).getName() for place in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_written_parts_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    parts = [spark.range(100).where(F.col("id") % 2 == place).groupBy(F.col("id") % 10).count() for place in (0, 1)]
    written = session.stage_parts(parts, "test")
    assert shuffle_files(spark) <= before
    assert {row[0]: row[1] for row in written.collect()} == {key: 10 for key in range(10)}
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "false"


@pytest.mark.parametrize("query", REPORTS)
def test_order_rows_are_written_once_and_no_shuffle_of_them_stays(spark, folder, tmp_path, monkeypatch, query):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    before = shuffle_files(spark)
    table = contract.queries()[query](spark, folder)
    left = len({name.split("_")[1] for name in shuffle_files(spark) - before})
    assert left <= 4  # counts the driver takes: repeated hashes, availability
    written = {path.name: spark.read.parquet(str(path)) for path in (tmp_path / "orderglass").iterdir()}
    copies = [name for name, rows in written.items()
              if {"order_id", "quantity", "discount_rate"} <= set(rows.columns) and rows.count() >= 40]
    assert len(copies) == 1, copies
    assert not table.isEmpty()


@pytest.mark.parametrize("query", REPORTS)
def test_slices_give_the_result_of_the_whole(spark, folder, monkeypatch, query):
    whole = rows_of(contract.queries()[query](spark, folder))
    monkeypatch.setattr(session, "SLICE_BYTES", 100)
    assert session.slice_count(spark.read.parquet(f"{folder}/lineitem.parquet")) == session.MOST_SLICES
    assert rows_of(contract.queries()[query](spark, folder)) == whole


def test_few_repeated_rows_move_no_other_row(spark, folder, monkeypatch):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    found = du.duplicate_groups(lines, lines.columns)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found.select("*")._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [row["copies"] for row in found.collect()] == [3]
    monkeypatch.setattr(du, "BROADCAST_HASHES", 0)
    for size in (session.SLICE_BYTES, 100):
        monkeypatch.setattr(session, "SLICE_BYTES", size)
        assert rows_of(du.duplicate_groups(lines, lines.columns)) == rows_of(found)


def test_whole_number_store_ids_need_no_cleaning(spark):
    from orderglass.functions.labels import store_key_text
    ids = spark.sql("select * from values (3L), (-40L), (null) as t(id)")
    typed, texts = store_key_text(F.col("id"), ids.schema["id"].dataType), store_key_text(F.col("id"))
    assert ids.where(typed.eqNullSafe(texts)).count() == 3
