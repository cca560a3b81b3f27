"""Reading order, expense and dimension tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderglass.functions.text import drop_missing_texts, quoted
from orderglass.operators.revenue import EXPENSE_COLUMNS, ORDER_COLUMNS, missing_columns, rename_columns
from orderglass.session import stage

DELIMITERS = (",", ";", "|", "\t")
FIRST_ROW_NUMBER = 2


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def spread(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Give every core a share of a scan that comes in fewer pieces than there are cores.

    A file with one row group is one task, however costly the expressions on top are. On a large table the scan
    has far more pieces than cores and stays untouched. ``scan`` is the table under a ``df`` that keeps its pieces:
    to count the pieces of a frame with an aggregate in it would run that aggregate.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if (scan or df).rdd.getNumPartitions() < cores else df


def sniff_delimiter(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The delimiter of a text table, from its header line alone: a comma if it has one, else the most frequent
    of the others, else a comma. Pass ``delimiter`` where a header holds it in its names.
    """
    header = spark.read.option("encoding", encoding).text(path).where("value <> ''").first()
    if header is None or "," in header[0]:
        return ","
    return max(DELIMITERS, key=header[0].count)


def _csv_reader(spark: SparkSession, path: str, encoding: str, delimiter: str | None, multi_line: bool):
    delimiter = delimiter or sniff_delimiter(spark, path, encoding)
    return (
        spark.read.option("header", True).option("encoding", encoding).option("sep", delimiter)
        .option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        # All text: inference would cost a second read and would eat the leading zeros of ids.
        .option("inferSchema", False)
    )


def _table_format(spark: SparkSession, path: str, file_format: str | None) -> str:
    """``csv`` or ``parquet``: as given, else by the suffix; a folder without one is read as CSV."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Could not find the table: {path}")
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower().lstrip(".")
    found = (file_format or {"txt": "csv", "tsv": "csv", "": "csv"}.get(suffix, suffix)).lower()
    if found not in ("csv", "parquet"):
        raise ValueError(f"Unsupported table {path!r}. Supported formats: CSV and parquet.")
    return found


def read_table(
    spark: SparkSession, path: str, encoding: str = "UTF-8", delimiter: str | None = None, multi_line: bool = False,
    file_format: str | None = None,
) -> DataFrame:
    """A parquet table as it is, or a CSV table with all columns as text and missing-cell texts as null."""
    if _table_format(spark, path, file_format) == "parquet":
        return spark.read.parquet(path)
    return drop_missing_texts(_csv_reader(spark, path, encoding, delimiter, multi_line).csv(path))


def with_row_numbers(
    spark: SparkSession, path: str, encoding: str = "UTF-8", delimiter: str | None = None, multi_line: bool = False,
    file_format: str | None = None,
) -> DataFrame:
    """A table plus ``source_row_number``: the position over all its files in path order, header = line 1.

    A table that already carries the column keeps it.

    No global sort and no single task over the rows. Parquet rows already know their position in the file; CSV
    rows are staged once with the block they came from. Only the row counts per file or block are summed up in
    order, and those are as few as there are blocks. They are broadcast: a shuffle by file would bring all rows of
    a file to one task.
    """
    kind = _table_format(spark, path, file_format)
    plain = read_table(spark, path, encoding, delimiter, multi_line, kind)
    if "source_row_number" in plain.columns:
        return plain
    if kind == "parquet":
        rows = plain.select(
            "*", F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("bigint").alias("_block"),
            F.col("_metadata.row_index").alias("_spot"),
        )
    else:
        source = _csv_reader(spark, path, encoding, delimiter, multi_line).csv(path)
        rows = stage(drop_missing_texts(source).withColumns({
            "_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"),
            "_spot": F.monotonically_increasing_id(),
        }), "numbered")
    blocks = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_spot").alias("_first"))
    before = F.coalesce(
        F.sum("_n").over(W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = blocks.select("_file", "_block", "_first", before.alias("_before"))
    number = F.col("_before") + F.col("_spot") - F.col("_first") + FIRST_ROW_NUMBER
    numbered = rows.join(F.broadcast(offsets), ["_file", "_block"]).withColumn("source_row_number", number)
    return numbered.select("source_row_number", *map(quoted, plain.columns))


def unique_table_id(name: str, used: set[str]) -> str:
    candidate, number = name, 2
    while candidate in used:
        candidate, number = f"{name}#{number}", number + 1
    used.add(candidate)
    return candidate


def read_tables(
    spark: SparkSession, sources: str | Sequence[str] | Mapping[str, str], **options
) -> dict[str, DataFrame]:
    """Several tables under unique ids: the given name or the file stem, with ``#2`` on a collision."""
    if isinstance(sources, str):
        sources = [sources]
    named = list(sources.items()) if isinstance(sources, Mapping) else [
        (PurePosixPath(path.rstrip("/")).stem, path) for path in sources
    ]
    used: set[str] = set()
    return {unique_table_id(str(name), used): read_table(spark, path, **options) for name, path in named}


def read_orders(
    spark: SparkSession, path: str, mapping: Mapping[str, str | None] | None = None, numbered: bool = True, **options
) -> DataFrame:
    """The order table under standard names; the caller checks :func:`missing_columns` before using it."""
    reader = with_row_numbers if numbered else read_table
    return rename_columns(reader(spark, path, **options), mapping)


def read_expenses(
    spark: SparkSession, path: str | None, mapping: Mapping[str, str | None] | None = None, **options
) -> DataFrame | None:
    """The expense table, or None when there is no such file; missing columns are an error."""
    if path is None or not path_exists(spark, path):
        return None
    expenses = rename_columns(read_table(spark, path, **options), mapping)
    missing = missing_columns(expenses, EXPENSE_COLUMNS)
    if missing:
        raise ValueError(f"The expenses table lacks required columns: {', '.join(missing)}")
    return expenses


def require_order_columns(orders: DataFrame) -> None:
    missing = missing_columns(orders, ORDER_COLUMNS)
    if missing:
        raise ValueError(
            f"The orders table lacks required columns: {', '.join(missing)}. Found: {', '.join(orders.columns)}"
        )
