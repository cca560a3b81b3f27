"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# A job over larger files than this goes slice by slice, so that the shuffle files of a part stand on disk at a time.
SLICE_BYTES = 512 << 20
MOST_SLICES = 6
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app_name: str = "orderglass", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the defaults above; keyword settings (dots as ``__``) win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**SESSION_DEFAULTS, **{key.replace("__", "."): value for key, value in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for durable intermediates: the session's ``spark.checkpoint.dir``.

    Where that is unset, a folder in the warehouse, which a cluster's driver and executors share as well.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or context.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/stages"
    return folder.rstrip("/")


def stage(df: DataFrame, name: str = "stage", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back, a folder per value of ``partition_by``.

    The result has no lineage to recompute after an executor is lost, and readers still get column
    pruning and filter pushdown, which a row-format checkpoint would not give them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/orderglass/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


def stage_parts(parts: Iterable[DataFrame], name: str = "stage", partition_by: Sequence[str] = ()) -> DataFrame:
    """Like :func:`stage` for a large table that comes in parts, each computed and written by a job of its own.

    The shuffle files of a part go as soon as it is written; Spark keeps them otherwise until the driver happens to
    collect its garbage. Packed tighter than by :func:`stage`.
    """
    path = schema = spark = None
    for part in parts:
        spark = part.sparkSession
        if path is None:
            path, schema = f"{shared_folder(spark)}/orderglass/{name}-{uuid.uuid4().hex}", part.schema
        before = spark.conf.get(SHUFFLE_CLEANUP)
        spark.conf.set(SHUFFLE_CLEANUP, True)
        try:
            # A frame takes the setting over when it is made.
            rows = part.select("*")
            rows.write.mode("append").parquet(path, partitionBy=list(partition_by) or None, compression="zstd")
        finally:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def slice_count(df: DataFrame) -> int:
    """In how many slices a job that shuffles all rows of ``df`` should run, by the size of the files under it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = (leaves.apply(i) for i in range(leaves.size()))
    size = sum(int(leaf.stats().sizeInBytes()) for leaf in files if leaf.nodeName().startswith("LogicalRelation"))
    return min(MOST_SLICES, 1 + size // SLICE_BYTES)


def in_slice(number: int, count: int, *columns: Column | str) -> Column:
    """Whether a row is in slice ``number`` of ``count``; equal ``columns``, nulls too, are in one slice."""
    return F.pmod(F.xxhash64(*columns), F.lit(count)) == number


def key_slices(df: DataFrame, columns: Sequence[Column | str], count: int) -> list[DataFrame]:
    """``df`` in ``count`` slices that hold whole groups of ``columns``."""
    return [df.where(in_slice(number, count, *columns)) for number in range(count)] if count > 1 else [df]
