"""Bottom-k samples of key columns: coordinated, mergeable, weighted by rows.

Every key gets a rank from its own MD5 hash, read as an even number u between 0 and 1, and its rows n: ``-ln(u) / n``.
A sample is the k keys of least rank. Columns rank a key alike, so samples of different columns, or of parts of
one column whose counts are added up, agree; a key with many rows is nearly always in. With the next rank as
threshold t, a sampled key was due to be in with probability ``1 - exp(-n * t)``, and ``n`` over that is an unbiased
share of the rows. The relative error (deviation over value) is below ``1 / sqrt(k - 1)``; a column of at most k keys
is counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SKETCH_KEYS = 1024
# Fixed value: hexadecimal digits of the hash that make up u; a double holds them exactly.
DIGITS = 13


def relative_error(k: int) -> float:
    """The deviation of an estimate over its value, at most."""
    return 1 / math.sqrt(k - 1)


def key_rank(key: Column, rows: Column) -> Column:
    number = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return -F.ln((number + 1) / float(16**DIGITS + 1)) / rows


def bottom_k(counts: DataFrame, by: tuple[str, ...] = ("spec",), k: int = SKETCH_KEYS) -> DataFrame:
    """The sample of each column from its key counts (*by, key, n): *by, key, n and weight (rows it stands for).

    Tasks keep k + 1 keys per column before anything is shuffled.
    """
    ranked = counts.where("key is not null").withColumn("rank", key_rank(F.col("key"), F.col("n")))
    order = Window.partitionBy(*by).orderBy("rank", "key")
    least = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    threshold = F.max(F.when(F.col("place") == k + 1, F.col("rank"))).over(Window.partitionBy(*by))
    chance = F.when(threshold.isNull(), 1.0).otherwise(-F.expm1(-F.col("n") * threshold))
    return least.withColumn("weight", F.col("n") / chance).where(F.col("place") <= k).select(*by, "key", "n", "weight")


def estimated_match(sample: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Per *by, from sampled keys with ``matched``: sampled and matched keys, rows they stand for, and the match rate."""
    return sample.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sampled_keys"), F.count_if("matched").alias("matched_keys"),
        F.sum("weight").alias("estimated_rows"),
        F.coalesce(F.sum(F.when(F.col("matched"), F.col("weight"))), F.lit(0.0)).alias("estimated_matched_rows"),
    ).withColumn("match_rate", F.col("estimated_matched_rows") / F.col("estimated_rows"))
