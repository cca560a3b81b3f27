"""Fully repeated rows and repeated order ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderglass.functions.text import quoted
from orderglass.session import key_slices, slice_count, stage, stage_parts

# Hashes of repeated rows up to this number are broadcast (16 bytes each and their place in the hash table).
BROADCAST_HASHES = 500_000

REPEATED_NOTE = (
    "Repeated order_id values may be normal for order-line-level data, but fully identical rows should be "
    "reviewed because they may duplicate revenue."
)


def duplicate_groups(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each fully repeated row once, with its number of ``copies``; nulls compare equal.

    The first pass shuffles one 64-bit hash per row instead of whole rows and keeps the hashes that repeat.
    Only rows with such a hash reach the exact grouping over all columns, which also settles collisions.
    Both groupings combine on the map side, so a row repeated a billion times is one row per task.

    The repeated hashes are written first. Few of them are broadcast, so that no other row is shuffled; for many, the
    rows meet them slice by slice.
    """
    values = [quoted(name) for name in columns]
    hashed = df.select(*values, F.xxhash64(*values).alias("_hash"))
    counts = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("n"))
    repeated = stage_parts([counts.where("n > 1").select("_hash")], "repeated-hashes")

    def groups(rows: DataFrame, hashes: DataFrame) -> DataFrame:
        met = rows.join(hashes, "_hash", "left_semi")
        return met.groupBy(*values).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")

    slices = slice_count(df)
    if repeated.count() <= BROADCAST_HASHES:
        return groups(hashed, F.broadcast(repeated))
    if slices == 1:
        return groups(hashed, repeated)
    parts = zip(key_slices(hashed, ["_hash"], slices), key_slices(repeated, ["_hash"], slices))
    return stage_parts((groups(*part) for part in parts), "duplicate-groups")


def numbered_in_order(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """Add the 1-based global position under ``order``, without bringing all rows to one task.

    Rows are range-partitioned and sorted, then each partition is shifted by the rows before it. The window
    runs over one row per partition, and those rows are broadcast. The sorted rows are staged, so both readers see
    the same positions.
    """
    spot = F.monotonically_increasing_id()
    ordered = stage(df.orderBy(*order).withColumn("_spot", spot), "ordered")
    part = F.shiftright("_spot", 33).alias("_part")
    ordered = ordered.withColumn("_part", part)
    before = F.coalesce(
        F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", before.alias("_before"))
    within = F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_before") + within + 1
    ).drop("_part", "_before", "_spot")


def duplicate_rows(enriched: DataFrame) -> DataFrame:
    """Every member of every fully repeated row, with its group number and the overall counts.

    Groups are numbered in the order of their values, nulls last.
    """
    columns = [name for name in enriched.columns if name != "source_row_number"]
    groups = numbered_in_order(
        duplicate_groups(enriched, columns), [quoted(name).asc_nulls_last() for name in columns],
        "duplicate_group_id",
    )
    totals = groups.agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("copies"), F.lit(0)).alias("members")
    )
    group_total = totals.select("groups").scalar()
    member_total = totals.select("members").scalar()
    rows, found = enriched.alias("r"), groups.alias("g")
    same = [F.col(f"r.`{name}`").eqNullSafe(F.col(f"g.`{name}`")) for name in columns]
    return rows.join(found, same).select(
        F.col("g.duplicate_group_id"),
        F.col("r.source_row_number"),
        group_total.alias("duplicate_group_count"),
        member_total.alias("duplicate_row_count"),
        *[F.col(f"r.`{name}`") for name in columns],
    )


def repeated_order_ids(enriched: DataFrame) -> DataFrame:
    """Order ids on several rows, one row each: how often, and whether those rows are identical.

    Rows are compared by a hash of fixed size first. Only ids whose hashes all agree are compared in full. Their
    source rows are in :func:`repeated_order_id_rows`.
    """
    values = [quoted(name) for name in enriched.columns if name != "source_row_number"]
    mark = F.xxhash64(*values, *[F.isnull(value) for value in values])
    totals = enriched.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.min(mark).alias("_low"), F.max(mark).alias("_high")
    ).where("occurrence_count > 1").alias("t")
    alike = totals.where("_low = _high").select(F.col("order_id").alias("_id"))
    kinds = (
        enriched.join(alike, F.col("order_id").eqNullSafe(F.col("_id")), "left_semi")
        .groupBy(*values).agg(F.count(F.lit(1)).alias("_rows"))
        .groupBy("order_id").agg(F.count(F.lit(1)).alias("_kinds")).withColumnRenamed("order_id", "_id")
    )
    return totals.join(kinds, F.col("order_id").eqNullSafe(F.col("_id")), "left").select(
        "order_id", "occurrence_count", F.coalesce(F.col("_kinds") == 1, F.lit(False)).alias("rows_are_fully_identical"),
        F.lit(REPEATED_NOTE).alias("note"),
    )


def repeated_order_id_rows(enriched: DataFrame) -> DataFrame:
    """``order_id, source_row_number`` of every row whose order id is on several rows."""
    counts = enriched.groupBy(F.col("order_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return enriched.join(counts, F.col("order_id").eqNullSafe(F.col("_id")), "left_semi").select("order_id", "source_row_number")
