"""Exact deduplication by skew-safe combining.

Copies are merged three times, each time by digest *and* full content: inside a task (the partial
aggregate), per salted digest group, and over the salt winners. A group of copies of any size is one
row per task after the first merge, so no task ever holds it.

Defined cases: a null text counts as empty; a null doc_id is smaller than any other; rows that repeat
doc_id and text are told apart by count, and exactly one of them stays; an empty table gives no rows;
other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderglass.llm.common import table
from orderglass.session import stage

SALTS = 8
ROWS_AT_ONCE = 100_000


def _content(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def winners(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, keep_id (largest doc_id) and group_size."""
    salted = _content(docs).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    per_salt = salted.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    merged = per_salt.groupBy("digest", "text").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    by_digest = merged.groupBy("digest").agg(
        F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("texts")
    )
    one_text = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("Two different texts share a SHA-256 digest."))
    )
    return by_digest.select("digest", "keep_id", one_text.cast("long").alias("group_size"))


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256."""
    found = stage(winners(docs, salts), "exact-winners")
    rows = _content(docs).groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    judged = rows.join(found, "digest")
    # A row that repeats itself comes back as often as it was there, in pieces of bounded length.
    pieces = judged.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("copies"), F.lit(ROWS_AT_ONCE))))
    last = F.least(F.col("copies"), F.col("first") + ROWS_AT_ONCE - 1)
    each = pieces.withColumn("place", F.explode(F.sequence("first", last)))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("place") == 1)
    return each.select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row per distinct text."""

    def name(doc: str):
        return F.coalesce(F.col(doc).cast("string"), F.lit(""))

    found = stage(winners(docs, salts).select("digest", "keep_id"), "exact-winners").select(
        F.col("digest").alias("__digest"), name("keep_id").alias("__keep")
    )
    rows = docs.withColumns({"__of": F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), "__id": name("doc_id")})
    # doc_id is part of the key, so a large group of copies is spread before it meets its winner. Both keys are
    # plain columns: the rows are shuffled once, for the join, and ranked where they lie.
    top = rows.join(found, (F.col("__of") == F.col("__digest")) & (F.col("__id") == F.col("__keep")), "left_semi")
    order = Window.partitionBy("__of", "__id").orderBy("__of")
    return top.withColumn("__place", F.row_number().over(order)).filter("__place = 1").select(*docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents."""
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
