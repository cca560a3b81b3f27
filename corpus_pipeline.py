"""A training-data pipeline over ``documents``: quality, exact and near copies, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orderglass.llm.common import table
from orderglass.llm.exact_dedup import drop_exact_copies
from orderglass.llm.mixing import mixed_rows
from orderglass.llm.near_dedup import drop_near_copies
from orderglass.llm.packing import pack_documents
from orderglass.llm.quality import drop_low_quality
from orderglass.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on five-word shingles."""
    return drop_near_copies(docs, shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
    ("mix_sources", mix_sources), ("pack", pack),
]

#: Near-duplicate search, mixing and packing are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for place, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
