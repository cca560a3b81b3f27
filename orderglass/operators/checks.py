"""Shapes shared by the check and metric tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks_table(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """``check_name, issue_count, status``: all conditions are counted in one pass over ``df``."""
    counts = df.agg(*[F.count_if(condition).alias(name) for name, condition in conditions.items()])
    rows = F.array(*[
        F.struct(F.lit(name).alias("check_name"), F.col(name).alias("issue_count")) for name in conditions
    ])
    return counts.select(F.inline(rows)).withColumn(
        "status", F.when(F.col("issue_count") == 0, "passed").otherwise("warning")
    )


def metric_rows(row: DataFrame, metrics: Sequence[tuple[str, Column | None, Column | None]]) -> DataFrame:
    """Turn a one-row table into ``metric, value_double, value_text`` rows."""
    return row.select(F.inline(F.array(*[
        F.struct(
            F.lit(name).alias("metric"),
            (F.lit(None) if number is None else number).cast("double").alias("value_double"),
            (F.lit(None) if text is None else text).cast("string").alias("value_text"),
        )
        for name, number, text in metrics
    ])))
