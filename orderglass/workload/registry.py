"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderglass.workload import oracles, preparation, preparation_oracles, reports


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**reports.QUERIES, **preparation.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**oracles.TWINS, **preparation_oracles.TWINS}
