"""Run registered queries against their SQL twins: ``python tests/compare.py FOLDER [query ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def oracle_connection(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _cell(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return "null" if math.isnan(number) else f"{number:.9g}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(row) for row in df.collect()])


def oracle_rows(connection, sql):
    cursor = connection.execute(sql)
    return rows_of([item[0] for item in cursor.description], cursor.fetchall())


def difference(df, connection, sql) -> str | None:
    """A short description of the first difference, or None."""
    columns, rows = spark_rows(df)
    twin_columns, twin_rows = oracle_rows(connection, sql)
    if columns != twin_columns:
        return f"columns {columns} against {twin_columns}"
    if len(rows) != len(twin_rows):
        return f"{len(rows)} rows against {len(twin_rows)}"
    for row, twin in zip(rows, twin_rows):
        if row != twin:
            return f"{dict(zip(columns, row))}\n   against {dict(zip(columns, twin))}"
    return None


def main() -> None:
    import __spark_entry__ as contract
    from orderglass.session import get_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = get_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, twins = contract.queries(), contract.oracle_sql()
    connection = oracle_connection(folder)
    for name in names or queries:
        begin = time.time()
        try:
            if name in twins:
                result = difference(queries[name](spark, folder), connection, twins[name]) or "same"
            else:
                result = f"no twin, {len(queries[name](spark, folder).collect())} rows"
        except Exception as error:  # noqa: BLE001 - a report of every query is wanted
            result = f"ERROR {str(error)[:700]}"
        print(f"{name}: {result} ({time.time() - begin:.1f}s)", flush=True)


if __name__ == "__main__":
    main()
