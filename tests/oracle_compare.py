"""Strict comparison of a Spark result with a DuckDB result (order-insensitive)."""

from __future__ import annotations

import math
import re

import duckdb

BASE_VIEWS = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_DUCK_TO_SPARK = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean",
    "DOUBLE": "double", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
}


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in BASE_VIEWS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _spark_type(duck_type: str) -> str:
    match = re.match(r"DECIMAL\((\d+),\s*(\d+)\)", duck_type)
    return f"decimal({match[1]},{match[2]})" if match else _DUCK_TO_SPARK.get(duck_type, duck_type)


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between the two results; empty when they agree in columns, types and rows."""
    problems = []
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    duck_rows = result.fetchall()
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns: spark={sorted(spark_df.columns)} duck={sorted(names)}"]
    for name, spark_type in spark_df.dtypes:
        if _spark_type(str(types[name])) != spark_type:
            problems.append(f"type of {name}: spark={spark_type} duck={types[name]}")
    order = sorted(names)
    spark_rows = [tuple(_norm(row[n]) for n in order) for row in spark_df.collect()]
    index = [names.index(n) for n in order]
    other = [tuple(_norm(row[i]) for i in index) for row in duck_rows]
    if len(spark_rows) != len(other):
        problems.append(f"rows: spark={len(spark_rows)} duck={len(other)}")
    spark_rows.sort()
    other.sort()
    if spark_rows != other:
        only_spark = sorted(set(spark_rows) - set(other))[:2]
        only_duck = sorted(set(other) - set(spark_rows))[:2]
        problems.append(f"values differ {order}: spark-only={only_spark} duck-only={only_duck}")
    return problems
