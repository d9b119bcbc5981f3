"""Compare a Spark result with its SQL oracle run by DuckDB on the same files."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SQL_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def family(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    names = sorted(spark_df.columns)
    rows = [tuple(family(r[c]) for c in names) for r in spark_df.collect()]
    cur = con.execute(sql)
    sql_names = [d[0] for d in cur.description]
    if sorted(sql_names) != names:
        return f"columns {names} != {sorted(sql_names)}"
    spark_types, sql_types = dict(spark_df.dtypes), {d[0]: str(d[1]) for d in cur.description}
    differ = {c: (spark_types[c], sql_types[c]) for c in names if SQL_TYPE.get(spark_types[c]) != sql_types[c]}
    if differ:
        return f"schema {differ}"
    pick = [sql_names.index(c) for c in names]
    expected = [tuple(family(r[i]) for i in pick) for r in cur.fetchall()]
    if len(rows) != len(expected):
        return f"rows {len(rows)} != {len(expected)}"
    for i, c in enumerate(names):
        kinds = {type(r[i]) for r in rows} - {type(None)}, {type(r[i]) for r in expected} - {type(None)}
        if kinds[0] and kinds[1] and kinds[0] != kinds[1]:
            return f"types of {c}: {kinds}"
    left, right = Counter(rows), Counter(expected)
    if left != right:
        a, b = list((left - right))[:2], list((right - left))[:2]
        return f"{sum((left - right).values())} values differ, spark {a} oracle {b}"[:1500]
    return None
