"""Compare registered queries with their SQL: ``python -m suite.check DIR [key ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(root: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET threads TO 4")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{root}/{table}.parquet')")
    return connection


def _cell(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def kinds(types: list) -> list[str]:
    names = {"long": "bigint", "timestamp_ntz": "timestamp", "varchar": "string", "integer": "int"}
    return [names.get(str(t).lower(), str(t).lower()) for t in types]


def differences(spark_df, connection, sql: str) -> list[str]:
    """What differs between a Spark result and a SQL result, regardless of row order."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    types = dict(zip(names, kinds([d[1] for d in cursor.description])))
    expected = cursor.fetchall()
    ours = dict(zip(spark_df.columns, kinds([f.dataType.simpleString() for f in spark_df.schema])))
    found = [tuple(r) for r in spark_df.collect()]
    problems = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} against {sorted(names)}"]
    if ours != types:
        problems.append(f"types { {c: (ours[c], types[c]) for c in ours if ours[c] != types[c]} }")
    if len(found) != len(expected):
        problems.append(f"rows {len(found)} against {len(expected)}")
    order = sorted(names)
    left = [spark_df.columns.index(c) for c in order]
    right = [names.index(c) for c in order]
    a = Counter(tuple(_cell(r[i]) for i in left) for r in found)
    b = Counter(tuple(_cell(r[i]) for i in right) for r in expected)
    if a != b:
        problems.append(f"{(a - b).total()} rows differ in {order}: {str(list((a - b))[:2])[:400]} against {str(list((b - a))[:2])[:400]}")
    return problems


def main(root: str, keys: list[str]) -> int:
    from suite.all_queries import QUERIES, SQL
    from wardline.session import local_session

    spark = local_session(8)
    connection = database(root)
    failed = 0
    for key in keys or QUERIES:
        start = time.time()
        try:
            df = QUERIES[key](spark, root)
            if key in SQL:
                problems = differences(df, connection, SQL[key])
                n = ""
            else:
                rows = df.collect()
                n = f"{len(rows)} rows, no SQL"
                problems = []
        except Exception as error:  # report and go on with the next query
            problems, n = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {key} {time.time() - start:.2f}s {n} {' | '.join(problems)}", flush=True)
    print(f"{failed} failed of {len(keys or QUERIES)}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
