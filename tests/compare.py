"""Run registered queries and their SQL side by side: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
KINDS = {
    "VARCHAR": "string",
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp",
}


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is not None, str(v)) for v in row))


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def differences(frame, con, sql) -> list[str]:
    """What differs between a Spark frame and the SQL's result; empty when equal."""
    relation = con.sql(sql)
    ours, theirs = dict(frame.dtypes), dict(zip(relation.columns, map(str, relation.types)))
    problems = []
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} != {sorted(theirs)}"]
    for name, kind in theirs.items():
        if KINDS.get(kind, kind) != ours[name]:
            problems.append(f"type of {name}: {ours[name]} != {kind}")
    left = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    right = _rows(relation.columns, relation.fetchall())
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    for a, b in zip(left, right):
        if len(a) != len(b) or not all(map(_same, a, b)):
            problems.append(f"first difference\n   spark {str(a)[:600]}\n   sql   {str(b)[:600]}")
            break
    if not left:
        problems.append("no rows")
    return problems


def main(sf="0.01", *names):
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    folder = f"/root/testdata/sf{sf}"
    con, sqls, bad = duck(folder), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            problems = differences(run(spark, folder), con, sqls[name]) if name in sqls else ["no SQL"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:900]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - started:.2f}s", *problems, sep="\n  " if problems else " ", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(*sys.argv[1:])
