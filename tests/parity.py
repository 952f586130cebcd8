"""Comparing a Spark result with what DuckDB makes of the same tables.

Run as a script, it compares every query: ``python tests/parity.py FOLDER [NAME ..]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import pathlib
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, decimal.Decimal):
        return f"{value:f}"
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def _kind(name: str) -> str:
    name = name.lower()
    for prefix, kind in (("timestamp", "timestamp"), ("varchar", "string"), ("hugeint", "hugeint")):
        if name.startswith(prefix):
            return kind
    return {"integer": "int"}.get(name, name.replace(" ", ""))


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, connection, statement: str) -> list[str]:
    """What differs: column names, types, the number of rows or their values."""
    relation = connection.sql(statement)
    ours, theirs = _table(df.columns, df.collect()), _table(relation.columns, relation.fetchall())
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} and {theirs[0]}"]
    types = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    other = {c: _kind(str(k)) for c, k in zip(relation.columns, relation.types)}
    found = [f"type of {c}: {types[c]} and {other[c]}" for c in types if types[c] != other[c]]
    if len(ours[1]) != len(theirs[1]):
        found.append(f"{len(ours[1])} and {len(theirs[1])} rows")
    elif ours[1] != theirs[1]:
        pairs = [(a, b) for a, b in zip(*(x[1] for x in (ours, theirs))) if a != b]
        found.append(f"{len(pairs)} rows differ, first {pairs[0]}")
    return found


if __name__ == "__main__":
    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    from tablerelay.queries import all_queries, all_sql

    folder, chosen = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    database, statements, bad = connect(folder), all_sql(), 0
    for name, query in all_queries().items():
        if chosen and name not in chosen:
            continue
        began = time.time()
        try:
            frame = query(spark, folder)
            result = compare(frame, database, statements[name]) if name in statements else [f"unchecked, {frame.count()} rows"]
        except Exception as error:  # report and go on with the next query
            result = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(result)
        print(f"{'DIFF' if result else 'ok':4} {name} {time.time() - began:.2f}s {'; '.join(result)}", flush=True)
    print(f"{bad} of {len(all_queries())} differ")
    spark.stop()
