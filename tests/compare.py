"""Runs registered queries against their SQL in DuckDB, as the acceptance check does."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def compare(spark, folder, function, sql):
    """None when equal, else a short description of the difference."""
    frame = function(spark, folder)
    ours, our_columns = rows_of(frame.columns, frame.collect())
    if sql is None:
        return None if ours else "no rows"
    cursor = duck(folder).execute(sql)
    theirs, their_columns = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if our_columns != their_columns:
        return f"columns {our_columns} / {their_columns}"
    if ours == theirs:
        return None if ours else "equal but empty"
    extra = [r for r in ours if r not in set(theirs)][:3]
    absent = [r for r in theirs if r not in set(ours)][:3]
    return f"rows {len(ours)} / {len(theirs)}; ours only {extra}; sql only {absent}"


def main():
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    from docweave.queries import ORACLES, QUERIES
    from docweave.session import local_session

    folder = sys.argv[1]
    wanted = [n for n in QUERIES if len(sys.argv) < 3 or any(n.startswith(p) for p in sys.argv[2:])]
    spark = local_session()
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, folder, QUERIES[name], ORACLES.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s", (problem or "")[:1800], flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} ok")


if __name__ == "__main__":
    main()
