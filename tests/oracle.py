"""Run a registered query in Spark and its SQL in DuckDB, and compare them value by value."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


EXACT = bool(os.environ.get("ORACLE_EXACT"))  # compare doubles to the last bit


def database(sf: str):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value if EXACT else float(f"{value:.12g}")
    if isinstance(value, decimal.Decimal):
        return float(f"{float(value):.12g}")
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, db, query, sql: str, sf: str) -> str:
    """Empty when equal, else what differs."""
    frame = query(spark, sf)
    mine = comparable(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = db.execute(sql)
    theirs = comparable([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if mine[1] == theirs[1]:
        return "" if mine[1] else "EMPTY"
    a, b = set(map(repr, mine[1])), set(map(repr, theirs[1]))
    return f"rows {len(mine[1])} vs {len(theirs[1])}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"


def main(sf: str, names: list[str]) -> None:
    import __spark_entry__ as entry
    from deckloom.session import local_session

    spark, db = local_session(), database(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sorted(queries):
        if names and not any(name.startswith(n) for n in names):
            continue
        started = time.time()
        try:
            if name in oracles:
                verdict = compare(spark, db, queries[name], oracles[name], sf)
            else:
                verdict = f"rows only: {queries[name](spark, sf).count()}"
        except Exception as failure:  # report and go on to the next query
            verdict = f"{type(failure).__name__}: {str(failure)[:600]}"
        bad += bool(verdict) and not verdict.startswith("rows only")
        print(f"{time.time() - started:6.1f}s {name:32} {verdict[:900] or 'ok'}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
