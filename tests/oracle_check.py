"""Compare registered queries with their SQL twins: ``python tests/oracle_check.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as driver  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, int]:
    """'' when rows, columns and types agree, else what differs."""
    df = driver.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    want = con.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    types = {d[0]: str(d[1]) for d in want.description}
    expected = want.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got)
    mine = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if mine != types:
        return f"types {[(c, mine[c], types[c]) for c in columns if mine[c] != types[c]]}", len(got)
    a, b = rows_of(df.columns, got), rows_of(columns, expected)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"{len(a)} vs {len(b)} rows; first differences {diff}", len(got)
    return "", len(got)


if __name__ == "__main__":
    from quillshard.session import build_session

    sf = sys.argv[1]
    session, con = build_session("local[4]", 8), connect(sf)
    bad = 0
    for query in sys.argv[2:] or driver.queries():
        start = time.time()
        try:
            problem, n = compare(session, con, query, sf)
        except Exception as err:  # noqa: BLE001
            problem, n = f"{type(err).__name__}: {str(err)[:1500]}", -1
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {query} rows={n} {time.time() - start:.2f}s {problem}", flush=True)
    print("failures:", bad)
