import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillshard.llm.topk_search import OP3_SQL, _Best, feasible, op3_norm_buckets, search_bucket, top_k
from tests.conftest import SF_SMALL
from tests.oracle_check import rows_of


def brute(rows, is_query, k=5):
    clean = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
             if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in sorted({(i, tuple(v)) for i, v in clean if is_query(i)}):
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in clean if i != q and len(v) == len(qv))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, every, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<float>").repartition(4)
    return sorted(tuple(r) for r in top_k(df, F.pmod("vec_id", F.lit(every)) == 0, **options).collect())


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 16, "block_bytes": 600}])
def test_against_brute_force(spark, options):
    rng = random.Random(1)
    rows = [(i, [np.float32(rng.gauss(0, 1) * (1 + i % 7)).item() for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[9][1]) for i in range(40)]
    rows += [(400, None), (405, []), (410, [1.0, None] + [0.0] * 6), (415, [float("nan")] * 8), (420, [float("inf")] * 8),
             (None, [1.0] * 8), (425, [0.0] * 8), (430, [1.0, 2.0]), (431, [2.0, 2.0]), (50, rows[50][1]), (51, rows[51][1])]
    assert run(spark, rows, 5, **options) == brute(rows, lambda i: i % 5 == 0)


def test_every_way_of_pruning_is_exact():
    rng = np.random.default_rng(3)
    ways = {"skipped": 0, "coordinate": 0, "length": 0}
    for _ in range(60):
        d = int(rng.integers(2, 12))
        base = rng.normal(size=(4, d))
        bucket = np.floor(256 * (base[rng.integers(0, 4, 120)] + 0.1 * rng.normal(size=(120, d)))).astype(np.int64)
        queries = np.floor(256 * (base + 0.05 * rng.normal(size=(4, d)))).astype(np.int64)
        want = queries @ bucket.T
        floor = np.array([np.sort(w)[-int(rng.integers(1, 6))] + int(rng.integers(-1, 2)) * int(rng.integers(0, 10**5)) for w in want])
        best = _Best(4, 5, floor)
        for name, n in search_bucket(queries, np.full(4, -1), bucket, np.arange(120), best).items():
            ways[name] += n
        for q in range(4):
            reach = sorted((-s, i) for i, s in enumerate(want[q].tolist()) if s >= floor[q])[:5]
            assert best.found[q] == reach
    assert all(ways.values()), ways


def test_feasible_interval_holds_every_vector_of_that_cosine():
    rng = np.random.default_rng(4)
    p, u = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.normal(size=(20000, 3)), rng.normal(size=(20000, 3))))
    for a, b in zip(p, u):
        t = float(a @ b)
        if t > 0:
            low, high = feasible(float(b[0]), t)
            assert low <= a[0] <= high


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF_SMALL}/embeddings.parquet')")
    want = con.execute(OP3_SQL)
    columns = [d[0] for d in want.description]
    got = op3_norm_buckets(spark, SF_SMALL)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("size", [70_000.0, 1e6, 1e12, 1e30])
def test_components_of_any_size(spark, size):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * (size if i % 4 == 1 else 1) for _ in range(6)]) for i in range(80)] + [(90, [1e300] + [0.0] * 5), (91, [1.7e308] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<double>").repartition(3)
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 5 == 0, bucket_rows=16).collect())
    nearest = lambda s: max(-(2**63), min(2**63 - 1, s))
    clean = [(i, [256 * int(x) if abs(x) > 2**60 else math.floor(256 * x) for x in v]) for i, v in rows if i != 91]
    want = []
    for q, qv in clean:
        if q % 5 == 0:
            ends = lambda s: max(1 - 2**125, min(2**125 - 1, s))
            scored = sorted((-ends(sum(a * b for a, b in zip(qv, v))), i) for i, v in clean if i != q)[:5]
            want += [(q, r + 1, i, nearest(-s)) for r, (s, i) in enumerate(scored)]
    assert got == sorted(want)


def test_empty_and_too_few(spark):
    assert run(spark, [], 5) == []
    assert run(spark, [(0, [1.0])], 5) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])], 5) == [(0, 1, 1, 256 * 512)]
