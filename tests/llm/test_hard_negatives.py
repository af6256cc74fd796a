import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillshard.llm import hard_negatives as h

SCHEMA = "vec_id bigint, label bigint, vector array<double>"


def whole(x):
    return 256 * int(x) if abs(x) > 2**60 else math.floor(256 * x)


def brute(rows, every=5):
    clean = [(i, y, tuple(whole(x) for x in v)) for i, y, v in rows
             if i is not None and y is not None and v and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)]
    nearest = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for a, label, av in sorted({r for r in clean if r[0] % every == 0}):
        ends = lambda s: max(1 - 2**125, min(2**125 - 1, s))
        scored = [(-ends(sum(p * q for p, q in zip(av, v))), i, y) for i, y, v in clean if i != a and len(v) == len(av)]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:5]:
            window = sorted(s for s in scored if s[2] != label and -50 * ps <= -100 * s[0] <= -95 * ps)
            out += [(a, p, r + 1, n, nearest(-ps), nearest(-ns)) for r, (ns, n, _) in enumerate(window[:3])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "2 AS cells", "'x' AS dimension", "3 AS ask").repartition(4)
    return sorted(tuple(r) for r in h.hard_negatives(df, F.col("vec_id") % 5 == 0, **options).collect())


def some_rows(seed, size=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, rng.randrange(3) if i % 3 else 0, [size * (c + rng.gauss(0, 0.6)) for c in centres[i % 5]]) for i in range(240)]
    rows += [(300 + i, 1, rows[9][2]) for i in range(30)]
    return rows + [(400, None, [1.0] * 6), (405, 1, None), (410, 1, []), (415, 1, [1.0, None] + [0.0] * 4), (420, 1, [float("nan")] * 6),
                   (425, 2, [float("inf")] * 6), (None, 1, [1.0] * 6), (430, 1, [0.0] * 6), (435, 1, [1.0, 2.0]), (436, 1, [2.0, 2.0]),
                   (437, 2, [1.5, 1.0]), rows[50], rows[51]]


@pytest.mark.parametrize("ask_bytes, block_bytes", [(h.ASK_BYTES, h.BLOCK_BYTES), (3000, 400)])
def test_against_brute_force(spark, monkeypatch, ask_bytes, block_bytes):
    monkeypatch.setattr(h, "BLOCK_BYTES", block_bytes)
    rows = some_rows(1)
    want = brute(rows)
    assert len(want) > 300 and run(spark, rows, ask_bytes=ask_bytes) == want


@pytest.mark.parametrize("size", [1e6, 1e12, 1e30])
def test_components_of_any_size(spark, size):
    rows = some_rows(2, size)[:120] + [(501, 1, [1e300] + [0.0] * 5), (502, 2, [1.7e308] * 6)]
    assert run(spark, rows) == brute(rows)


def test_the_curve_visits_every_cell_by_single_steps():
    for dimensions, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dimensions, indexing="ij"), axis=-1).reshape(-1, dimensions)
        keys = h.hilbert_keys(grid, bits)
        assert len(set(keys)) == len(grid)
        path = grid[sorted(range(len(grid)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(5)
    rows, questions = np.floor(256 * rng.normal(size=(50, 7))), np.floor(256 * rng.normal(size=(9, 7)))
    upper, lower = h.bounds(questions, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = questions @ rows.T
    assert (scores <= upper).all() and (scores >= lower).all()


def test_blocks_that_cannot_answer_are_not_read(spark):
    rows = [(i, i % 2, [1.0 if i < 3000 else -1.0, float(i % 7)]) for i in range(6000)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    blocks = h.write_blocks(vectors)
    # with blocks of one label and one half of the plane, a question for the best of its label reads half of a label's blocks at most
    assert blocks.where("size(cells) != n * dimension").count() == 0 and blocks.agg(F.sum("n")).first()[0] == 6000
    assert blocks.select("label").distinct().count() == 2


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(0, 1, [1.0])]) == []
