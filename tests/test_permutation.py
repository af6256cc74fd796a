"""The keyed permutation: exact, invertible, the same on the driver and on columns, and without an exchange."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillshard.operators.permutation import LARGEST, Permutation, grid, permuted_epochs, place_of, position_of
from tests.conftest import plan_of


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 700), st.integers(0, 10**6), st.integers(0, 50))
def test_every_position_has_its_own_place_and_back(n, seed, epoch):
    p = Permutation(n, seed, epoch)
    places = [p.place(x) for x in range(n)]
    assert sorted(places) == list(range(n)) and [p.position(x) for x in places] == list(range(n))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, LARGEST), st.integers(0, 10**9))
def test_large_tables_go_back_and_forth(n, at):
    p = Permutation(n, 7, 1)
    assert 0 <= p.place(at % n) < n and p.position(p.place(at % n)) == at % n
    height, width = grid(n)
    assert 0 <= height * width - n <= max(width, 1)


def test_epochs_seeds_and_places_differ():
    orders = [[Permutation(5000, seed, epoch).place(x) for x in range(5000)] for seed, epoch in ((1, 0), (1, 1), (2, 0))]
    for a, b in ((0, 1), (0, 2), (1, 2)):
        assert sum(x == y for x, y in zip(orders[a], orders[b])) < 15
    # neighbours are as far apart as in a random order: a third of the rows on average
    assert 0.3 < sum(abs(a - b) for a, b in zip(orders[0], orders[0][1:])) / 5000 / 5000 < 0.37


@pytest.mark.parametrize("n", [1, 2, 97, 1000, 4099])
def test_columns_equal_the_driver(spark, n):
    p = Permutation(n, 42, 3)
    rows = spark.range(n).select("id", place_of(F.col("id"), p).alias("place"))
    got = rows.withColumn("back", position_of(F.col("place"), p)).collect()
    assert all(r["place"] == p.place(r["id"]) and r["back"] == r["id"] for r in got)


def test_epochs_of_shards_move_no_row(spark):
    counts = [10, 10, 3, 0]
    rows = spark.range(23).selectExpr("id", "CAST(id DIV 10 AS INT) AS shard_id", "id % 10 AS row_in_shard", "'x' AS n", "1 AS keys")
    out = permuted_epochs(rows, counts, 2, 5)
    assert "Exchange" not in plan_of(out) and "Sort" not in plan_of(out)
    got = out.collect()
    for shard, n in enumerate(counts):
        for epoch in range(2):
            own = [r for r in got if (r["shard_id"], r["epoch"]) == (shard, epoch)]
            assert sorted(r["rn"] for r in own) == list(range(n))
            assert all(r["rn"] == Permutation(n, 5, epoch).place(r["row_in_shard"]) for r in own)


def test_batches_are_computed_sets_and_uncounted_rows_are_errors(spark):
    p = Permutation(25, 1, 0)
    batches = [p.batch(b, 10) for b in range(4)]
    assert [len(b) for b in batches] == [10, 10, 5, 0] and sorted(sum(batches, [])) == list(range(25))
    late = spark.range(6).selectExpr("id", "0 AS shard_id", "id AS row_in_shard")
    with pytest.raises(Exception, match="planned"):
        permuted_epochs(late, [5], 1, 1).collect()
    with pytest.raises(ValueError):
        Permutation(-1, 1, 1)
