import random
from collections import defaultdict

import numpy as np
import pytest

from quillshard.llm.mixing import mix, op5_pivotal_mix, pivotal, plan_copies
from tests.llm.helpers import documents, folder_of, odd_rows

W = (1, 2, 3)


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: W[i % 3] for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_pivotal_keeps_the_sum_of_words():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 200))
        sizes = rng.integers(0, 500, n)
        fractions = rng.random(n)
        take, left = pivotal(sizes, fractions, rng)
        assert (take == -1).sum() <= 1
        got = sizes[take == 1].sum() + (sizes * left)[take == -1].sum()
        assert got == pytest.approx((sizes * fractions).sum(), abs=1e-6)


def test_pivotal_keeps_the_chances():
    sizes, fractions = np.array([50, 30, 20, 10, 5]), np.array([0.3, 0.6, 0.5, 0.2, 0.9])
    rng = np.random.default_rng(1)
    hits = np.zeros(5)
    for _ in range(20000):
        take, left = pivotal(sizes, fractions, rng)
        hits += np.where(take == -1, left, take)
    assert np.abs(hits / 20000 - fractions).max() < 0.015


@pytest.mark.parametrize("chunk_rows", [8192, 4])
def test_targets_and_words(spark, chunk_rows):
    rows = odd_rows(2, 300)
    docs = documents(spark, rows)
    plan = [r.asDict() for r in plan_copies(docs, chunk_rows=chunk_rows).collect()]
    assert len(plan) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = brute_targets(sizes)
    by_source = defaultdict(list)
    for r in plan:
        by_source[r["source"]].append(r)
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
    for source, own in by_source.items():
        taken = sum(r["copies"] * r["size"] for r in own)
        assert abs(taken - want[source]) <= max(r["size"] for r in own) + 1e-6


def test_reruns_agree(spark, folder):
    sf = folder_of(documents(spark, odd_rows(3, 200)).repartition(5), folder)
    first = sorted(map(str, op5_pivotal_mix(spark, sf).collect()))
    sf2 = folder_of(documents(spark, odd_rows(3, 200)[::-1]).repartition(2), folder + "-again")
    assert first == sorted(map(str, op5_pivotal_mix(spark, sf2).collect()))


def test_mixed_table_repeats_rows_as_planned(spark):
    rng = random.Random(9)
    docs = documents(spark, odd_rows(4, 60)).selectExpr("*", "doc_id AS copies", "'x' AS target")
    plan = {(r["doc_id"], r["source"], r["tie"]): 0 for r in plan_copies(docs).collect()}
    for r in plan_copies(docs).collect():
        plan[(r["doc_id"], r["source"], r["tie"])] += r["copies"]
    out = mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(plan.values())
    assert rng


def test_empty(spark):
    docs = documents(spark, [])
    assert plan_copies(docs).count() == 0 and mix(docs).count() == 0


def test_a_row_repeated_without_end_and_blank_rows_fill_chunks_alike(spark, monkeypatch):
    from quillshard.llm import mixing

    seen = []
    real = mixing.staged

    def watch(df, purpose):
        out = real(df, purpose)
        if purpose == "mix-level0":
            seen.extend(r["count"] for r in out.groupBy("source", "chunk").count().collect())
        return out

    monkeypatch.setattr(mixing, "staged", watch)
    same = spark.range(200_000).selectExpr("7L AS doc_id", "'a b c' AS text", "'en' AS lang", "'hot' AS source", "5L AS n_chars")
    blank = spark.range(200_000).selectExpr("id AS doc_id", "' ' AS text", "'en' AS lang", "'hot' AS source", "1L AS n_chars")
    rare = documents(spark, [(i, "x y z w", "en", "rare", 7) for i in range(90_000, 90_040)])
    plan = plan_copies(same.union(blank).union(rare))
    by_source = {r["source"]: r for r in plan.groupBy("source").agg({"*": "count"}).collect()}
    assert by_source["hot"]["count(1)"] == 400_000 and by_source["rare"]["count(1)"] == 40
    assert max(seen) <= 2 * mixing.CHUNK_ROWS
    hot = plan.where("source = 'hot'").selectExpr("sum(copies * size) AS taken", "max(target) AS target").first()
    assert abs(hot["taken"] - hot["target"]) <= 3 + 1e-6


def test_rows_that_differ_in_another_column_are_kept_apart(spark):
    rows = [(1, "a b c", "en", "s", 5, "u1"), (1, "a b c", "en", "s", 5, "u2"), (2, "d e f g", "en", "t", 7, None), (2, "d e f g", "en", "t", 7, "")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, url string"
    docs = spark.createDataFrame(rows, schema)
    plan = plan_copies(docs).groupBy("doc_id", "tie").sum("copies").collect()
    assert len(plan) == 4
    out = [tuple(r) for r in mix(docs).collect()]
    assert set(out) <= set(rows)
    assert sorted(out.count(r) for r in rows) == sorted(r["sum(copies)"] for r in plan)


def test_repeated_rows_fold_and_expand(spark):
    docs = documents(spark, [(1, "a b", "en", "s", 3)] * 9000 + [(2, "c d e", "en", "t", 5)] * 5)
    want = {r["doc_id"]: r["c"] for r in plan_copies(docs).groupBy("doc_id").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "c").collect()}
    got = {r["doc_id"]: r["count"] for r in mix(docs).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
