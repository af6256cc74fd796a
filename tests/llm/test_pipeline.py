from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import documents, folder_of, odd_rows, prose
from tests.llm.test_mixing import brute_targets
from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import brute_best_fit  # noqa: F401
from tests.llm.test_substring_dedup import brute_spans

import random


def rows_for(seed):
    rng = random.Random(seed)
    passage = prose(rng, 70)
    rows = [r for r in odd_rows(seed, 120) if r[0] is not None and r[0] != 106]
    rows += [(300 + i, f"{prose(rng, 60)} {passage} {prose(rng, 30)}", "en", "hot", 1) for i in range(8)]
    base = prose(rng, 120)
    rows += [(400 + i, base.replace("alpha", f"alpha{i}", 1), "en", "src2", 1) for i in range(9)]
    rows += [(500, "menu | home | " * 40 + "\n" + prose(rng, 60), "en", "src1", 1), (501, "Buy now!! " * 60, "en", "src1", 1)]
    return rows


def test_each_stage_against_brute_force(spark, folder):
    """Stage by stage over what the one before it wrote, as run() does."""
    docs = documents(spark, rows_for(31))
    columns = docs.columns
    sf = folder_of(docs, folder)
    at = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [tuple(r) for r in at.collect()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept
        out = stage(spark, at, sf)
        out.write.parquet(f"{folder}/stage{n}")
        at = spark.read.parquet(f"{folder}/stage{n}")
        if name == "packing":
            break
        assert at.columns == columns
        kept = [tuple(r) for r in at.collect()]
        if name == "quality_rules":
            ids = {r[0] for r in kept}
            assert 500 not in ids and 501 not in ids and {300 + i for i in range(8)} <= ids
            assert all(len((r[1] or "").split()) >= 30 for r in kept)
        elif name == "near_dedup":
            want = sorted(d for d, _, c in brute(before) if d == c)
            assert sorted(r[0] for r in kept) == want
        elif name == "substring_dedup":
            removed = {k[0]: v for k, v in brute_spans(before).items() if v}
            want = {}
            for r in before:
                left = [w for i, w in enumerate(r[1].split()) if i not in removed.get(r[0], ())]
                if left:
                    want[r[0]] = left
            assert {r[0]: r[1].split() for r in kept} == want
            assert sum(300 <= d < 308 for d in removed) == 7
        else:
            sizes = Counter()
            for r in before:
                sizes[r[3]] += len(r[1].split())
            target, taken = brute_targets(sizes), Counter()
            for r in kept:
                taken[r[3]] += len(r[1].split())
            for s in sizes:
                assert abs(taken[s] - target[s]) <= max(len(r[1].split()) for r in before if r[3] == s)
            assert set(kept) <= set(before) and max(Counter(kept).values()) <= 3
    bins, words = defaultdict(list), Counter()
    for r in at.collect():
        bins[r["pack_id"]].append(r)
        words[r["doc_id"]] += r["n_words"]
    want = Counter()
    for r in kept:
        want[r[0]] += len(r[1].split())
    assert words == want
    for own in bins.values():
        assert sum(r["n_words"] for r in own) <= 2048
        assert len({r["cluster"] for r in own}) == len(own)
        assert len({r["source"] for r in own if r["source"]}) == sum(r["source"] is not None for r in own)


def test_run_is_the_stages(spark, folder):
    sf = folder_of(documents(spark, rows_for(32)), folder)
    one = sorted(map(str, corpus_pipeline.run(spark, sf).drop("pack_id").collect()))
    assert one and one == sorted(map(str, corpus_pipeline.run(spark, sf).drop("pack_id").collect()))


def test_empty(spark, folder):
    assert corpus_pipeline.run(spark, folder_of(documents(spark, []), folder)).count() == 0


CLASHING = ["__key", "__copies", "__copy", "__run", "__counts", "__judged", "__doc", "__tie", "__raw", "__spans",
            "kept", "n_words", "clean_text", "tie", "copies", "target", "extra_0", "a.b", "copy", "copy_m"]


def test_no_stage_clashes_with_further_columns(spark, folder):
    docs = documents(spark, rows_for(33))
    clashing = docs.select("*", *[F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")).alias(name) for name in CLASHING])
    plain, wide = docs, clashing
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        plain, wide = stage(spark, plain, folder), stage(spark, wide, folder)
        if name == "packing":
            assert wide.count() == plain.count()
            break
        assert wide.columns == clashing.columns
        plain.write.parquet(f"{folder}/plain{n}")
        wide.write.parquet(f"{folder}/wide{n}")
        plain, wide = spark.read.parquet(f"{folder}/plain{n}"), spark.read.parquet(f"{folder}/wide{n}")
        assert all(r["kept"] == f"kept-{r['doc_id']}" and r["__raw"] == f"__raw-{r['doc_id']}" and r["a.b"] == f"a.b-{r['doc_id']}"
                   for r in wide.collect())
        if name != "source_mix":
            assert sorted(map(str, plain.collect())) == sorted(map(str, wide.select(*docs.columns).collect()))
        # the mix knows a row by all its columns, so its draw differs; go on with the same rows
        plain = wide.select(*docs.columns)
