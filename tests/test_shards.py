import glob
import math
import os

import pyarrow.parquet as pq
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillshard.functions.encoders import ByteEncoder
from quillshard.functions.formatting import InstructionFormatter
from quillshard.operators import batches, shards as ops, splits
from quillshard.plans.config import PreprocessConfig
from quillshard.plans.preprocess import preprocess, tokenized_examples
from quillshard.plans.steps import step_plan
from quillshard.sources import shards as store
from tests.conftest import plan_of

FORMAT = InstructionFormatter("q", "a")


@given(st.integers(0, 500), st.integers(1, 40))
def test_shard_bounds_cover_every_row_once(total, count):
    bounds = [ops.shard_bounds(total, count, i) for i in range(count)]
    assert [p for a, z in bounds for p in range(a, z)] == list(range(total))
    assert all(z - a <= math.ceil(total / count) for a, z in bounds)


def test_shard_examples():
    assert [z - a for a, z in (ops.shard_bounds(5, 4, i) for i in range(4))] == [2, 2, 1, 0]
    for count, which in ((4, 4), (4, -1), (0, 0)):
        with pytest.raises(ValueError):
            ops.shard_bounds(5, count, which)


def test_validation_size_rounds_up_in_floats():
    assert splits.validation_size(0.07, 100) == 8
    assert splits.validation_size(0.1, 150) == 15
    assert [splits.makes_split(r) for r in (0, 1, -0.1, 1.5, None, 0.05)] == [False] * 5 + [True]


def raw(spark, n, extra=0):
    return spark.range(extra, n + extra).select(F.col("id").alias("k"), F.concat(F.lit("q"), "id").alias("q"), F.concat(F.lit("a"), "id").alias("a"), (F.col("id") % 2).cast("string").alias("subset"))


def test_ratio_split_is_a_disjoint_cover_independent_of_partitioning(spark):
    df = raw(spark, 333)
    seen = []
    for parts, per_part in ((1, 20), (7, 1_000_000)):
        out, totals = splits.ratio_split(df.repartition(parts), 0.07, ["k"], 9, per_part)
        rows = {(r.k, r.split, r.position) for r in out.collect()}
        seen.append(rows)
        assert totals == {"train": 309, "val": 24}
        for split, n in totals.items():
            assert sorted(p for _, s, p in rows if s == split) == list(range(n))
        train, val = (out.where(F.col("split") == s).select("k") for s in ("train", "val"))
        assert train.intersect(val).count() == 0
    assert seen[0] == seen[1]
    other, _ = splits.ratio_split(df, 0.07, ["k"], 10)
    assert {(r.k, r.split, r.position) for r in other.collect()} != seen[0]


@pytest.mark.parametrize("partitions", [3, 17])
def test_results_do_not_depend_on_shuffle_settings(spark, partitions):
    df = raw(spark, 150)
    cfg = PreprocessConfig("", ("k",), max_length=16, num_train_shards=3, num_val_shards=1, val_split_ratio=0.1, mask_padding=True)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = tokenized_examples(df, cfg, FORMAT, ByteEncoder()).collect()
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = tokenized_examples(df.repartition(partitions), cfg, FORMAT, ByteEncoder()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def config(folder, **changes):
    return PreprocessConfig(f"{folder}/raw", ("k",), f"{folder}/out", max_length=16, keep_position=True, **changes)


@pytest.fixture
def source(spark, folder):
    raw(spark, 205).write.partitionBy("subset").parquet(f"{folder}/raw")
    return folder


def sizes(manifest):
    return {r.shard_name: r.num_rows for r in manifest.collect()}


def test_job_writes_ordered_files_and_a_manifest(spark, source):
    cfg = config(source, num_train_shards=4, num_val_shards=2, val_split_ratio=0.1, rows_per_part=15)
    assert sizes(preprocess(spark, cfg, FORMAT, ByteEncoder())) == {"shard_0": 46, "shard_1": 46, "shard_2": 46, "shard_3": 46, "val_shard_0": 11, "val_shard_1": 10}
    files = glob.glob(f"{cfg.output_dir}/examples/split=*/shard_id=*/*.parquet")
    assert len(files) > 6
    spans = {}
    for f in files:
        position = pq.ParquetFile(f).read(columns=["position"]).column("position").to_pylist()
        assert position == list(range(position[0], position[0] + len(position)))
        spans.setdefault(os.path.dirname(f), []).append((os.path.basename(f), position[0]))
    for parts in spans.values():
        starts = [start for _, start in sorted(parts)]
        assert starts == sorted(starts)
    shard = store.load_shard(spark, cfg.output_dir, "shard_1", keep_position=True)
    assert sorted(r.position for r in shard.collect()) == list(range(46, 92))
    whole = store.read_all_shards(spark, cfg.output_dir, keep_position=True)
    lazy = tokenized_examples(spark.read.parquet(cfg.path), cfg, FORMAT, ByteEncoder()).drop("k")
    assert lazy.select(*whole.columns).exceptAll(whole).count() == 0 and whole.count() == 205


def test_default_shard_schema_is_three_columns(spark, source):
    cfg = PreprocessConfig(f"{source}/raw", ("k",), f"{source}/out", max_length=16)
    preprocess(spark, cfg, FORMAT, ByteEncoder())
    assert store.load_shard(spark, cfg.output_dir, "shard_0").columns == ["input_ids", "attention_mask", "labels"]
    (f, *_) = glob.glob(f"{cfg.output_dir}/examples/split=train/shard_id=0/*.parquet")
    assert pq.ParquetFile(f).schema_arrow.names == ["input_ids", "attention_mask", "labels"]


def test_empty_shards_stay_known(spark, source):
    cfg = config(source, num_train_shards=4, train_max_examples=5)
    assert sizes(preprocess(spark, cfg, FORMAT, ByteEncoder())) == {"shard_0": 2, "shard_1": 2, "shard_2": 1, "shard_3": 0}
    assert store.load_shard(spark, cfg.output_dir, "shard_3").count() == 0
    with pytest.raises(FileNotFoundError, match="shard_4"):
        store.load_shard(spark, cfg.output_dir, "shard_4")
    with pytest.raises(FileNotFoundError):
        store.load_shard(spark, f"{source}/nowhere", "shard_0")
    more = config(source, num_train_shards=9, train_max_examples=4)
    assert sum(sizes(preprocess(spark, more, FORMAT, ByteEncoder())).values()) == 4


def test_nothing_to_write(spark, source):
    assert sizes(preprocess(spark, config(source, num_train_shards=0), FORMAT, ByteEncoder())) == {}
    none = config(source, train_max_examples=0, num_train_shards=2)
    assert sizes(preprocess(spark, none, FORMAT, ByteEncoder())) == {"shard_0": 0, "shard_1": 0}


def test_validation_without_shards_is_split_off_but_not_written(spark, source, caplog):
    cfg = config(source, num_train_shards=1, num_val_shards=0, val_split_ratio=0.1)
    assert sizes(preprocess(spark, cfg, FORMAT, ByteEncoder())) == {"shard_0": 184}
    assert "written nowhere" in caplog.text


def test_subset_wins_over_ratio_and_limits_apply(spark, source):
    cfg = config(source, subset="0", val_subset="1", val_split_ratio=0.5, num_train_shards=2, num_val_shards=1, val_max_examples=7, train_max_examples=1000)
    assert sizes(preprocess(spark, cfg, FORMAT, ByteEncoder())) == {"shard_0": 52, "shard_1": 51, "val_shard_0": 7}
    ratio = config(source, val_split_ratio=0.1, num_val_shards=1, val_max_examples=1)
    assert sizes(preprocess(spark, ratio, FORMAT, ByteEncoder()))["val_shard_0"] == 21


def test_stale_shards(spark, source):
    preprocess(spark, config(source, num_train_shards=4), FORMAT, ByteEncoder())
    kept = preprocess(spark, config(source, num_train_shards=2, keep_stale=True), FORMAT, ByteEncoder())
    assert sizes(kept) == {"shard_0": 103, "shard_1": 102, "shard_2": 52, "shard_3": 49}
    assert store.load_shard(spark, f"{source}/out", "shard_3").count() == 49
    assert sizes(preprocess(spark, config(source, num_train_shards=2), FORMAT, ByteEncoder())) == {"shard_0": 103, "shard_1": 102}
    assert not glob.glob(f"{source}/out/examples/split=train/shard_id=3")


def test_a_failed_rewrite_leaves_no_manifest_and_other_files_stay(spark, source):
    cfg = config(source, num_train_shards=2)
    preprocess(spark, cfg, FORMAT, ByteEncoder())
    with open(f"{cfg.output_dir}/notes.txt", "w") as f:
        f.write("mine")

    class Broken(ByteEncoder):
        def ids(self, payload):
            return F.raise_error(F.lit("broken encoder")).cast("array<int>")

    with pytest.raises(Exception, match="broken encoder"):
        preprocess(spark, cfg, FORMAT, Broken())
    with pytest.raises(FileNotFoundError):
        store.load_shard(spark, cfg.output_dir, "shard_0")
    assert sizes(preprocess(spark, cfg, FORMAT, ByteEncoder())) == {"shard_0": 103, "shard_1": 102}
    assert os.path.exists(f"{cfg.output_dir}/notes.txt")


def test_manifest_check_notices_missing_rows():
    import pandas as pd

    rows = pd.DataFrame([("train", 0, "shard_0", 3)], columns=["split", "shard_id", "shard_name", "num_rows"])
    with pytest.raises(RuntimeError, match="changed during the run"):
        store._check_sizes(rows, {"train": 4}, {"train": 1})


def test_shard_names():
    assert store.resolve_shard_name("shard_{id}_of_{world_size}", 2, 4) == "shard_2_of_4"
    assert store.resolve_shard_name("shard_{rank:05d}", 2, 4) == "shard_00002"
    assert store.resolve_shard_name("shared", 2, 4) == "shared"
    with pytest.raises(ValueError, match="val"):
        store.resolve_shard_name("shard_{host}", 0, 1, "val")
    assert [store.names_a_rank(t) for t in ("a", "a_{world_size}", "a_{rank:05d}", "a_{id}")] == [False, False, True, True]


def test_a_shared_training_shard_is_noticed(spark, source, caplog):
    preprocess(spark, config(source, num_train_shards=1), FORMAT, ByteEncoder())
    assert store.load_shard_for_rank(spark, f"{source}/out", "shard_0", 1, 2).count() == 205
    assert "same shard" in caplog.text


def test_shard_filters_prune_folders(spark, source):
    preprocess(spark, config(source, num_train_shards=3), FORMAT, ByteEncoder())
    one = store.read_all_shards(spark, f"{source}/out").where("split = 'train' AND shard_id = 1")
    plan = plan_of(one)
    assert "DataFilters: []" in plan and "(shard_id#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert one.count() == 69


def test_shards_by_rank(spark):
    manifest = store.shard_manifest(spark.createDataFrame([("train", 0), ("val", 1)], "split string, shard_id int"), {"train": 2, "val": 2})
    found = {r.rank: (r.shard_name, r.found) for r in store.resolve_shards(manifest, "shard_{rank}", 3).collect()}
    assert found == {0: ("shard_0", True), 1: ("shard_1", True), 2: ("shard_2", False)}
    see = lambda template: {r.rank: r.shard_name for r in store.visible_validation_shards(manifest, template, 2).collect()}
    assert see(None) == see("") == {0: None, 1: None}
    assert see("val_shard_0") == {0: "val_shard_0", 1: None}
    assert see("val_shard_{world_size}") == {0: "val_shard_2", 1: None}
    assert see("val_shard_{rank}") == {0: "val_shard_0", 1: "val_shard_1"}
    for bad in ("{host}", "{rank!r}", "{rank:>4}"):
        with pytest.raises(ValueError):
            store.resolve_shards(manifest, bad, 2)


def test_write_plan_shuffles_once(spark, source):
    cfg = config(source, num_train_shards=4, num_val_shards=1, val_split_ratio=0.1)
    plan = plan_of(tokenized_examples(spark.read.parquet(cfg.path), cfg, FORMAT, ByteEncoder()))
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1
    assert "SinglePartition" not in plan and "Python" not in plan


def positioned(spark, n, shards):
    df = spark.range(n).select(F.col("id").alias("position"), F.lit("train").alias("split"))
    return df.withColumn("shard_id", ops.shard_of(F.col("position"), n, shards))


@pytest.mark.parametrize("per_slice", [8, 1_000_000])
def test_epochs_are_permutations(spark, per_slice):
    df = batches.shuffled_epochs(positioned(spark, 90, 2), 3, 1, per_slice)
    rows = df.collect()
    orders = {}
    for r in rows:
        orders.setdefault((r.epoch, r.shard_id), []).append((r.rn, r.position))
    for (_, shard), pairs in orders.items():
        assert sorted(rn for rn, _ in pairs) == list(range(45))
        assert sorted(p for _, p in pairs) == list(range(shard * 45, shard * 45 + 45))
    assert len({tuple(p for _, p in sorted(v)) for k, v in orders.items() if k[1] == 0}) == 3


def test_epoch_order_does_not_depend_on_slices(spark):
    df = positioned(spark, 200, 2)
    one, many = (batches.shuffled_epochs(df, 2, 1, n) for n in (1_000_000, 20))
    assert one.exceptAll(many.select(*one.columns)).count() == 0


def test_batches(spark):
    df = batches.stored_order(positioned(spark, 45, 1), F.lit(0))
    rows = batches.assemble_batches(batches.with_batches(df, 4), ["position"]).orderBy("batch_id").collect()
    assert len(rows) == 12 and rows[-1].position == [44]
    assert [p for r in rows for p in r.position] == list(range(45))
    with pytest.raises(ValueError):
        batches.with_batches(df, 0)
    assert batches.validation_batch_size(None, 4) == batches.validation_batch_size(0, 4) == 4
    assert batches.validation_batch_size(2, 4) == 2


def test_step_plan(spark):
    manifest = spark.createDataFrame([("train", 0, "shard_0", 45), ("train", 1, "shard_1", 0), ("val", 0, "val_shard_0", 9)], store.MANIFEST_SCHEMA)
    rows = {r.shard_id: r for r in step_plan(manifest, 4, 3, 0.03).collect()}
    assert (rows[0].batches_per_epoch, rows[0].total_steps, rows[0].warmup_steps, rows[0].has_schedule) == (12, 36, 1, True)
    assert (rows[1].total_steps, rows[1].has_schedule) == (0, False) and len(rows) == 2


def test_small_cluster_configuration(spark, folder):
    """150 examples, ratio 0.1, three training shards, batches of 4: 45 rows and 12 steps per rank."""
    path = "/root/testdata/sf0.001/documents.parquet"
    cfg = PreprocessConfig(
        path, ("doc_id",), f"{folder}/out", train_max_examples=150, val_max_examples=50, num_train_shards=3,
        num_val_shards=1, val_split_ratio=0.1, max_length=512,
    )
    manifest = preprocess(spark, cfg, InstructionFormatter("lang", "text", "source"), ByteEncoder())
    assert sizes(manifest) == {"shard_0": 45, "shard_1": 45, "shard_2": 45, "val_shard_0": 15}
    assert {r.total_steps for r in step_plan(manifest, 4, 1, 0.03).collect()} == {12}


def test_config_precedence():
    nested = {
        "dataset": {"name": "in", "key": ["k"], "split": "train", "subset": "s", "val_subset": "v", "val_split_ratio": 0.5},
        "model": {"max_length": 64},
        "preprocess": {"output_dir": "out", "train": {"num_shards": 4, "subset": None, "max_examples": 150}, "val": {"num_shards": 1, "subset": "w"}, "val_split_ratio": 0.1},
    }
    cfg = PreprocessConfig.from_mapping(nested)
    assert (cfg.subset, cfg.val_subset, cfg.val_split_ratio) == ("s", "w", 0.1)
    assert (cfg.train_max_examples, cfg.val_max_examples, cfg.max_length, cfg.num_train_shards, cfg.num_val_shards) == (150, None, 64, 4, 1)
    nested["preprocess"]["train"]["subset"] = "t"
    assert PreprocessConfig.from_mapping(nested).subset == "t"
