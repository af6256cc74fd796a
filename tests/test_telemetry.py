import json
import math
import os

import pytest
from pyspark.sql import functions as F

from quillshard.functions import metrics as m
from quillshard.operators import telemetry as tele
from quillshard.sources import runlogs
from quillshard.streaming.metrics import publish_each

STEPS = "run_id string, rank int, step bigint, loss double, duration double, tokens bigint, grad_norm double"


def steps(spark, rows):
    return spark.createDataFrame(rows, STEPS)


def test_step_metrics_edges(spark):
    rows = [
        ("r", 0, 1, 1.0, 0.5, 100, 2.0), ("r", 0, 2, 25.0, 0.0, 100, None), ("r", 0, 3, math.nan, None, 100, 0.0),
        ("r", 0, 4, -1.0, -1.0, 100, 1.0), ("r", 0, 5, None, 2.0, 0, 1.0),
    ]
    got = {r.step: r for r in tele.step_metrics(steps(spark, rows)).collect()}
    assert got[1].perplexity == pytest.approx(math.e) and got[1].steps_per_second == 2.0 and got[1].tokens_per_second == 200.0
    assert got[2].perplexity == pytest.approx(math.exp(20)) and got[2].tokens_per_second == 0.0 and got[2].grad_norm_payload == 0.0
    assert math.isnan(got[3].perplexity) and got[3].step_duration == 0.0 and got[3].steps_per_second == 0.0
    assert got[4].steps_per_second == 0.0 and got[4].perplexity == pytest.approx(math.exp(-1))
    assert got[5].tokens_per_second == 0.0
    published = [r.step for r in tele.published(steps(spark, rows + [("r", 1, 9, 1.0, 1.0, 1, 1.0)])).collect()]
    assert sorted(published) == [1, 2, 3, 4]


def test_cadence(spark):
    rows = steps(spark, [("r", 0, i, 1.0, 1.0, 1, None) for i in range(0, 13)])
    pick = lambda df: sorted(r.step for r in df.collect())
    assert pick(tele.every_n_steps(rows.where("step > 0"), 5)) == [5, 10]
    assert pick(tele.validation_steps(rows, 6)) == [6, 12]
    assert pick(tele.validation_steps(rows, None)) == []
    assert pick(tele.executed_steps(rows.where("step > 0"), 0)) == [1]
    assert pick(tele.executed_steps(rows.where("step > 0"), 3)) == [1, 2, 3]
    assert len(pick(tele.executed_steps(rows, None))) == 13
    for bad in (0, -1):
        with pytest.raises(ValueError):
            tele.every_n_steps(rows, bad)


@pytest.mark.parametrize("per_slice", [3, 1_000_000])
def test_gauge_keeps_its_last_value(spark, per_slice):
    norms = [None, 1.5, None, None, 0.0, None, 3.0, None]
    rows = steps(spark, [("r", 0, i, 1.0, 1.0, 1, v) for i, v in enumerate(norms)])
    got = {r.step: r.g for r in tele.gauge_history(rows, ["step"], {"grad_norm": "g"}, per_slice).collect()}
    assert [got[i] for i in range(8)] == [0.0, 1.5, 1.5, 1.5, 0.0, 0.0, 3.0, 3.0]


def test_validation_means(spark):
    rows = [("a", 1, {"a": 1.0}), ("a", 1, {"a": 3.0, "b": 4.0}), ("a", 1, {}), ("a", 2, {}), ("b", 1, {"a": 5.0}), ("b", 1, None)]
    df = spark.createDataFrame(rows, "run string, step int, metrics map<string,double>")
    got = {(r.run, r.step, r.metric): (r["mean"], r.num_batches) for r in tele.validation_means(df, ["run", "step"]).collect()}
    assert got == {("a", 1, "a"): (2.0, 2), ("a", 1, "b"): (2.0, 2), ("b", 1, "a"): (5.0, 1)}


def test_gradient_norm(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 4.0), (1, None), (2, None)], "step int, norm double")
    assert {r.step: r.grad_norm for r in tele.gradient_norm(df).collect()} == {1: 5.0, 2: None}


def test_accumulated_loss_and_ranks(spark):
    micro = steps(spark, [("r", 0, 1, x, 1.0, 1, None) for x in (1.0, 2.0, 3.0, 6.0)])
    assert tele.accumulated_loss(micro, 4).first().loss == 3.0
    ranks = steps(spark, [("r", 0, 1, 1.0, 0.5, 10, None), ("r", 1, 1, 3.0, None, 30, None)])
    row = tele.across_ranks(ranks).first()
    assert (row.tokens, row.duration, row.loss, row.ranks) == (40, 0.5, 2.0, 2)


@pytest.mark.parametrize(
    "rank, slurm, want",
    [("3", "5", 3), (None, "5", 5), ("x", "5", 5), ("x", None, 0), (None, None, 0), (" 7 ", None, 7), ("+2", None, 2), ("1_000", None, 1000),
     ("1__0", "4", 4), ("1.5", None, 0), ("", "", 0), ("-1", None, -1), ("3\n", None, 3)],
)
def test_rank_from_text(spark, rank, slurm, want):
    df = spark.createDataFrame([(rank, slurm)], "a string, b string")
    assert df.select(m.env_rank(F.col("a"), F.col("b")).alias("r")).first().r == want


def test_run_log_files(spark, folder):
    os.makedirs(f"{folder}/logs")
    lines = [
        "2024-05-01 10:00:00.123 | INFO     | rank  0/3  | train | [step 50] train_loss=1.2500 acc=nan\n",
        "mode: train\n", "  nested: | pipe\n", "\n",
        "2024-05-01 10:00:01.000 | WARNING  | rank 12/16 | train | Skipping on rank %s | because\n",
        "2024-05-01 10:00:02.000 | INFO     | rank  0/3  | train | [step 100] a=b=1.0000\n",
    ]
    for name, part in (("train_rank_0.log", lines), ("train_rank_1.log", lines[:1]), ("other.txt", lines)):
        with open(f"{folder}/logs/{name}", "w") as f:
            f.writelines(part)
    logs = runlogs.read_run_logs(spark, folder)
    rows = sorted(logs.collect(), key=lambda r: (r.file, r.ts))
    assert [(r.file, r.level, r.rank, r.world_size, r.process) for r in rows] == [
        ("train_rank_0.log", "INFO", 0, 3, "train"), ("train_rank_0.log", "WARNING", 12, 16, "train"),
        ("train_rank_0.log", "INFO", 0, 3, "train"), ("train_rank_1.log", "INFO", 0, 3, "train"),
    ]
    assert rows[0].ts.microsecond == 123000 and rows[1].message == "Skipping on rank %s | because"
    metrics = runlogs.parse_metric_messages(logs.where("file = 'train_rank_0.log'").select("rank", "message")).collect()
    got = {(r.step, r.metric): r.value for r in metrics}
    assert got[(50, "train_loss")] == 1.25 and math.isnan(got[(50, "acc")]) and got[(100, "a=b")] == 1.0


def test_summaries(spark, folder):
    for run, steps_done in (("a", 10), ("b", 20)):
        os.makedirs(f"{folder}/{run}")
        config = {"model_name": run, "batch_size": 4, "lora": {"r": 8, "target_modules": ["q"]}, "deepspeed_config": {"zero": {"stage": 2}}, "max_steps": None}
        with open(f"{folder}/{run}/summary.json", "w") as f:
            json.dump({"config": config, "global_step": steps_done, "total_time_seconds": 1.5}, f, indent=2)
    rows = {r.config.model_name: r for r in runlogs.read_run_summaries(spark, f"{folder}/*/summary.json").collect()}
    assert {k: r.global_step for k, r in rows.items()} == {"a": 10, "b": 20}
    assert rows["a"].config.lora.target_modules == ["q"] and rows["a"].config.max_steps is None
    assert json.loads(rows["a"].config.deepspeed_config) == {"zero": {"stage": 2}}
    runlogs.write_run_summaries(
        runlogs.read_run_summaries(spark, f"{folder}/*/summary.json").withColumn("run_id", F.col("config.model_name")), f"{folder}/again"
    )
    assert runlogs.read_run_summaries(spark, f"{folder}/again").drop("run_id").exceptAll(runlogs.read_run_summaries(spark, f"{folder}/*/summary.json")).count() == 0


def test_callback_on_executors(spark, folder):
    rows = [("r", rank, i, 1.0, 0.5, 10, None) for rank in (0, 1) for i in range(1, 6)]

    def callback(payload, step):
        with open(f"{folder}/{step}", "w") as f:
            f.write(json.dumps(payload))

    publish_each(steps(spark, rows).repartition(3), callback)
    assert sorted(os.listdir(folder)) == ["1", "2", "3", "4", "5"]
    want = {"grad_norm": 0.0, "loss": 1.0, "perplexity": math.e, "step_duration": 0.5, "steps_per_second": 2.0, "tokens_per_second": 20.0}
    with open(f"{folder}/1") as f:
        assert json.load(f) == pytest.approx(want)
