import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalog import queries as q
from quillshard.functions.encoders import ByteEncoder
from quillshard.functions.examples import encode_rows, to_examples
from quillshard.functions.formatting import InstructionFormatter
from quillshard.operators.telemetry import scraped_gauges
from quillshard.streaming import examples as ex
from quillshard.streaming import metrics as sm
from tests.conftest import SF_SMALL

SAMPLES = "run_id string, rank int, metric string, ts timestamp, event_id bigint, value double"
START = dt.datetime(2024, 1, 1)


def sample(i, second, value):
    return ("r", 0, "loss", START + dt.timedelta(seconds=second), i, float(value))


def write(spark, folder, batch, rows):
    spark.createDataFrame(rows, SAMPLES).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def source(spark, folder):
    return spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(spark, folder, delay):
    windows = sm.scrape_stream(source(spark, folder), delay, ["ts", "event_id"])
    sm.upsert_windows(windows, f"{folder}/out", f"{folder}/state", available_now=True).awaitTermination()
    return {(r.window_start - START).total_seconds(): (r.value, r.samples) for r in sm.read_windows(spark, f"{folder}/out").collect()}


def test_windows_are_updated_across_batches_and_restarts(spark, folder):
    write(spark, folder, 0, [sample(0, 0, 1), sample(1, 4, 2), sample(2, 5, 3)])
    assert run(spark, folder, "1 hour") == {0: (2.0, 2), 5: (3.0, 1)}
    write(spark, folder, 1, [sample(3, 4.5, 9), sample(4, 7, 4)])
    # the query picks up its state from the checkpoint and sees only the new file
    assert run(spark, folder, "1 hour") == {0: (9.0, 3), 5: (4.0, 2)}
    rows = spark.read.schema(SAMPLES).parquet(f"{folder}/in")
    batch = {(r.window_start - START).total_seconds(): (r.value, r.samples) for r in scraped_gauges(rows, ["ts", "event_id"]).collect()}
    assert run(spark, folder, "1 hour") == batch


def test_late_samples_are_dropped(spark, folder):
    write(spark, folder, 0, [sample(0, 0, 1), sample(1, 100, 2)])
    run(spark, folder, "10 seconds")
    write(spark, folder, 1, [sample(2, 101, 3)])
    run(spark, folder, "10 seconds")
    write(spark, folder, 2, [sample(3, 1, 99), sample(4, 96, 5)])
    assert run(spark, folder, "10 seconds") == {0: (1.0, 1), 95: (5.0, 1), 100: (3.0, 2)}
    arrived = spark.read.schema(SAMPLES).parquet(f"{folder}/in")
    lost = sm.lost_samples(arrived, sm.read_windows(spark, f"{folder}/out"), ["ts", "event_id"]).collect()
    assert [((r.window_start - START).total_seconds(), r.lost) for r in lost] == [(0.0, 1)]


def test_published_stream_hands_over_payloads(spark, folder):
    schema = "run_id string, rank int, step bigint, loss double, duration double, tokens bigint, grad_norm double"
    spark.createDataFrame([("r", k, i, None if i == 3 else 1.0, 0.5, 10, None) for k in (0, 1) for i in range(5)], schema).write.parquet(f"{folder}/in")
    seen = []
    steps = spark.readStream.schema(schema).parquet(f"{folder}/in")
    query = sm.publish_stream(steps, lambda df, batch: seen.extend(df.select("step", "payload").collect()), f"{folder}/state", available_now=True)
    query.awaitTermination()
    assert sorted(r.step for r in seen) == [0, 1, 2, 4]
    assert seen[0].payload["tokens_per_second"] == 20.0 and seen[0].payload["grad_norm"] == 0.0


def test_example_stream_equals_batch(spark, folder):
    formatter, encoder = InstructionFormatter("q", "a"), ByteEncoder()
    rows = spark.range(40).select(F.col("id").alias("k"), F.col("id").cast("string").alias("q"), F.lit("yes").alias("a"))
    rows.repartition(4).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = ex.example_stream(stream, ["k"], formatter, encoder, 48, 3)
    ex.append_examples(out, f"{folder}/out", f"{folder}/state", available_now=True).awaitTermination()
    got = spark.read.parquet(f"{folder}/out").drop("shard_id")
    batch = to_examples(encode_rows(rows, formatter, encoder, 48), encoder, 48, ("k",))
    assert batch.exceptAll(got.select(*batch.columns)).count() == 0 and got.count() == 40
    assert spark.read.parquet(f"{folder}/out").select("shard_id").distinct().count() == 3


def numbered(spark, folder, files_per_shard=2):
    formatter, encoder = InstructionFormatter("q", "a"), ByteEncoder()
    schema = "k bigint, q string, a string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return ex.append_numbered(
        stream, ["k"], formatter, encoder, 32, 3, f"{folder}/out", f"{folder}/state", files_per_shard=files_per_shard, available_now=True)


def add_rows(spark, folder, keys):
    rows = [(k, f"q{k}", "a") for k in keys]
    spark.createDataFrame(rows, "k bigint, q string, a string").coalesce(1).write.mode("append").parquet(f"{folder}/in")


def slots_of(spark, folder):
    found = {}
    for r in ex.read_numbered(spark, f"{folder}/out").select("shard_id", "slot", "k", "batch_id").collect():
        found.setdefault(r.shard_id, []).append((r.slot, r.batch_id, r.k))
    return {shard: sorted(rows) for shard, rows in found.items()}


def test_slots_have_no_gaps_over_triggers_and_restarts(spark, folder):
    for low, high in ((0, 30), (30, 33), (33, 34)):
        add_rows(spark, folder, range(low, high))
    numbered(spark, folder).awaitTermination()
    before = slots_of(spark, folder)
    add_rows(spark, folder, range(34, 70))
    numbered(spark, folder).awaitTermination()
    after = slots_of(spark, folder)
    for shard, rows in after.items():
        assert [slot for slot, _, _ in rows] == list(range(len(rows)))
        assert [batch for _, batch, _ in rows] == sorted(batch for _, batch, _ in rows)
        assert rows[: len(before[shard])] == before[shard]
    assert sorted(k for rows in after.values() for _, _, k in rows) == list(range(70))
    # the slots of two batches are all that is kept
    assert len([n for n in ex.folders.entries(spark, f"{folder}/out/slots") if n.isdigit()]) == 2


def test_a_batch_that_failed_takes_the_same_slots_again(spark, folder, monkeypatch):
    add_rows(spark, folder, range(20))
    numbered(spark, folder).awaitTermination()
    add_rows(spark, folder, range(20, 50))

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        # the slots of the batch are written, its examples are not
        m.setattr(ex, "to_examples", dies)
        try:
            numbered(spark, folder).awaitTermination()
            failed = False
        except Exception:  # noqa: BLE001
            failed = True
    assert failed and max(len(rows) for rows in slots_of(spark, folder).values()) <= 20
    numbered(spark, folder).awaitTermination()
    after = slots_of(spark, folder)
    assert all([slot for slot, _, _ in rows] == list(range(len(rows))) for rows in after.values())
    assert sum(map(len, after.values())) == 50


def test_a_null_key_stops_the_stream(spark, folder):
    add_rows(spark, folder, [1, None])
    try:
        numbered(spark, folder).awaitTermination()
        stopped = False
    except Exception as err:  # noqa: BLE001
        stopped = "null in the key columns" in str(err)
    assert stopped


def test_window_folders_are_merged(spark, folder):
    arrived = []
    for batch in range(9):
        # each batch sets one new window and sets an early one anew
        arrived += [sample(2 * batch, 60 * batch, batch), sample(2 * batch + 1, batch / 10, 100 + batch)]
        write(spark, folder, batch, arrived[-2:])
    windows = sm.scrape_stream(source(spark, folder), "1 hour", ["ts", "event_id"])
    sm.upsert_windows(windows, f"{folder}/out", f"{folder}/state", available_now=True, merge_every=2).awaitTermination()
    names = [n for n in sm.folders.entries(spark, f"{folder}/out") if "=" in n]
    assert "merged=0-7" in names and "batch_id=0" not in names and "merged=0-1" not in names
    current, replaced = sm._ranges(spark, f"{folder}/out")
    assert [first for first, _, _ in current] == [0] + [last + 1 for _, last, _ in current[:-1]] and len(replaced) <= 4
    got = {(r.window_start, r.value, r.samples) for r in sm.read_windows(spark, f"{folder}/out").collect()}
    want = scraped_gauges(spark.createDataFrame(arrived, SAMPLES), ["ts", "event_id"])
    assert got == {(r.window_start, r.value, r.samples) for r in want.collect()} and len(got) == 9
    # a batch that is tried again after its merge changes nothing
    sm._merge(spark, f"{folder}/out", 7, 2)
    assert {(r.window_start, r.value, r.samples) for r in sm.read_windows(spark, f"{folder}/out").collect()} == got
    assert not [n for n in sm.folders.entries(spark, f"{folder}/out") if n.startswith("_")]


def test_a_new_checkpoint_does_not_write_over_windows(spark, folder):
    write(spark, folder, 0, [sample(0, 0, 1)])
    run(spark, folder, "1 hour")
    write(spark, folder, 1, [sample(1, 9, 1)])
    run(spark, folder, "1 hour")
    windows = sm.scrape_stream(source(spark, folder), "1 hour", ["ts", "event_id"])
    stopped = False
    try:
        sm.upsert_windows(windows, f"{folder}/out", f"{folder}/state2", available_now=True).awaitTermination()
    except Exception as err:  # noqa: BLE001
        stopped = "another checkpoint" in str(err)
    assert stopped


@pytest.mark.parametrize("query, table", [(q.q_stream_preprocess, "documents"), (q.q_stream_scrape, "events")])
def test_a_table_streams_as_a_file_and_as_a_folder_of_files(spark, folder, query, table):
    spark.read.parquet(f"{SF_SMALL}/{table}.parquet").repartition(5).write.parquet(f"{folder}/{table}.parquet")
    whole, parts = query(spark, SF_SMALL), query(spark, folder)
    assert whole.count() > 0 and whole.count() == parts.count()
    assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty()


@pytest.mark.parametrize("query, table, turns", [(q.q_stream_slots, "documents", 3), (q.q_stream_scrape_triggers, "events", 4)])
def test_no_single_task_writes_what_a_stream_takes(spark, folder, monkeypatch, query, table, turns):
    spark.read.parquet(f"{SF_SMALL}/{table}.parquet").repartition(5).write.parquet(f"{folder}/{table}.parquet")
    monkeypatch.setattr(q, "scratch_dir", lambda *_: f"{folder}/scratch")
    parts = query(spark, folder)
    written = [n for n in ex.folders.entries(spark, f"{folder}/scratch/in") if n.endswith(".parquet")]
    assert len(written) > 2 * turns
    if table == "documents":
        # a micro-batch is still one turn
        batches = ex.read_numbered(spark, f"{folder}/scratch/out").select("batch_id", F.col("doc_id") % 3).distinct().collect()
        assert sorted(map(tuple, batches)) == [(0, 0), (1, 1), (2, 2)]
    got = parts.collect()
    monkeypatch.undo()
    assert sorted(map(str, got)) == sorted(map(str, query(spark, SF_SMALL).collect()))
