"""Live metric streams: scrape windows and the per-step metrics callback."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillshard.operators.telemetry import RUN, metric_payload, published, scraped_gauges, step_metrics
from quillshard.sources import folders

# Batches whose folders become one.
MERGE_EVERY = 32


def scrape_stream(samples: DataFrame, delay: str, order_by: list[str]) -> DataFrame:
    """Scrape windows over a stream of gauge samples.

    ``ts`` must be a timestamp with time zone. Samples later than ``delay`` behind the newest one are
    dropped, which also lets Spark forget closed windows; ``lost_samples`` counts them.
    """
    return scraped_gauges(samples.withWatermark("ts", delay), order_by)


def upsert_windows(
    windows: DataFrame, path: str, checkpoint: str, available_now: bool = False, merge_every: int = MERGE_EVERY
) -> StreamingQuery:
    """Keep the windows of each batch under ``path/batch_id=...``; ``read_windows`` shows the latest version of each.

    A batch that is retried after a failure overwrites its own folder, so nothing is counted twice. Every ``merge_every`` batches
    their folders are merged into one, ``merge_every`` of these into a wider one, and so on: a version
    is rewritten once for each width, and the folders number as the logarithm of the batches. A merged folder appears whole, by a rename;
    what it replaces stands until the next merge, for readers that had listed it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0 and set(folders.entries(spark, path)) - {"batch_id=0"}:
            raise ValueError(f"{path} holds the windows of another checkpoint")
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if (batch_id + 1) % merge_every == 0:
            _merge(spark, path, batch_id, merge_every)

    writer = windows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of each window."""
    current, _ = _ranges(spark, path)
    return _latest(spark, path, [name for _, _, name in current]).drop("version")


def _ranges(spark: SparkSession, path: str) -> tuple[list[tuple[int, int, str]], list[str]]:
    """``first, last, name`` of the folders that hold all batches, and the names that wider ones replace."""
    found = []
    for name in folders.entries(spark, path):
        kind, _, batches = name.partition("=")
        if kind in ("batch_id", "merged"):
            first, _, last = batches.partition("-")
            found.append((int(first), int(last or first), name))
    current, replaced = [], []
    for first, last, name in sorted(found, key=lambda r: (r[0], -r[1])):
        if current and last <= current[-1][1]:
            replaced.append(name)
        else:
            current.append((first, last, name))
    return current, replaced


def _latest(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    versions = spark.read.parquet(*[f"{path}/{name}" for name in names])
    latest = F.max_by(F.struct("value", "samples", "version"), "version").alias("w")
    return versions.groupBy(*RUN, "metric", "window_start").agg(latest).select(*RUN, "metric", "window_start", "w.*")


def _merge(spark: SparkSession, path: str, batch_id: int, merge_every: int) -> None:
    """Merge the widest run of batches that is complete with this one."""
    width = merge_every
    while (batch_id + 1) % (width * merge_every) == 0:
        width *= merge_every
    first = batch_id + 1 - width
    current, replaced = _ranges(spark, path)
    for name in replaced:
        folders.remove(spark, f"{path}/{name}")
    hidden = f"{path}/_{uuid.uuid4().hex}"
    _latest(spark, path, [name for start, last, name in current if start >= first and last <= batch_id]).write.parquet(hidden)
    if not folders.rename_new(spark, hidden, f"{path}/merged={first}-{batch_id}"):
        # the batch is tried again, and had come this far
        folders.remove(spark, hidden)


def lost_samples(samples: DataFrame, windows: DataFrame, order_by: list[str]) -> DataFrame:
    """Windows that lack samples which had arrived, with how many (``lost``): what the watermark dropped.

    ``samples`` is the table that the stream has read so far, ``windows`` what ``read_windows`` shows of it.
    """
    at = [*RUN, "metric", "window_start"]
    due = scraped_gauges(samples, order_by).select(*at, F.col("samples").alias("due"))
    seen = windows.select(*[F.col(c).alias(f"__{c}") for c in at], F.col("samples").alias("seen"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in at]
    short = due.join(seen, same, "left").withColumn("lost", F.col("due") - F.coalesce("seen", F.lit(0)))
    return short.where(F.col("lost") > 0).select(*at, "lost")


def publish_stream(
    steps: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Hand each micro-batch of published steps to ``callback(payloads, batch_id)``.

    ``payloads`` has ``run_id``, ``rank``, ``step`` and the ``payload`` map, and stays distributed.
    """
    payloads = published(step_metrics(steps)).select(*RUN, "step", metric_payload().alias("payload"))
    writer = payloads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(callback)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def publish_each(steps: DataFrame, callback: Callable[[dict[str, float], int], None]) -> None:
    """Call ``callback(payload, step)`` once per published step, on the executors, in step order for each run and rank."""
    payloads = published(step_metrics(steps)).select(*RUN, "step", metric_payload().alias("payload"))

    def call(rows) -> None:
        for row in rows:
            callback(row["payload"], row["step"])

    payloads.repartition(*RUN).sortWithinPartitions(*RUN, "step").foreachPartition(call)
