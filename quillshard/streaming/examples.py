"""Preprocessing an unbounded stream of raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from quillshard.functions.encoders import Encoder
from quillshard.functions.examples import encode_rows, to_examples
from quillshard.functions.formatting import Formatter
from quillshard.operators.buckets import any_null, shuffle_key
from quillshard.sources import folders

# Folders of numbered examples and, by batch, of the next slot of each shard.
NUMBERED, SLOTS = "examples", "slots"


def hashed_shard(seed: int, num_shards: int, *keys: Column) -> Column:
    """A shard for a row that has no global position: a stream has no last row to count from."""
    digits = F.substring(shuffle_key(seed, *keys), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(num_shards)).cast("int")


def example_stream(
    raw: DataFrame, keys: list[str], formatter: Formatter, encoder: Encoder, max_length: int, num_shards: int, seed: int = 42,
    files_per_shard: int = 4,
) -> DataFrame:
    """Formatted, encoded, padded and labelled rows of a stream; no state is kept.

    Rows of a shard meet in ``files_per_shard`` tasks of each micro-batch, dealt by a hash of the key, so a shard is a few files
    of each batch and not one for every task. What is shuffled are the encoded payloads; padding comes after.
    """
    encoded = encode_rows(raw, formatter, encoder, max_length)
    key = [F.col(k) for k in keys]
    placed = encoded.withColumns({
        "shard_id": hashed_shard(seed, num_shards, *key), "__file": F.pmod(F.xxhash64(*key), F.lit(files_per_shard)).cast("int")})
    dealt = placed.repartition(num_shards * files_per_shard, "shard_id", "__file").drop("__file")
    return to_examples(dealt, encoder, max_length, (*keys, "shard_id"))


def append_examples(examples: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    writer = (
        examples.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .partitionBy("shard_id")
        .format("parquet")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def append_numbered(
    raw: DataFrame, keys: list[str], formatter: Formatter, encoder: Encoder, max_length: int, num_shards: int, path: str,
    checkpoint: str, seed: int = 42, files_per_shard: int = 4, available_now: bool = False,
) -> StreamingQuery:
    """Append examples of a stream with a ``slot``: the rows of a shard are numbered from 0 without gaps, over batches and restarts.

    Slots follow the batches; within a batch they follow the file of the row, a digest of its key, and the unique, non-null key. A
    batch counts its rows by shard and file from the key columns, continues the slots of the batch before and then numbers each file's
    compact rows in a task of its own. Examples and the next slots lie under the batch's number, so a batch that is tried
    again replaces what it left and takes the same slots.
    """
    no_null = F.raise_error(F.lit(f"null in the key columns {keys}")).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = [F.col(k) for k in keys]
        digest = F.substring(shuffle_key(seed, *key), 9, 8)
        at = ["shard_id", "__file"]
        placed = encode_rows(batch, formatter, encoder, max_length).withColumns({
            "shard_id": F.when(any_null(keys), no_null).otherwise(hashed_shard(seed, num_shards, *key)),
            "__file": F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(files_per_shard)).cast("int")})
        counts = placed.groupBy(*at).agg(F.count(F.lit(1)).alias("rows"))
        # a row per shard and file at most, so what is broadcast and written here is bounded by the two parameters
        earlier = Window.partitionBy("shard_id").orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
        base = _next_slots(spark, path, batch_id)
        firsts = counts.join(F.broadcast(base), "shard_id", "left").withColumn(
            "first", F.coalesce("next_slot", F.lit(0)) + F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        ledger = firsts.select("shard_id", F.col("__file").alias("file"), "first", (F.col("first") + F.col("rows")).alias("next_slot"))
        ledger = ledger.unionByName(base, allowMissingColumns=True)
        ledger.coalesce(1).write.mode("overwrite").parquet(f"{path}/{SLOTS}/{batch_id}")
        own = _ledger(spark, path, batch_id).where("file IS NOT NULL").select("shard_id", F.col("file").alias("__file"), "first")
        dealt = placed.repartition(num_shards * files_per_shard, *at).join(F.broadcast(own), at)
        slot = (F.col("first") + F.row_number().over(Window.partitionBy(*at).orderBy(*keys)) - 1).alias("slot")
        numbered = dealt.select(*keys, "shard_id", slot, "payload", "prompt_len")
        examples = to_examples(numbered, encoder, max_length, (*keys, "shard_id", "slot"))
        examples.write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/{NUMBERED}/batch_id={batch_id}")
        # only the newest batch can be tried again, and it needs the slots of the one before
        for name in folders.entries(spark, f"{path}/{SLOTS}"):
            if name.isdigit() and int(name) < batch_id - 1:
                folders.remove(spark, f"{path}/{SLOTS}/{name}")

    writer = raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """The examples of ``append_numbered``, with ``batch_id``, ``shard_id`` and ``slot``."""
    return spark.read.parquet(f"{path}/{NUMBERED}")


def _ledger(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The first slot of each file of a batch, and the next slot after it; a shard without rows in the batch has no file."""
    return spark.read.schema("shard_id int, file int, first bigint, next_slot bigint").parquet(f"{path}/{SLOTS}/{batch_id}")


def _next_slots(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """``shard_id, next_slot`` after the batches before this one."""
    before = [int(n) for n in folders.entries(spark, f"{path}/{SLOTS}") if n.isdigit() and int(n) < batch_id]
    if not before:
        return spark.createDataFrame([], "shard_id int, next_slot bigint")
    return _ledger(spark, path, max(before)).groupBy("shard_id").agg(F.max("next_slot").alias("next_slot"))
