"""Contiguous sharding of positioned rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shard_size(total: int, num_shards: int) -> int:
    if num_shards < 1:
        raise ValueError("num_shards must be at least 1")
    return -(-total // num_shards)


def shard_of(position: Column, total: int, num_shards: int) -> Column:
    """The shard of a position: equal stretches of ``ceil(total / num_shards)`` rows."""
    return F.floor(position / max(1, shard_size(total, num_shards))).cast("int")


def shard_bounds(total: int, num_shards: int, shard_id: int) -> tuple[int, int]:
    """First and one-past-last position of a shard; trailing shards may be short or empty."""
    if not 0 <= shard_id < num_shards:
        raise ValueError(f"shard_id {shard_id} is not in 0..{num_shards - 1}")
    size = shard_size(total, num_shards)
    start = min(shard_id * size, total)
    return start, min(start + size, total)


def one_shard(df: DataFrame, total: int, num_shards: int, shard_id: int) -> DataFrame:
    start, end = shard_bounds(total, num_shards, shard_id)
    return df.where((F.col("position") >= start) & (F.col("position") < end))


def assign_shards(df: DataFrame, totals: Mapping[str, int], num_shards: Mapping[str, int]) -> DataFrame:
    """Add ``shard_id`` per split. Rows of a split with no shards are stored nowhere."""
    stored = [s for s in totals if num_shards.get(s, 0) > 0]
    if not stored:
        return df.where(F.lit(False)).withColumn("shard_id", F.lit(0))
    branch = F
    for split in stored:
        branch = branch.when(F.col("split") == split, shard_of(F.col("position"), totals[split], num_shards[split]))
    kept = df if len(stored) == len(totals) else df.where(F.col("split").isin(stored))
    return kept.withColumn("shard_id", branch)
