"""Dense global row positions without a single-task sort.

Two passes. The first reads only the order key, shuffles its 64-bit hash to find keys that occur twice, at
any size and wherever they lie, and counts rows per bucket; the counts (at most ``MAX_BUCKETS`` rows) are merged on the driver into contiguous parts of bounded size with a running
offset each. The second shuffles every row once, to the task of its part, and numbers it there.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillshard.operators.buckets import (
    MAX_BUCKETS,
    any_null,
    count_keys,
    digest_bucket,
    key_text,
    range_bucket,
    reject_nulls,
    shuffle_key,
)

ROWS_PER_PART = 1_000_000
# The low bits of Spark's increasing id: the row's index within its task.
_ROW_IN_TASK = (1 << 33) - 1
# A table too small to fill its parts is still spread over the cores, down to this size.
_SMALL_PART = 1_000


@dataclass(frozen=True)
class OrderLayout:
    """How an ordered table spreads over parts: bucket -> (part, offset of the part)."""

    bucket: Column
    order: tuple[Column, ...]
    lookup: pd.DataFrame
    total: int
    num_parts: int
    partial: bool = False

    def between(self, first: int, end: int) -> OrderLayout:
        """The layout of the buckets that hold positions ``first`` to ``end - 1``; other rows are not moved at all.

        Neighbours in the same buckets come along, so the caller still filters on the position.
        """
        kept = self.lookup[(self.lookup["__start"] < end) & (self.lookup["__start"] + self.lookup["__n"] > first)].copy()
        # what is kept of a part is one run of buckets, so its rows count from the first of them
        kept["__offset"] = kept.groupby("__part")["__start"].transform("min")
        return replace(self, lookup=kept, partial=True)


def range_layout(df: DataFrame, keys: list[str], rows_per_part: int = ROWS_PER_PART) -> OrderLayout:
    """Layout for the natural order of unique, non-null keys."""
    slim = df.select(*keys)
    total = count_keys(slim, keys)
    bucket = range_bucket(slim, keys, total, 4 * _part_count(df, total, rows_per_part))
    return _layout(slim, keys, bucket, tuple(F.col(k) for k in keys), rows_per_part)


def shuffled_layout(
    df: DataFrame, keys: list[str], seed: int, rows_per_part: int = ROWS_PER_PART
) -> OrderLayout:
    """Layout for a seeded pseudo-random order of unique, non-null keys."""
    slim = df.select(*keys)
    digest = shuffle_key(seed, *[key_text(df, k) for k in keys])
    order = (digest, *[F.col(k) for k in keys])
    return _layout(slim, keys, digest_bucket(digest), order, rows_per_part)


def with_position(df: DataFrame, layout: OrderLayout, into: str = "position") -> DataFrame:
    """Add the 0-based position. Each output task holds one contiguous run of positions."""
    uncounted = F.raise_error(F.lit("a row's order key was not there when rows were counted"))
    if layout.total == 0:
        return df.withColumn(into, uncounted.cast("bigint"))
    columns = ["__bucket", "__part", "__offset"]
    lookup = df.sparkSession.createDataFrame(layout.lookup[columns], "__bucket int, __part int, __offset bigint")
    # the lookup has one row per bucket, so its size is bounded by MAX_BUCKETS
    how = "inner" if layout.partial else "left"
    placed = df.withColumn("__bucket", layout.bucket).join(F.broadcast(lookup), "__bucket", how)
    part = F.coalesce("__part", uncounted)
    # each task receives exactly one part, so a row's place in its sorted task is its place in the part;
    # counting rows as they pass needs no buffer, which a window function over the part would
    routed = placed.withColumn("__part", part).repartitionById(layout.num_parts, F.col("__part"))
    in_task = F.monotonically_increasing_id().bitwiseAND(_ROW_IN_TASK)
    ordered = routed.sortWithinPartitions(*layout.order)
    return ordered.withColumn(into, F.col("__offset") + in_task).drop("__bucket", "__part", "__offset")


def _part_count(df: DataFrame, total: int, rows_per_part: int) -> int:
    """Parts of at most about ``rows_per_part`` rows; small tables still use the cores there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    spread = min(cores, -(-total // min(_SMALL_PART, rows_per_part)))
    return max(2, min(MAX_BUCKETS, max(-(-total // rows_per_part), spread)))


def _reject_duplicates(slim: DataFrame, keys: list[str], hashed: DataFrame) -> None:
    """Raise if rows share a key; rows that share only the key's hash pass."""
    met = hashed.where(F.col("same") > 1).select(F.col("digest").alias("__digest"))
    suspect = slim.join(met, F.xxhash64(*keys) == F.col("__digest"), "left_semi")
    worst = suspect.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > 1)
    found = worst.agg(F.count(F.lit(1)).alias("keys"), F.max("__rows").alias("rows")).first()
    if found["keys"]:
        raise ValueError(f"the order key {keys} is not unique: {found['keys']} keys occur more than once, one of them {found['rows']} times")


def _layout(
    slim: DataFrame, keys: list[str], bucket: Column, order: tuple[Column, ...], rows_per_part: int
) -> OrderLayout:
    # equal keys have equal hashes; a hash that occurs once cannot hide a duplicate
    digest = F.xxhash64(*keys)
    hashed = slim.groupBy(bucket.alias("bucket"), digest.alias("digest")).agg(
        F.count(F.lit(1)).alias("same"), F.count_if(any_null(keys)).alias("nulls"))
    counts = (
        hashed.groupBy("bucket")
        .agg(F.sum("same").alias("n"), F.sum("nulls").alias("nulls"), F.max("same").alias("same"))
        .toPandas()
        .sort_values("bucket")
    )
    reject_nulls(int(counts["nulls"].sum()), keys)
    n = counts["n"].to_numpy(dtype=np.int64)
    total = int(n.sum())
    if len(n) and counts["same"].max() > 1:
        _reject_duplicates(slim, keys, hashed)
    start = np.cumsum(n) - n
    wanted = _part_count(slim, total, rows_per_part)
    # a part is the run of buckets that start in the same equal stretch of positions
    part = start * wanted // max(total, 1)
    offset = pd.Series(start).groupby(part).transform("min") if len(n) else start
    lookup = pd.DataFrame(
        {
            "__bucket": counts["bucket"].to_numpy(dtype=np.int32),
            "__part": np.asarray(part, dtype=np.int32),
            "__offset": np.asarray(offset, dtype=np.int64),
            "__start": start,
            "__n": n,
        }
    )
    return OrderLayout(bucket, order, lookup, total, wanted)
