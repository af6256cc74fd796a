"""Epoch order, batches and their token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillshard.operators.buckets import shuffle_key
from quillshard.operators.groups import ROWS_PER_SLICE, number_rows

SHARD = ["split", "shard_id"]


def validation_batch_size(val_batch_size: int | None, batch_size: int) -> int:
    """The validation batch size, or the training one where none (or 0) is given."""
    return val_batch_size or batch_size


def shuffled_epochs(
    df: DataFrame, epochs: int, seed: int, rows_per_slice: int = ROWS_PER_SLICE, largest_shard: int | None = None
) -> DataFrame:
    """Every shard once per epoch, each time in its own seeded order (``rn``, from 0).

    With ``largest_shard`` (known from the totals) no job runs to count the rows of shards that fit a slice.
    """
    repeated = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    digest = shuffle_key(seed, F.col("epoch"), F.col("position"))
    return number_rows(
        repeated.withColumn("__digest", digest),
        ["epoch", *SHARD],
        ["__digest", "position"],
        "rn",
        rows_per_slice,
        largest_shard,
    ).drop("__digest")


def stored_order(df: DataFrame, shard_start: Column) -> DataFrame:
    """Validation order: the shard as stored, so the row number needs no shuffle."""
    return df.withColumns({"epoch": F.lit(0), "rn": F.col("position") - shard_start})


def with_batches(df: DataFrame, batch_size: int) -> DataFrame:
    """Cut each shard's order into batches; the last one may be partial."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    return df.withColumns(
        {
            "batch_id": F.floor(F.col("rn") / batch_size),
            "row_in_batch": F.pmod(F.col("rn"), F.lit(batch_size)).cast("int"),
        }
    )


def assemble_batches(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per batch with its rows' columns as nested arrays, in batch order."""
    rows = F.array_sort(F.collect_list(F.struct("row_in_batch", *columns)))
    grouped = df.groupBy("epoch", *SHARD, "batch_id").agg(rows.alias("__rows"))
    return grouped.select(
        "epoch", *SHARD, "batch_id", *[F.col(f"__rows.{c}").alias(c) for c in columns]
    )


def token_count(mask: Column) -> Column:
    """Real tokens of one example: the sum of its attention mask."""
    return F.aggregate(mask, F.lit(0).cast("bigint"), lambda total, bit: total + bit)


def batch_tokens(df: DataFrame, tokens: str = "n_tokens") -> DataFrame:
    """Real tokens per batch, from a per-example count taken before rows were shuffled."""
    return df.groupBy("epoch", *SHARD, "batch_id").agg(
        F.sum(tokens).alias("tokens"),
        F.count(F.lit(1)).alias("examples"),
    )
