"""Train / validation splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillshard.operators.positions import ROWS_PER_PART, range_layout, shuffled_layout, with_position

TRAIN, VALIDATION = "train", "val"


def makes_split(ratio: float | None) -> bool:
    return ratio is not None and 0 < ratio < 1


def validation_size(ratio: float, total: int) -> int:
    """Validation rows of a ratio split, rounded up in binary floating point."""
    return math.ceil(ratio * total)


def ordered_split(df: DataFrame, split: str, keys: list[str], rows_per_part: int = ROWS_PER_PART) -> tuple[DataFrame, dict[str, int]]:
    """All rows in one split, positioned in key order."""
    layout = range_layout(df, keys, rows_per_part)
    return with_position(df, layout).withColumn("split", F.lit(split)), {split: layout.total}


def ratio_split(
    df: DataFrame,
    ratio: float,
    keys: list[str],
    seed: int,
    rows_per_part: int = ROWS_PER_PART,
    train_only: bool = False,
) -> tuple[DataFrame, dict[str, int]]:
    """A seeded random split: the front of the permutation is validation, the rest train.

    Both splits come from one shuffle; positions count from 0 inside each. With ``train_only`` validation rows are
    counted but left out before that shuffle, save those that share a bucket with train rows.
    """
    layout = shuffled_layout(df, keys, seed, rows_per_part)
    n_val = validation_size(ratio, layout.total)
    placed = with_position(df, layout.between(n_val, layout.total) if train_only else layout)
    if train_only:
        placed = placed.where(F.col("position") >= n_val)
    in_val = F.col("position") < n_val
    split = placed.withColumns(
        {
            "split": F.when(in_val, F.lit(VALIDATION)).otherwise(F.lit(TRAIN)),
            "position": F.when(in_val, F.col("position")).otherwise(F.col("position") - n_val),
        }
    )
    return split, {TRAIN: layout.total - n_val, VALIDATION: n_val}
