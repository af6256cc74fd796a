"""The step plan of a training run, from the shard manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def step_plan(manifest: DataFrame, batch_size: int, epochs: int, warmup_ratio: float) -> DataFrame:
    """Steps and warm-up steps per training shard. A step limit cuts a run short but not this plan.

    ``has_schedule`` is false for a shard without steps.
    """
    per_epoch = F.ceil(F.col("num_rows") / batch_size)
    planned = manifest.where(F.col("split") == "train").withColumn("batches_per_epoch", per_epoch)
    total = F.col("batches_per_epoch") * epochs
    return planned.select(
        "shard_id",
        "num_rows",
        "batches_per_epoch",
        total.alias("total_steps"),
        F.floor(F.lit(float(warmup_ratio)) * total).alias("warmup_steps"),
        (total > 0).alias("has_schedule"),
    )
