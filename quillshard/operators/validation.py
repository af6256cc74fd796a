"""A caller's validation step over assembled batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillshard.operators.telemetry import validation_means

Hook = Callable[[pa.Table, int], Mapping[str, float] | None]


def batch_metrics(rows: DataFrame, hook: Hook, group_by: list[str], batch: str = "batch_id", order: str = "row_in_batch") -> DataFrame:
    """``group_by``, the batch and its ``metrics``: what ``hook(table, batch)`` returned for the batch's rows.

    ``rows`` carry the batch they belong to (``with_batches``), and a task holds one batch at a time, in its stored order. The table has all
    other columns. An empty map, or none, is a batch without metrics.
    """
    keys = [*group_by, batch]
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()))])
    where = len(group_by)

    def step(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ordered = table.sort_by(order).drop_columns([*keys, order])
        metrics = hook(ordered, key[where].as_py()) or {}
        own = pa.array([[(name, float(value)) for name, value in metrics.items()]], pa.map_(pa.string(), pa.float64()))
        return pa.table([*(pa.array([k.as_py()], k.type) for k in key), own], names=[*keys, "metrics"])

    return rows.groupBy(*keys).applyInArrow(step, schema)


def validate(rows: DataFrame, hook: Hook, group_by: list[str], batch: str = "batch_id", order: str = "row_in_batch") -> DataFrame:
    """The means of a validation step's metrics, over the batches for which it gave any."""
    return validation_means(batch_metrics(rows, hook, group_by, batch, order), group_by)
