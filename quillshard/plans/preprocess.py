"""The preprocess job: read, limit, split, format, encode, shard, write."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillshard.functions.encoders import Encoder
from quillshard.functions.examples import encode_rows, to_examples
from quillshard.functions.formatting import Formatter
from quillshard.operators.limits import first_rows
from quillshard.operators.shards import assign_shards
from quillshard.operators.splits import TRAIN, VALIDATION, makes_split, ordered_split, ratio_split
from quillshard.plans.config import PreprocessConfig
from quillshard.sources.datasets import read_examples, spread_small_input
from quillshard.sources.shards import write_shards
from quillshard.sources.snapshots import write_snapshot

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class PlacedRows:
    """Encoded rows with ``split``, ``shard_id`` and ``position``, and the rows per split."""

    df: DataFrame
    totals: dict[str, int]
    num_shards: dict[str, int]


def place_rows(raw: DataFrame, cfg: PreprocessConfig, formatter: Formatter, encoder: Encoder, raw_val: DataFrame | None = None) -> PlacedRows:
    """Limit, split, encode and shard raw rows.

    Encoding runs where a row is read; the one shuffle that follows moves keys and compact payloads.
    """
    keys = list(cfg.key)

    def encoded(df: DataFrame) -> DataFrame:
        return encode_rows(df, formatter, encoder, cfg.max_length).select(*keys, "payload", "prompt_len")

    train = first_rows(raw, cfg.train_max_examples, keys)
    if raw_val is not None:
        val = first_rows(raw_val, cfg.val_max_examples, keys)
        placed, totals = ordered_split(encoded(train), TRAIN, keys, cfg.rows_per_part)
        if cfg.num_val_shards > 0:
            placed_val, val_totals = ordered_split(encoded(val), VALIDATION, keys, cfg.rows_per_part)
            placed, totals = placed.unionByName(placed_val), {**totals, **val_totals}
    elif makes_split(cfg.val_split_ratio):
        unwritten = cfg.num_val_shards == 0
        placed, totals = ratio_split(encoded(train), cfg.val_split_ratio, keys, cfg.seed, cfg.rows_per_part, unwritten)
        if cfg.num_val_shards == 0:
            log.warning("%s validation rows are split off but written nowhere: num_val_shards is 0", totals[VALIDATION])
    else:
        placed, totals = ordered_split(encoded(train), TRAIN, keys, cfg.rows_per_part)
    num_shards = {TRAIN: cfg.num_train_shards, VALIDATION: cfg.num_val_shards}
    num_shards = {split: num_shards[split] for split in totals}
    return PlacedRows(assign_shards(placed, totals, num_shards), totals, num_shards)


def read_rows(spark: SparkSession, cfg: PreprocessConfig, subset: str | None) -> DataFrame:
    """The raw rows of one subset, as the configuration says to read them."""
    options = dict(cfg.options or {})
    return read_examples(spark, cfg.path, cfg.fmt, cfg.split, subset, cfg.schema, cfg.split_column, cfg.subset_column, options)


def read_and_place(spark: SparkSession, cfg: PreprocessConfig, formatter: Formatter, encoder: Encoder) -> PlacedRows:
    read = lambda subset: spread_small_input(read_rows(spark, cfg, subset))
    raw_val = None if cfg.val_subset is None else read(cfg.val_subset)
    return place_rows(read(cfg.subset), cfg, formatter, encoder, raw_val)


def tokenized_examples(
    raw: DataFrame, cfg: PreprocessConfig, formatter: Formatter, encoder: Encoder, raw_val: DataFrame | None = None
) -> DataFrame:
    """The examples the job would store, with their key, split, shard and position, as a lazy table."""
    placed = place_rows(raw, cfg, formatter, encoder, raw_val)
    keep = (*cfg.key, "split", "shard_id", "position")
    return to_examples(placed.df, encoder, cfg.max_length, keep, cfg.mask_padding)


def preprocess(spark: SparkSession, cfg: PreprocessConfig, formatter: Formatter, encoder: Encoder) -> DataFrame:
    """Run the job and return the manifest of the stored shards."""
    if cfg.output_dir is None:
        raise ValueError("output_dir is not set")
    return store(read_and_place(spark, cfg, formatter, encoder), cfg, encoder)


def store(placed: PlacedRows, cfg: PreprocessConfig, encoder: Encoder) -> DataFrame:
    """Write the shards, in place or as a new version, and return their manifest."""
    what = (placed.df, cfg.output_dir, encoder, cfg.max_length, placed.totals, placed.num_shards)
    how = {"keep_position": cfg.keep_position, "keep_stale": cfg.keep_stale, "mask_padding": cfg.mask_padding}
    return write_snapshot(*what, **how).manifest().drop("folder") if cfg.snapshots else write_shards(*what, **how)
