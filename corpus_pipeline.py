"""The corpus pipeline: quality rules, near-dedup, substring dedup, source mixing, packing.

``STAGES`` are applied in order; each works on all rows that its predecessor kept, and what it decides takes
effect: rejected documents and lines are gone, one document of each near-duplicate group is left, repeated
passages are cut from all but one place, documents are taken as often as the mix wants them, and the last
stage places every document that is left in training sequences. Nulls, empty tables, repeated rows and further
columns are handled as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillshard.llm.common import staged, table
from quillshard.llm.mixing import mix
from quillshard.llm.near_dedup import keep_one_of_each
from quillshard.llm.packing import pack
from quillshard.llm.quality_rules import keep_clean
from quillshard.llm.substring_dedup import drop_repeats
from quillshard.session import ship_packages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules, with the text that is left."""
    return keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest id."""
    ship_packages(spark)
    return keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds."""
    ship_packages(spark)
    return drop_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    ship_packages(spark)
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences; equal texts are a cluster."""
    ship_packages(spark)
    return pack(docs).drop("tie")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

# Greedy packing and random rounding have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
