"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshard.session import scratch_dir

# A word is a run of characters other than space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
# Rows of one Arrow batch that carries whole texts: bounds what a Python worker holds at once.
TEXT_ROWS = 256
# A side of a join is broadcast only if its counted rows, of fixed width, stay below this.
BROADCAST_ROWS = 500_000
# Equal rows are expanded in runs of this many, so that no array grows with their number.
RUN_ROWS = 4096
# The columns the pipeline's stages read or write; all others only pass through.
STAGE_COLUMNS = ("doc_id", "text", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; a smaller setting of the session stands."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: cuts the lineage, survives executors."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """A side with short rows: broadcast if the counted rows are few, else left to Spark's own choice."""
    return F.broadcast(df) if rows <= most else df


def numbered(df: DataFrame, into: str) -> DataFrame:
    """Tell equal rows apart by a number from 0, without bringing them together: they are counted, then expanded."""
    m = f"{into}_m"
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(m))
    runs = counted.withColumn(into, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(m) - 1, F.lit(RUN_ROWS).cast("bigint"))))
    end = F.least(F.col(into) + RUN_ROWS, F.col(m)) - 1
    return runs.withColumn(into, F.explode(F.sequence(F.col(into), end))).drop(m)


def with_extras_aside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stage with the columns it does not know under neutral names, so that none can clash with its own."""
    names = [c if c.lower() in STAGE_COLUMNS else f"extra_{i}" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*names)).toDF(*docs.columns)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times, inside nested lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's identity; rows that are equal in these columns share it."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
