"""Writing shards with a manifest, and finding and loading them by rank."""

from __future__ import annotations

import logging
import string
from collections.abc import Mapping

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillshard.functions.encoders import Encoder
from quillshard.functions.examples import EXAMPLE_SCHEMA, to_examples
from quillshard.operators.shards import shard_bounds

log = logging.getLogger(__name__)

# Folders of this module below an output folder; whatever else lies there is left alone.
EXAMPLES, MANIFEST = "examples", "manifest"
# The name stem of a stored shard, by split.
SHARD_PREFIX = {"train": "shard", "val": "val_shard"}

MANIFEST_SCHEMA = "split string, shard_id int, shard_name string, num_rows bigint"


def write_shards(
    df: DataFrame,
    root: str,
    encoder: Encoder,
    max_length: int,
    totals: Mapping[str, int],
    num_shards: Mapping[str, int],
    keep_position: bool = False,
    keep_stale: bool = False,
    mask_padding: bool = False,
) -> DataFrame:
    """Write payload rows as shards, ``root/examples/split=.../shard_id=.../``, and return the manifest.

    Rows arrive in contiguous runs of positions, one run per task, so no further shuffle is needed:
    each file is a sorted run, and a large shard is simply several files. Ids are expanded, padded and
    labelled after the sort, which therefore only moves compact payloads. The manifest is emptied first
    and written last, so it only ever names complete shards. Shards of an earlier run are removed unless
    ``keep_stale``.
    """
    spark = df.sparkSession
    order = ["split", "shard_id", "position"]
    placed = df.select(*order, "payload", "prompt_len").sortWithinPartitions(*order)
    keep = ("split", "shard_id", "position") if keep_position else ("split", "shard_id")
    earlier = _manifest_rows(spark, root)
    if keep_stale:
        # an overwrite by partition does not touch the folder of a planned shard that gets no rows
        _clear_empty_shards(spark, root, totals, num_shards)
    if earlier:
        _write_manifest(spark, earlier[0].head(0), root)
    (
        to_examples(placed, encoder, max_length, keep, mask_padding)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if keep_stale else "static")
        .partitionBy("split", "shard_id")
        .parquet(f"{root}/{EXAMPLES}")
    )
    manifest = _counted_manifest(spark, root, totals, num_shards)
    rows = manifest.toPandas()
    _check_sizes(rows, totals, num_shards)
    if keep_stale:
        rows = pd.concat([rows, *earlier]).drop_duplicates(["split", "shard_id"])
    _write_manifest(spark, rows, root)
    return read_manifest(spark, root)


def shard_manifest(df: DataFrame, num_shards: Mapping[str, int]) -> DataFrame:
    """Rows per shard of a table with ``split`` and ``shard_id``; shards without rows count 0."""
    counts = df.groupBy("split", "shard_id").agg(F.count(F.lit(1)).alias("num_rows"))
    slots = _slots(df.sparkSession, num_shards)
    return slots.join(counts, ["split", "shard_id"], "left").select(
        "split", "shard_id", "shard_name", F.coalesce("num_rows", F.lit(0)).cast("bigint").alias("num_rows")
    )


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST_SCHEMA).json(f"{root}/{MANIFEST}")
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no complete shards in {root}") from err
        raise


def resolve_shard_name(template: str, rank: int, world_size: int, purpose: str = "train") -> str:
    """Fill ``{id}``, ``{rank}`` and ``{world_size}`` of a shard name template."""
    try:
        return template.format(id=rank, rank=rank, world_size=world_size)
    except KeyError as err:
        raise ValueError(f"the {purpose} shard template knows only id, rank and world_size, not {err}") from err


def names_a_rank(template: str) -> bool:
    """Whether a template tells ranks apart: its text has a placeholder that starts with rank or id."""
    return any(mark in template for mark in ("{rank", "{id"))


def resolve_shards(manifest: DataFrame, template: str, world_size: int) -> DataFrame:
    """The shard each rank would load, with ``found`` false where the manifest has none of that name."""
    spark = manifest.sparkSession
    ranks = spark.range(world_size).select(
        F.col("id").cast("int").alias("rank"), _name_column(template, world_size).alias("shard_name")
    )
    known = manifest.select("shard_name", "split", "shard_id", "num_rows")
    return ranks.join(known, "shard_name", "left").withColumn("found", F.col("split").isNotNull())


def visible_validation_shards(manifest: DataFrame, template: str | None, world_size: int) -> DataFrame:
    """The validation shard each rank sees: none without a template, and only rank 0 sees a shared one."""
    if not template:
        nothing = F.lit(None).cast("string")
        return manifest.sparkSession.range(world_size).select(
            F.col("id").cast("int").alias("rank"), nothing.alias("shard_name"),
            F.lit(None).cast("bigint").alias("num_rows"),
        )
    shards = resolve_shards(manifest, template, world_size)
    sees = F.lit(True) if names_a_rank(template) else F.col("rank") == 0
    return shards.select(
        "rank", F.when(sees, F.col("shard_name")).alias("shard_name"), F.when(sees, F.col("num_rows")).alias("num_rows")
    )


def load_shard(spark: SparkSession, root: str, shard_name: str, keep_position: bool = False) -> DataFrame:
    """The examples of one stored shard. Only that shard's folder is listed and read."""
    row = read_manifest(spark, root).where(F.col("shard_name") == shard_name).first()
    if row is None:
        raise FileNotFoundError(f"shard '{shard_name}' not found in {root}")
    schema = T.StructType(EXAMPLE_SCHEMA.fields)
    if keep_position:
        schema = T.StructType([T.StructField("position", T.LongType()), *EXAMPLE_SCHEMA.fields])
    if row["num_rows"] == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{EXAMPLES}/split={row['split']}/shard_id={row['shard_id']}")


def load_shard_for_rank(
    spark: SparkSession, root: str, template: str, rank: int, world_size: int, purpose: str = "train"
) -> DataFrame:
    """The shard a rank trains or validates on."""
    if world_size > 1 and not names_a_rank(template):
        log.warning("%s shard template '%s' names no rank, so all %s ranks read the same shard", purpose, template, world_size)
    return load_shard(spark, root, resolve_shard_name(template, rank, world_size, purpose))


def read_all_shards(spark: SparkSession, root: str, keep_position: bool = False) -> DataFrame:
    """Every stored example with its ``split`` and ``shard_id``; filters on those prune folders."""
    fields = [*EXAMPLE_SCHEMA.fields, T.StructField("split", T.StringType()), T.StructField("shard_id", T.IntegerType())]
    if keep_position:
        fields.insert(0, T.StructField("position", T.LongType()))
    return spark.read.schema(T.StructType(fields)).parquet(f"{root}/{EXAMPLES}")


def _write_manifest(spark: SparkSession, rows: pd.DataFrame, root: str) -> None:
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{root}/{MANIFEST}")


def _slots(spark: SparkSession, num_shards: Mapping[str, int]) -> DataFrame:
    slots = None
    for split, count in num_shards.items():
        ids = spark.range(count).select(F.lit(split).alias("split"), F.col("id").cast("int").alias("shard_id"))
        named = ids.withColumn("shard_name", F.concat(F.lit(f"{SHARD_PREFIX[split]}_"), F.col("shard_id").cast("string")))
        slots = named if slots is None else slots.unionByName(named)
    return slots


def _counted_manifest(
    spark: SparkSession, root: str, totals: Mapping[str, int], num_shards: Mapping[str, int]
) -> DataFrame:
    stored = {split: num_shards.get(split, 0) for split in totals}
    # no data column is read: the counts come from file footers
    return shard_manifest(read_all_shards(spark, root).select("split", "shard_id"), stored)


def _check_sizes(rows: pd.DataFrame, totals: Mapping[str, int], num_shards: Mapping[str, int]) -> None:
    for split, shard_id, name, num_rows in rows.itertuples(index=False):
        start, end = shard_bounds(totals[split], num_shards[split], shard_id)
        if num_rows != end - start:
            raise RuntimeError(f"{name} holds {num_rows} rows, not {end - start}; the input changed during the run")


def _clear_empty_shards(spark: SparkSession, root: str, totals: Mapping[str, int], num_shards: Mapping[str, int]) -> None:
    """Remove what an earlier run stored under planned shards that are empty now."""
    for split, total in totals.items():
        for shard_id in range(num_shards.get(split, 0)):
            start, end = shard_bounds(total, num_shards[split], shard_id)
            if start == end:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{EXAMPLES}/split={split}/shard_id={shard_id}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _manifest_rows(spark: SparkSession, root: str) -> list[pd.DataFrame]:
    try:
        return [read_manifest(spark, root).toPandas()]
    except FileNotFoundError:
        return []


def _name_column(template: str, world_size: int):
    """A shard name template over the rank column. Widths such as ``{rank:05d}`` are kept."""
    pieces = [F.lit("")]
    for literal, name, spec, conversion in string.Formatter().parse(template):
        pieces.append(F.lit(literal))
        if name is None:
            continue
        if name not in ("id", "rank", "world_size"):
            raise ValueError(f"a shard template knows only id, rank and world_size, not '{name}'")
        value = F.lit(world_size) if name == "world_size" else F.col("id")
        digits = spec.removesuffix("d")
        if conversion or not (digits == "" or (digits[0] == "0" and digits.isdigit())):
            raise ValueError(f"'{{{name}:{spec}}}' is not a plain or zero-padded number")
        width = int(digits or 0)
        pieces.append(F.format_string(f"%0{width}d", value) if width else value.cast("string"))
    return F.concat(*pieces)
