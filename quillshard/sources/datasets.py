"""Reading raw example tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillshard.operators.limits import first_rows

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read_examples(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    split: str | None = None,
    subset: str | None = None,
    schema: StructType | str | None = None,
    split_column: str = "split",
    subset_column: str = "subset",
    options: dict[str, str] | None = None,
    limit: int | None = None,
    key: Sequence[str] = (),
) -> DataFrame:
    """A named dataset, narrowed to a split and a subset.

    Laid out as ``path/subset=.../split=.../`` both are partition columns and the filters prune
    folders; as ordinary columns the filters are pushed into the scan. A table without the split
    column is a single split. A subset that is asked for must exist as a column. ``limit`` keeps the
    first rows in the order of the unique ``key``, all of them if there are fewer.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format '{fmt}' is not one of {FORMATS}")
    reader = spark.read.format(fmt).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    try:
        df = reader.load(path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from err
        raise
    if subset is not None:
        if subset_column not in df.columns:
            raise ValueError(f"subset '{subset}' was asked for, but {path} has no column '{subset_column}'")
        df = df.where(F.col(subset_column) == subset)
    if split is not None and split_column in df.columns:
        df = df.where(F.col(split_column) == split)
    if limit is not None and not key:
        raise ValueError("a limit needs the key that defines the order of the rows")
    return first_rows(df, limit, list(key))


# Below this many input bytes for each core an input counts as small.
SMALL_BYTES_PER_CORE = 8 << 20


def spread_small_input(df: DataFrame) -> DataFrame:
    """Give every core a share of a small input that has fewer splits than there are cores.

    A small data set is often one file with one row group, which one task would format and encode alone. What is
    small goes by the bytes of the scan: an input of more than ``SMALL_BYTES_PER_CORE`` for each core is never moved,
    however its files can be split. ``df`` must be a plain scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = size < SMALL_BYTES_PER_CORE * cores
    return df.repartition(cores) if small and df.rdd.getNumPartitions() < cores else df
