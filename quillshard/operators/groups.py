"""Ordered work inside groups, safe when one group holds most of the rows.

Groups of at most ``rows_per_slice`` rows take the plain window. A larger group is cut into slices of
its own order; each slice is one window group, and what a slice needs from its neighbours (a running
count, a last value, a next row) comes from a table with one row per slice. Every group above the slice size is
cut. The table of hot groups is collected and broadcast only if it was found to be small, in rows and bytes;
a larger one stays a table and is joined by Spark, which splits the partition of a hot key. Rows of one group
need distinct order keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillshard.operators.buckets import range_bucket

ROWS_PER_SLICE = 1_000_000
# More hot groups than this, or more bytes of their keys, are neither collected nor broadcast.
MAX_HOT_GROUPS = 100_000
MAX_HOT_BYTES = 32 << 20
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


class Slices:
    """A table with a ``__slice`` column: 0 for ordinary groups, 1.. along the order of a hot one.

    Slices are ranges of (group, order), so a hot group gets as many as its size asks for, and the
    slices of all hot groups together number at most the range buckets plus one per hot group.
    """

    def __init__(
        self,
        df: DataFrame,
        group_by: list[str],
        order_by: list[str],
        rows_per_slice: int = ROWS_PER_SLICE,
        largest: int | None = None,
    ) -> None:
        """``largest`` is the size of the largest group where the caller knows it; it spares the count."""
        self.group_by = group_by
        self.order_by = order_by
        if largest is not None and largest <= rows_per_slice:
            self.hot = False
            self.df = df.withColumn("__slice", F.lit(0))
            return
        sizes = df.groupBy(*group_by).agg(F.count(F.lit(1)).alias("__size"))
        large = sizes.where(F.col("__size") > rows_per_slice)
        width = sum((F.coalesce(F.octet_length(F.col(g).cast("string")), F.lit(0)) for g in group_by), F.lit(0))
        found = large.agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("rows"), F.sum(width).alias("bytes")).first()
        self.hot = found["n"] > 0
        if not self.hot:
            self.df = df.withColumn("__slice", F.lit(0))
            return
        n_hot = found["rows"]
        n_slices = max(2, -(-n_hot // rows_per_slice))
        flags = large.select(*group_by, F.lit(True).alias("__hot"))
        small = found["n"] <= MAX_HOT_GROUPS and found["bytes"] <= MAX_HOT_BYTES
        if small:
            # a table of its own, so that the groups are not counted again
            flags = df.sparkSession.createDataFrame(flags.toArrow()) if _plain(flags) else flags
        # by broadcast where it can be, since a shuffle on a hot key would bring it to one task first
        marked = join_on(df, flags, group_by, bounded=small)
        keys = [*group_by, *order_by]
        bucket = range_bucket(marked.where("__hot").select(*keys), keys, n_hot, n_slices)
        self.df = marked.withColumn("__slice", F.when(F.col("__hot"), bucket + 1).otherwise(0)).drop("__hot")

    @property
    def keys(self) -> list[str]:
        return [*self.group_by, "__slice"]

    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order_by)

    def summary(self, *aggregates: Column) -> DataFrame:
        """One row per slice of the hot groups."""
        return self.df.where(F.col("__slice") > 0).groupBy(*self.keys).agg(*aggregates)

    def across(self):
        """The window over the slices of one group, in order."""
        return Window.partitionBy(*self.group_by).orderBy("__slice")

    def attach(self, df: DataFrame, summary: DataFrame, carried: list[str]) -> DataFrame:
        """Join a per-slice table. Its rows are bounded; its bytes are too if keys and values have no text or arrays.

        Otherwise Spark picks the join by measured size: slices are small, so a shuffle is safe as well.
        """
        bounded = all(isinstance(summary.schema[c].dataType, _FIXED_WIDTH) for c in [*self.group_by, *carried])
        return join_on(df, summary, self.keys, bounded)


def _plain(df: DataFrame) -> bool:
    """Whether Arrow brings a table to the driver and back with the same types and values."""
    kept = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType)
    return all(isinstance(f.dataType, kept) for f in df.schema)


def join_on(df: DataFrame, other: DataFrame, keys: list[str], bounded: bool) -> DataFrame:
    """Left join on keys that may be null, by broadcast if the other side is bounded."""
    renamed = other.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    joined = df.join(F.broadcast(renamed) if bounded else renamed, on, "left")
    return joined.drop(*[f"__r_{k}" for k in keys])


def number_rows(
    df: DataFrame,
    group_by: list[str],
    order_by: list[str],
    into: str,
    rows_per_slice: int = ROWS_PER_SLICE,
    largest: int | None = None,
) -> DataFrame:
    """0-based row number inside each group; ``largest`` bounds the group sizes where they are known."""
    slices = Slices(df, group_by, order_by, rows_per_slice, largest)
    numbered = slices.df.withColumn(into, (F.row_number().over(slices.window()) - 1).cast("bigint"))
    if slices.hot:
        before = F.sum("__n").over(slices.across().rowsBetween(Window.unboundedPreceding, -1))
        offsets = slices.summary(F.count(F.lit(1)).alias("__n")).withColumn("__before", before).drop("__n")
        numbered = slices.attach(numbered, offsets, ["__before"]).withColumn(
            into, F.col(into) + F.coalesce("__before", F.lit(0))
        ).drop("__before")
    return numbered.drop("__slice")


def fill_forward(
    df: DataFrame,
    group_by: list[str],
    order_by: list[str],
    columns: dict[str, str],
    initial: float | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """For each ``source -> target`` pair: the last non-null value so far in the group's order."""
    slices = Slices(df, group_by, order_by, rows_per_slice)
    so_far = slices.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = slices.df.withColumns({t: F.last(s, ignorenulls=True).over(so_far) for s, t in columns.items()})
    if slices.hot:
        order = F.struct(*order_by)
        last = slices.summary(
            *[F.max_by(s, F.when(F.col(s).isNotNull(), order)).alias(f"__last_{t}") for s, t in columns.items()]
        )
        earlier = slices.across().rowsBetween(Window.unboundedPreceding, -1)
        carried = last.select(
            *slices.keys,
            *[F.last(f"__last_{t}", ignorenulls=True).over(earlier).alias(f"__carry_{t}") for t in columns.values()],
        )
        filled = slices.attach(filled, carried, [f"__carry_{t}" for t in columns.values()])
        filled = filled.withColumns({t: F.coalesce(t, f"__carry_{t}") for t in columns.values()})
        filled = filled.drop(*[f"__carry_{t}" for t in columns.values()])
    if initial is not None:
        filled = filled.withColumns({t: F.coalesce(t, F.lit(initial)) for t in columns.values()})
    return filled.drop("__slice")


def next_row(
    df: DataFrame,
    group_by: list[str],
    order_by: list[str],
    columns: dict[str, str],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """For each ``source -> target`` pair: the value in the next row of the group, null on the last."""
    slices = Slices(df, group_by, order_by, rows_per_slice)
    window = slices.window()
    out = slices.df.withColumns({t: F.lead(s).over(window) for s, t in columns.items()})
    if slices.hot:
        order = F.struct(*order_by)
        first = slices.summary(
            F.min_by(F.struct(*columns), order).alias("__first")
        ).withColumn("__next", F.lead("__first").over(slices.across())).drop("__first")
        out = out.withColumn("__is_last", F.lead(F.lit(1)).over(window).isNull())
        out = slices.attach(out, first, ["__next"])
        crossing = F.col("__is_last") & (F.col("__slice") > 0)
        out = out.withColumns(
            {t: F.when(crossing, F.col(f"__next.{s}")).otherwise(F.col(t)) for s, t in columns.items()}
        ).drop("__is_last", "__next")
    return out.drop("__slice")
