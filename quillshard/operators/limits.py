"""First-N rows of an order, as a filter on the order key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillshard.operators.buckets import MAX_BUCKETS, count_keys, range_bucket

# Key rows one task may hold while it looks for the N-th key.
TOP_KEYS = 100_000


def first_rows(df: DataFrame, limit: int | None, keys: list[str], top_keys: int = TOP_KEYS) -> DataFrame:
    """The first ``limit`` rows in the order of unique, non-null keys; all rows if there are fewer.

    Only key columns are read to find the N-th key. The rows themselves are then chosen by a plain
    comparison with it, which reaches the scan and moves no row.
    """
    if limit is None:
        return df
    if limit < 0:
        raise ValueError("limit must not be negative")
    if limit == 0:
        return df.where(F.lit(False))
    slim = df.select(*keys)
    total = count_keys(slim, keys)
    if limit >= total:
        return df
    last = _nth_key(slim, limit, keys, total, top_keys)
    bounds = {k: _literal(last[k], slim.schema[k].dataType) for k in keys}
    return df.where(at_or_before(bounds))


def at_or_before(bounds: dict[str, Column]) -> Column:
    """Lexicographic ``keys <= bounds``, led by a bound on the first key that a scan can use."""
    keys = list(bounds)

    def tail(rest: list[str]) -> Column:
        name, value = rest[0], bounds[rest[0]]
        if len(rest) == 1:
            return F.col(name) <= value
        return (F.col(name) < value) | ((F.col(name) == value) & tail(rest[1:]))

    lead = F.col(keys[0]) <= bounds[keys[0]]
    return lead if len(keys) == 1 else lead & tail(keys)


def _carried(name: str, dtype: T.DataType) -> Column:
    """A key value in a form that passes through Python unchanged, whatever the time zones are."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(name)
    return F.hex(name) if isinstance(dtype, T.BinaryType) else F.col(name).cast("string")


def _literal(value: str | int, dtype: T.DataType) -> Column:
    """The key value again, in the type of its column."""
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(F.lit(value).cast("bigint"))
    return F.unhex(F.lit(value)) if isinstance(dtype, T.BinaryType) else F.lit(value).cast(dtype)


def _nth_key(slim: DataFrame, rank: int, keys: list[str], total: int, top_keys: int) -> Row:
    """The key of rank ``rank``, narrowing to one bucket until few enough rows precede it there."""
    while min(rank, total) > top_keys:
        bucket = range_bucket(slim, keys, total, min(MAX_BUCKETS, 4 * (total // top_keys + 1)))
        counts = sorted(slim.groupBy(bucket.alias("b")).count().collect())
        if len(counts) == 1:
            raise ValueError(f"the order key {keys} is not unique")
        for row in counts:
            if rank <= row["count"]:
                slim, total = slim.where(bucket == row["b"]), row["count"]
                break
            rank -= row["count"]
    order = [F.col(k) for k in keys]
    first = slim.orderBy(*order).limit(rank)
    nth = first.agg(F.max(F.struct(*order)).alias("k")).select("k.*")
    return nth.select(*[_carried(k, nth.schema[k].dataType).alias(k) for k in keys]).first()
