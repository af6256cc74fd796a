"""Monotone buckets over an order, so that ordered work spreads over tasks.

A bucket only has to respect the order; where exactly its boundaries fall changes the balance of the
tasks, never a result. Range boundaries therefore come from a sample of the distinct keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upper bound of boundaries kept in a plan and of rows in a bucket table that is collected or broadcast.
MAX_BUCKETS = 1 << 16
SAMPLES_PER_BUCKET = 8
HASH_DIGITS = 4


def any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def count_keys(df: DataFrame, keys: list[str]) -> int:
    """Rows of a table whose order keys are all given; a null key has no defined place."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(any_null(keys)).alias("nulls")).first()
    reject_nulls(row["nulls"], keys)
    return row["n"]


def reject_nulls(nulls: int, keys: list[str]) -> None:
    if nulls:
        raise ValueError(f"{nulls} rows have a null in the order key {keys}")


def key_text(df: DataFrame, name: str) -> Column:
    """A key column as text that does not depend on the session's time zone."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(name).cast("string")
    return F.col(name).cast("string")


def shuffle_key(seed: int | str, *keys: Column) -> Column:
    """A reproducible pseudo-random sort key: the md5 digest of seed and key (see ``key_text`` for timestamps)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def digest_bucket(digest: Column) -> Column:
    """Buckets of an md5 digest by its leading hex digits; uniform by construction."""
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("int")


def range_bucket(df: DataFrame, keys: list[str], n_rows: int, n_buckets: int) -> Column:
    """Buckets of an ordered key by boundaries near its quantiles.

    One job reads the key columns, keeps a hash-selected sample of the distinct keys (at most about
    ``SAMPLES_PER_BUCKET`` per bucket) and returns the boundaries. The column finds its bucket by a
    binary search over that constant array inside the JVM.
    """
    n_buckets = min(n_buckets, MAX_BUCKETS)
    if n_buckets <= 1:
        return F.lit(0)
    one_in = max(1, n_rows // (SAMPLES_PER_BUCKET * n_buckets))
    key = _key(keys)
    boundaries = (
        df.where(F.pmod(F.xxhash64(*keys), F.lit(one_in)) == 0)
        .agg(F.array_sort(F.collect_set(key)).alias("s"))
        .select(
            F.to_json(
                F.transform(
                    F.sequence(F.lit(1), F.lit(n_buckets - 1)),
                    lambda i: F.get("s", F.floor(i.cast("bigint") * F.size("s") / n_buckets).cast("int")),
                )
            ).alias("json")
        )
        .first()["json"]
    )
    key_type = df.select(key.alias("k")).schema["k"].dataType
    bounds = F.from_json(F.lit(boundaries), T.ArrayType(key_type))
    jumps = [1 << bit for bit in reversed(range(n_buckets.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(j) for j in jumps]),
        F.lit(0),
        lambda at, jump: F.when(F.get(bounds, at + jump - 1) <= key, at + jump).otherwise(at),
    )


def _key(keys: list[str]) -> Column:
    return F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
