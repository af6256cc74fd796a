"""Epoch order without a sort: a keyed permutation of ``0 .. n - 1`` as column expressions, and its inverse.

Where a row stands in an epoch is computed from its position alone, so nothing is shuffled or sorted, and a batch of any epoch is a
computed set of positions that can be read by themselves.

The permutation is a Feistel network over pairs: a position ``x`` is ``(x // width, x % width)`` on a grid of ``height`` by ``width``
places, and in each round one half is shifted by a keyed function of the other, modulo its own size, so the grid need not be a
square or a power of two. It has at least ``n`` places. A position that leaves ``0 .. n - 1`` walks on through the network until it
is back (cycle walking). The sides are chosen so that only a few places are beyond ``n``; where each of those comes back is worked out
beforehand, so the walk is one lookup and the expression has no loop.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache
from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
# The keyed function is arithmetic modulo this prime, whose products fit a long.
PRIME = 2**31 - 1
MULTIPLIER = 1_103_515_245
# How many widths are tried for a grid with few places beyond n; a table of n rows needs at most isqrt(n) of them.
_TRIED = 1 << 16
LARGEST = 1 << 48


def round_key(seed: int, epoch: int, turn: int) -> int:
    return int(hashlib.md5(f"{seed}|{epoch}|{turn}".encode()).hexdigest()[:7], 16)


@cache
def grid(n: int) -> tuple[int, int]:
    """``(height, width)`` of a grid of at least ``n`` places, near a square, with as few beyond ``n`` as a short search finds."""
    root = isqrt(max(n - 1, 0)) + 1
    widths = np.arange(root, root + min(_TRIED, root), dtype=np.int64)
    heights = -(-n // widths)
    at = int(np.argmin(heights * widths - n))
    return int(heights[at]), int(widths[at])


def _mixed(half, key, size):
    """The keyed function; the same arithmetic on Python integers and on columns."""
    y = (half % PRIME * MULTIPLIER + key) % PRIME
    return (y * y + key) % PRIME * (1 << 28) // PRIME % size


@dataclass(frozen=True)
class Permutation:
    """A seeded order of ``n`` rows in one epoch."""

    n: int
    seed: int
    epoch: int

    def __post_init__(self) -> None:
        if not 0 <= self.n <= LARGEST:
            raise ValueError(f"cannot permute {self.n} rows")

    @property
    def keys(self) -> list[int]:
        return [round_key(self.seed, self.epoch, turn) for turn in range(ROUNDS)]

    def _step(self, x: int, back: bool = False) -> int:
        height, width = grid(self.n)
        a, b = divmod(x, width)
        turns = list(enumerate(self.keys))
        for turn, key in reversed(turns) if back else turns:
            sign = -1 if back else 1
            if turn % 2:
                b = (b + sign * _mixed(a, key, width)) % width
            else:
                a = (a + sign * _mixed(b, key, height)) % height
        return a * width + b

    def _walk(self, x: int, back: bool) -> int:
        x = self._step(x, back)
        while x >= self.n:
            x = self._step(x, back)
        return x

    def walked(self, back: bool) -> list[int]:
        """For each place beyond ``n``, where a walk through it comes back."""
        height, width = grid(self.n)
        return [self._walk(x, back) for x in range(self.n, height * width)]

    def place(self, position: int) -> int:
        """Where a position stands in the epoch."""
        return self._walk(position, False)

    def position(self, place: int) -> int:
        """Which position stands there."""
        return self._walk(place, True)

    def batch(self, batch_id: int, batch_size: int) -> list[int]:
        """The positions of one batch, in order; the last one may be partial."""
        first = batch_id * batch_size
        return [self.position(p) for p in range(first, min(first + batch_size, self.n))]


def _row(p: Permutation, back: bool) -> Column:
    height, width = grid(p.n) if p.n else (1, 1)
    longs = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values]).cast("array<bigint>")
    return F.struct(
        F.lit(p.epoch).alias("epoch"), F.lit(p.n).cast("bigint").alias("n"), F.lit(height).cast("bigint").alias("height"),
        F.lit(width).cast("bigint").alias("width"), longs(p.keys).alias("keys"), longs(p.walked(back) if p.n else []).alias("walked"))


def _int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _walk(x: Column, order: Column, back: bool) -> Column:
    """The network on columns; ``order`` is the struct that describes one permutation."""
    height, width = order["height"], order["width"]
    start = F.struct(_int_div(x, width).alias("a"), (x % width).alias("b"))

    def mixed(half: Column, key: Column, size: Column) -> Column:
        y = (half % PRIME * MULTIPLIER + key) % PRIME
        return _int_div((y * y + key) % PRIME * (1 << 28), F.lit(PRIME).cast("bigint")) % size

    def turned(state: Column, turn: Column) -> Column:
        key = F.get(order["keys"], turn)
        sign = -1 if back else 1
        a = F.when(turn % 2 == 0, F.pmod(state["a"] + sign * mixed(state["b"], key, height), height)).otherwise(state["a"])
        b = F.when(turn % 2 == 1, F.pmod(state["b"] + sign * mixed(state["a"], key, width), width)).otherwise(state["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    turns = F.array(*[F.lit(t) for t in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS))])
    end = F.aggregate(turns, start, turned, lambda s: s["a"] * width + s["b"])
    return F.when(end < order["n"], end).otherwise(F.get(order["walked"], (end - order["n"]).cast("int")))


def place_of(position: Column, order: Permutation) -> Column:
    """Where a position stands in the epoch, as a column."""
    return F.transform(F.array(position.cast("bigint")), lambda x: _walk(x, _row(order, False), False))[0]


def position_of(place: Column, order: Permutation) -> Column:
    """Which position stands at a place of the epoch, as a column."""
    return F.transform(F.array(place.cast("bigint")), lambda x: _walk(x, _row(order, True), True))[0]


def permuted_epochs(df: DataFrame, shard_rows: list[int], epochs: int, seed: int, shard: str = "shard_id", row: str = "row_in_shard") -> DataFrame:
    """Every shard once per epoch, each time in its own seeded order (``rn``, from 0), without moving a row.

    ``shard_rows`` are the shards' counts, as the manifest has them; ``row`` is a row's place in its stored shard. A row beyond its
    shard's count is an error.
    """
    orders = F.array(*[F.array(*[_row(Permutation(n, seed, e), False) for e in range(epochs)]) for n in shard_rows])
    own = F.col("__order")
    repeated = df.withColumn("__order", F.explode(F.get(orders, F.col(shard))))
    inside = F.when(F.col(row).between(F.lit(0), own["n"] - 1), F.col(row).cast("bigint"))
    position = F.coalesce(inside, F.raise_error(F.lit("a row lies beyond the rows its shard was planned with")).cast("bigint"))
    return repeated.withColumns({"epoch": own["epoch"], "rn": _walk(position, own, False)}).drop("__order")
