"""Split expressions: ``train[:10%]+val[50:150]`` as ranges of positions of named splits."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshard.operators.positions import ROWS_PER_PART, range_layout, with_position
from quillshard.sources.datasets import read_examples

_TERM = re.compile(r"^\s*(?P<name>[\w.-]+)\s*(\[\s*(?P<first>-?\d+%?)?\s*:\s*(?P<end>-?\d+%?)?\s*\])?\s*$")


@dataclass(frozen=True)
class SplitSlice:
    """A run of rows of a split, in the order of its key; bounds are rows, or percent of the rows where they end in ``%``."""

    name: str
    first: str | None = None
    end: str | None = None

    def rows(self, total: int) -> tuple[int, int]:
        """First and one-past-last position. Negative bounds count from the end; percent round to the nearest row, halves to even."""
        first, end = (_bound(b, total, default) for b, default in ((self.first, 0), (self.end, total)))
        if not (0 <= first <= total and 0 <= end <= total):
            raise ValueError(f"{self.name}[{self.first or ''}:{self.end or ''}] does not fit the {total} rows of the split")
        return first, max(first, end)


def _bound(text: str | None, total: int, default: int) -> int:
    if text is None:
        return default
    if not text.endswith("%"):
        return int(text) + (total if text.startswith("-") else 0)
    percent = int(text[:-1])
    if abs(percent) > 100:
        raise ValueError(f"{text} is not a percentage of a split")
    return round((percent + 100 if text.startswith("-") else percent) * total / 100)


def split_slices(expression: str) -> list[SplitSlice]:
    """The slices of a split expression, in order; the same split may occur more than once."""
    found = [_TERM.match(term) for term in expression.split("+")]
    if not all(found):
        raise ValueError(f"'{expression}' is not a split expression such as train[:10%]+val[50:150]")
    return [SplitSlice(m["name"], m["first"], m["end"]) for m in found]


def read_slices(
    spark: SparkSession, path: str, expression: str, key: list[str], rows_per_part: int = ROWS_PER_PART, **options
) -> DataFrame:
    """The rows of a split expression with their ``position`` in it; splits follow each other as written.

    ``key`` gives each split's order. Rows are counted once per slice, and only the rows in the buckets that a slice lies
    in are moved. ``options`` are those of ``read_examples``.
    """
    offset, parts = 0, None
    for piece in split_slices(expression):
        df = read_examples(spark, path, split=piece.name, **options)
        layout = range_layout(df, key, rows_per_part)
        first, end = piece.rows(layout.total)
        if first < end:
            placed = with_position(df, layout.between(first, end)).where(F.col("position").between(first, end - 1))
            placed = placed.withColumn("position", F.col("position") + (offset - first))
        else:
            placed = df.where(F.lit(False)).withColumn("position", F.lit(0).cast("bigint"))
        offset += end - first
        parts = placed if parts is None else parts.unionByName(placed)
    return parts
