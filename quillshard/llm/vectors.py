"""Vectors as whole numbers of any size, and their exact products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 256
LONG = (1 << 63) - 1
# Scores of any size travel as two longs: the part from this bit on and the rest.
SPLIT = 62
# No score is larger, either way, than two longs can hold; one that is counts as this.
MOST = (1 << 125) - 1


def cells(vector: Column) -> Column:
    """``floor(SCALE * x)`` of the components; doubles hold every scaled and floored component exactly."""
    scaled = F.transform(vector, lambda x: x.cast("double") * SCALE)
    # beyond a long a double is whole already, and Spark's floor would not fit
    return F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))


def usable(vector: Column) -> Column:
    """Not null, not empty, and all components finite, scaled too."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * SCALE) < float("inf")) & ~F.isnan(x.cast("double")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def exact_scores(questions: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products up to ``MOST``, questions by rows: longs where every partial sum fits a double, else Python integers."""
    if not len(questions) or not len(rows):
        return np.empty((len(questions), len(rows)), np.int64)
    with np.errstate(over="ignore"):
        largest = float((np.abs(questions).max(axis=0) * np.abs(rows).max(axis=0)).sum())
    if largest < 2.0**52:
        return (questions @ rows.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], object) for m in (questions, rows)]
    return np.clip(whole[0] @ whole[1].T, -MOST, MOST)


def parts(score: int) -> tuple[int, int]:
    """A score as two longs that sort like it."""
    return score >> SPLIT, score & ((1 << SPLIT) - 1)


def shown(high: Column, low: Column) -> Column:
    """The score of two parts, or the long that is nearest to it."""
    return F.when(high > 1, F.lit(LONG)).when(high < -2, F.lit(-LONG - 1)).otherwise(F.shiftleft(high, SPLIT).bitwiseOR(low))
