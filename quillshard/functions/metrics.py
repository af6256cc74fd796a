"""Scalar expressions over step metrics and run environments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: losses above this are clamped before exponentiation.
PERPLEXITY_LOSS_CAP = 20.0


def perplexity(loss: Column) -> Column:
    """``exp`` of the clamped loss. NaN stays NaN and null stays null, which Spark's ``least`` would not see to."""
    return F.when(loss.isNull() | F.isnan(loss), loss).otherwise(F.exp(F.least(loss, F.lit(PERPLEXITY_LOSS_CAP))))


def per_second(amount: Column, duration: Column) -> Column:
    """A rate, 0 where the duration is null, NaN, zero or negative."""
    return F.when((duration > 0) & ~F.isnan(duration), amount / duration).otherwise(F.lit(0.0))


def step_duration(duration: Column) -> Column:
    return F.coalesce(duration, F.lit(0.0))


def whole_number(text: Column) -> Column:
    """Text as a whole number, null where it is not one.

    Surrounding blanks, a sign and single underscores between digits are allowed; a decimal point is not.
    """
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(
        trimmed.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.regexp_replace(trimmed, "_", "").try_cast("bigint")
    )


def env_rank(rank: Column, fallback: Column, default: int = 0) -> Column:
    """The first of two environment texts that is a whole number, else the default."""
    return F.coalesce(whole_number(rank), whole_number(fallback), F.lit(default).cast("bigint"))


def env_world_size(world_size: Column, default: int = 1) -> Column:
    return F.coalesce(whole_number(world_size), F.lit(default).cast("bigint"))


def four_decimals(value: Column) -> Column:
    return F.format_string("%.4f", value)
