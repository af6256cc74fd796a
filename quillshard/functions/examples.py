"""Fixed-length training examples: padding, attention mask and label masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillshard.functions.encoders import Encoder
from quillshard.functions.formatting import Formatter, full_text, with_prompt_target

# The label that a loss ignores, and the columns of a stored example.
IGNORE_LABEL = -100
EXAMPLE_COLUMNS = ("input_ids", "attention_mask", "labels")

EXAMPLE_SCHEMA = T.StructType(
    [T.StructField(name, T.ArrayType(T.IntegerType(), True), True) for name in EXAMPLE_COLUMNS]
)


def pad_ids(ids: Column, max_length: int, pad_id: int) -> Column:
    """Ids filled up on the right with the pad id."""
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(max_length) - F.size(ids)))


def attention_mask(n_tokens: Column, max_length: int) -> Column:
    """Ones for real tokens, zeros for padding."""
    return F.concat(
        F.array_repeat(F.lit(1), n_tokens), F.array_repeat(F.lit(0), F.lit(max_length) - n_tokens)
    )


def mask_prompt(
    input_ids: Column, prompt_len: Column, max_length: int, n_tokens: Column | None = None
) -> Column:
    """Labels: the prompt positions ignored, every later position a copy of its id.

    Padding is copied too, unless ``n_tokens`` is given; then positions from there on are ignored.
    """
    hidden = F.least(prompt_len, F.lit(max_length))
    end = F.lit(max_length) if n_tokens is None else F.greatest(n_tokens, hidden)
    parts = [F.array_repeat(F.lit(IGNORE_LABEL), hidden), F.slice(input_ids, hidden + 1, end - hidden)]
    if n_tokens is not None:
        parts.append(F.array_repeat(F.lit(IGNORE_LABEL), F.lit(max_length) - end))
    return F.concat(*parts)


def encode_rows(df: DataFrame, formatter: Formatter, encoder: Encoder, max_length: int | None) -> DataFrame:
    """Format and encode; source text is replaced by ``payload`` and ``prompt_len``."""
    formatted = with_prompt_target(df, formatter)
    texts = formatted.withColumn("__text", full_text(F.col("prompt"), F.col("target")))
    encoded = encoder.attach(texts, "prompt", "__text", max_length)
    return encoded.drop("__text", "prompt", "target")


def to_examples(
    df: DataFrame, encoder: Encoder, max_length: int, keep: tuple[str, ...] = (), mask_padding: bool = False
) -> DataFrame:
    """Payload rows to the three example columns, plus the columns named in ``keep``.

    Each stage reads the one before it by name, so an id array is built once per row.
    """
    kept = [F.col(name) for name in keep]
    ids = df.select(*kept, "prompt_len", encoder.ids(F.col("payload")).alias("__ids"))
    padded = ids.select(
        *kept,
        "prompt_len",
        F.size("__ids").alias("__n"),
        pad_ids(F.col("__ids"), max_length, encoder.pad_id).alias("input_ids"),
    )
    return padded.select(
        *kept,
        "input_ids",
        attention_mask(F.col("__n"), max_length).alias("attention_mask"),
        mask_prompt(
            F.col("input_ids"), F.col("prompt_len"), max_length, F.col("__n") if mask_padding else None
        ).alias("labels"),
    )
