"""Row formatting: one raw row becomes a prompt column and a target column."""

from __future__ import annotations

import string
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The default prompt layout and the text a null field prints as.
INSTRUCTION_LABEL = "Instruction: "
INPUT_LABEL = "\nInput: "
RESPONSE_LABEL = "\n\nResponse:"
NULL_TEXT = "None"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class Formatter(Protocol):
    """Anything that can name a prompt column and a target column of a DataFrame."""

    def columns(self, df: DataFrame) -> tuple[Column, Column]: ...


@dataclass(frozen=True)
class InstructionFormatter:
    """Instruction, optional input and target fields, with an optional prompt template.

    The template may use ``{instruction}`` and ``{input}``. A field missing from the table is the
    empty string; a null field prints as ``None`` (``on_null="text"``), is empty (``"empty"``), or takes its
    row out (``"drop"``). Without a template the input block is left out
    when the input is null or empty. Integer and boolean fields are rendered only with
    ``cast_non_string``; other types have no rendering that is safe to rely on and are rejected.
    """

    instruction_field: str
    target_field: str
    input_field: str | None = None
    template: str | None = None
    cast_non_string: bool = False
    on_null: str = "text"

    def __post_init__(self) -> None:
        if self.on_null not in ("text", "empty", "drop"):
            raise ValueError(f"on_null is text, empty or drop, not '{self.on_null}'")

    def keeps(self, df: DataFrame) -> Column:
        """Rows that stay: all of them, or with ``on_null="drop"`` those whose fields are all given."""
        fields = (self.instruction_field, self.target_field, self.input_field) if self.on_null == "drop" else ()
        present = [F.col(f"`{name}`").isNotNull() for name in fields if name and name in df.columns]
        return reduce(lambda a, b: a & b, present, F.lit(True))

    def columns(self, df: DataFrame) -> tuple[Column, Column]:
        instruction, _ = self._field(df, self.instruction_field)
        target, _ = self._field(df, self.target_field)
        extra, has_extra = self._field(df, self.input_field)
        if self.template is None:
            block = F.when(has_extra, F.concat(F.lit(INPUT_LABEL), extra)).otherwise("")
            prompt = F.concat(F.lit(INSTRUCTION_LABEL), instruction, block, F.lit(RESPONSE_LABEL))
        else:
            prompt = template_column(self.template, {"instruction": instruction, "input": extra})
        return prompt, target

    def _field(self, df: DataFrame, name: str | None) -> tuple[Column, Column]:
        """The text of a field and whether the field counts as given."""
        if not name or name not in df.columns:
            return F.lit(""), F.lit(False)
        dtype = df.schema[name].dataType
        col = F.col(f"`{name}`")
        if isinstance(dtype, T.StringType):
            text, given = col, col != ""
        elif self.cast_non_string and isinstance(dtype, T.BooleanType):
            text, given = F.initcap(col.cast("string")), col
        elif self.cast_non_string and isinstance(dtype, _INTEGRAL):
            text, given = col.cast("string"), col != 0
        else:
            raise TypeError(f"field '{name}' is {dtype.simpleString()}, not a string")
        return F.coalesce(text, F.lit(NULL_TEXT if self.on_null == "text" else "")), F.coalesce(given, F.lit(False))


def template_column(template: str, fields: Mapping[str, Column]) -> Column:
    """A brace template as one concat: literal text and fields, so row text is copied verbatim."""
    pieces: list[Column] = []
    for literal, name, spec, conversion in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is None:
            continue
        if spec or conversion:
            raise ValueError(f"template field '{name}' must not carry a conversion or format")
        if name == "" or name.isdigit():
            raise IndexError("template fields are named, not positional")
        if name not in fields:
            raise KeyError(name)
        pieces.append(fields[name])
    return F.concat(*pieces) if pieces else F.lit("")


@dataclass(frozen=True)
class RowFormatter:
    """A caller's Python function ``row -> (prompt, target)``, fed in Arrow batches.

    Only the named fields cross into Python. Fields the table lacks are absent from the mapping.
    """

    fn: Callable[[Mapping[str, Any]], tuple[str, str]]
    fields: tuple[str, ...]

    def columns(self, df: DataFrame) -> tuple[Column, Column]:
        fn = self.fn
        present = [F.col(f"`{name}`") for name in self.fields if name in df.columns]
        result = pa.struct([("prompt", pa.string()), ("target", pa.string())])

        @F.arrow_udf("prompt string, target string")
        def format_batch(rows: pa.Array) -> pa.Array:
            pairs = []
            for row in rows.to_pylist():
                del row["__row"]
                pairs.append(dict(zip(("prompt", "target"), fn(row), strict=True)))
            return pa.array(pairs, type=result)

        # a column of its own keeps the rows countable when no named field exists
        pair = format_batch(F.struct(*present, F.lit(0).alias("__row")))
        text = lambda name: F.coalesce(pair[name], F.lit(NULL_TEXT))
        return text("prompt"), text("target")


def with_prompt_target(df: DataFrame, formatter: Formatter) -> DataFrame:
    if getattr(formatter, "on_null", "text") == "drop":
        df = df.where(formatter.keeps(df))
    prompt, target = formatter.columns(df)
    return df.withColumns({"prompt": prompt, "target": target})


def full_text(prompt: Column, target: Column) -> Column:
    """The text a model sees: prompt, one space, target."""
    return F.concat(prompt, F.lit(" "), target)
