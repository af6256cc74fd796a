"""Encoders: text to token ids.

An encoder works in two steps so that little data crosses a shuffle: ``attach`` adds a truncated
``payload`` and the ``prompt_len``, and ``ids`` turns a payload into the id array later, after rows
have reached the task that writes them. ``length`` counts the ids of a payload without building them.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXTS_PER_CALL = 256
WORD = "[^ \\t\\r\\n]+"
_BLANK_AFTER_WORD = re.compile(r"(?<=\S) ")


class Encoder(Protocol):
    @property
    def pad_id(self) -> int: ...

    def attach(self, df: DataFrame, prompt: str, text: str, max_length: int | None) -> DataFrame: ...

    def ids(self, payload: Column) -> Column: ...

    def length(self, payload: Column) -> Column: ...


def resolve_pad_id(pad_id: int | None, eos_id: int | None) -> int:
    """The pad id, or the end-of-sequence id where no pad id exists."""
    if pad_id is not None:
        return pad_id
    if eos_id is None:
        raise ValueError("the encoder has neither a pad id nor an end-of-sequence id")
    return eos_id


def _capped(length: Column, max_length: int | None) -> Column:
    length = length.cast("int")
    return length if max_length is None else F.least(length, F.lit(max_length))


@dataclass(frozen=True)
class ByteEncoder:
    """UTF-8 bytes as ids 0-255. The payload stays binary, a quarter of the size of an id array."""

    eos_id: int = 256
    own_pad_id: int | None = None

    @property
    def pad_id(self) -> int:
        return resolve_pad_id(self.own_pad_id, self.eos_id)

    def attach(self, df: DataFrame, prompt: str, text: str, max_length: int | None) -> DataFrame:
        body = F.col(text)
        if max_length is None:
            payload = F.encode(body, "UTF-8")
        else:
            # every character is at least one byte, so the first L bytes lie in the first L characters
            payload = F.substring(F.encode(F.substring(body, 1, max_length), "UTF-8"), 1, max_length)
        return df.withColumns(
            {"payload": payload, "prompt_len": _capped(F.octet_length(F.col(prompt)), max_length)}
        )

    def ids(self, payload: Column) -> Column:
        # ISO-8859-1 maps each byte to the character of the same number
        letters = F.split(F.decode(payload, "ISO-8859-1"), "")
        ids = F.transform(letters, lambda c: F.ascii(c))
        return F.when(F.octet_length(payload) == 0, F.array().cast("array<int>")).otherwise(ids)

    def length(self, payload: Column) -> Column:
        return F.octet_length(payload)


@dataclass(frozen=True)
class HashWordEncoder:
    """Whitespace-separated words, each hashed into a fixed vocabulary.

    The payload is the kept words joined by one blank, which is smaller than their ids.
    """

    vocab_size: int = 32000
    eos_id: int | None = None
    own_pad_id: int | None = None

    @property
    def pad_id(self) -> int:
        eos = self.vocab_size if self.eos_id is None else self.eos_id
        return resolve_pad_id(self.own_pad_id, eos)

    def attach(self, df: DataFrame, prompt: str, text: str, max_length: int | None) -> DataFrame:
        words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
        if max_length is not None:
            words = F.slice(words, 1, max_length)
        prompt_words = F.regexp_count(F.col(prompt), F.lit(WORD))
        return df.withColumns(
            {"payload": F.array_join(words, " "), "prompt_len": _capped(prompt_words, max_length)}
        )

    def ids(self, payload: Column) -> Column:
        vocab = self.vocab_size
        ids = F.transform(
            F.split(payload, " "),
            lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % vocab).cast("int"),
        )
        return F.when(payload == "", F.array().cast("array<int>")).otherwise(ids)

    def length(self, payload: Column) -> Column:
        return F.when(payload == "", 0).otherwise(F.regexp_count(payload, F.lit(" ")) + 1)


@dataclass(frozen=True)
class FileEncoder:
    """A ``tokenizer.json`` run through the public ``tokenizers`` package.

    The JSON text is broadcast and parsed once per Python worker and batch stream. Full texts get the
    tokenizer's special tokens and prompts do not; both come back from one call per batch. With a length, and a
    tokenizer that treats what stands before a blank alike whatever follows, a text is read on in doubling
    stretches only until its ids are full.
    """

    tokenizer_json: str
    pad_token: str | None = None
    eos_token: str | None = None

    @property
    def pad_id(self) -> int:
        tokenizer = _load_tokenizer(self.tokenizer_json)
        look_up = lambda token: None if token is None else tokenizer.token_to_id(token)
        return resolve_pad_id(look_up(self.pad_token), look_up(self.eos_token))

    def attach(self, df: DataFrame, prompt: str, text: str, max_length: int | None) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.tokenizer_json)

        @F.arrow_udf("ids array<int>, prompt_len int")
        def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            tokenizer = _load_tokenizer(shared.value)
            in_stretches = max_length is not None and parts_at_blanks(shared.value)
            tokenizer.no_padding()
            if max_length is None:
                tokenizer.no_truncation()
            else:
                tokenizer.enable_truncation(max_length)
            for prompts, texts in batches:
                ids, prompt_lens = [], []
                # encodings are larger than their ids, so only a few are held at a time
                for at in range(0, len(texts), TEXTS_PER_CALL):
                    full = texts[at : at + TEXTS_PER_CALL].to_pylist()
                    bare = prompts[at : at + TEXTS_PER_CALL].to_pylist()
                    ids += _ids_of(tokenizer, full, max_length, in_stretches, True)
                    prompt_lens += map(len, _ids_of(tokenizer, bare, max_length, in_stretches, False))
                yield pa.StructArray.from_arrays(
                    [pa.array(ids, pa.list_(pa.int32())), pa.array(prompt_lens, pa.int32())], ["ids", "prompt_len"]
                )

        encoded = df.withColumn("__encoded", encode(F.col(prompt), F.col(text)))
        return encoded.withColumns(
            {"payload": F.col("__encoded.ids"), "prompt_len": F.col("__encoded.prompt_len")}
        ).drop("__encoded")

    def ids(self, payload: Column) -> Column:
        return payload

    def length(self, payload: Column) -> Column:
        return F.size(payload)


def parts_at_blanks(tokenizer_json: str) -> bool:
    """Whether the tokens before a blank that follows a word are the same with and without what comes after.

    That holds for the byte-level pre-tokenizer with its regex and no normalizer: none of its pieces goes from another
    character to a blank, and it looks ahead only from blanks to the next character. Added tokens must be plain and hold no blanks.
    """
    spec = json.loads(tokenizer_json)
    pre = spec.get("pre_tokenizer") or {}
    plain = lambda token: not (
        token.get("lstrip") or token.get("rstrip") or token.get("single_word") or re.search(r"\s", token["content"]))
    return (
        spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        and all(map(plain, spec.get("added_tokens") or []))
    )


def _ids_of(tokenizer, texts: list[str], max_length: int | None, in_stretches: bool, special: bool) -> list[list[int]]:
    """The ids of whole texts, cut to the length the tokenizer is set to; full ids need no more of their text."""
    found: list[list[int]] = [[]] * len(texts)
    left, stretch = list(range(len(texts))), max_length
    while left:
        ends = [_BLANK_AFTER_WORD.search(texts[i], stretch) if in_stretches else None for i in left]
        heads = [texts[i] if end is None else texts[i][: end.start()] for i, end in zip(left, ends, strict=True)]
        more = []
        for i, end, encoding in zip(left, ends, tokenizer.encode_batch_fast(heads, add_special_tokens=special), strict=True):
            found[i] = encoding.ids
            if end is not None and len(found[i]) < max_length:
                more.append(i)
        left = more
        if in_stretches:
            stretch *= 2
    return found


def _load_tokenizer(tokenizer_json: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    try:
        from tokenizers import Tokenizer
    except ImportError as err:
        raise ImportError("FileEncoder needs the 'tokenizers' package") from err
    return Tokenizer.from_str(tokenizer_json)
