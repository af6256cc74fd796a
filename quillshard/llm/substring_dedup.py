"""Substring dedup by content-defined chunking with a gear rolling hash.

A document is its words, joined by single blanks. A 16-bit gear hash rolls over the bytes (``h = (h << 1) +
GEAR[byte]``, so it sees the last 16 bytes), and a word end at which its top bits are zero ends a chunk, on
average every ``1 << CUT_BITS`` words. Cuts depend on nearby bytes only, so a passage has the same chunks
wherever it stands and whatever was inserted before it. Chunks are short, to follow a passage closely to its
ends; what is digested is the run of whole chunks from each cut that first reaches ``UNIT_WORDS`` words, which is
specific enough not to repeat by chance. A document's start and end are cuts too.

Of units with equal digests (96 bits) the one in the document with the smallest id, there the first one, stays;
the words of all others are removed, but for words that overlap the unit that stays. Repeats inside one
document count as well. Passages under ``UNIT_WORDS`` words are never removed; a passage of 50 words or more is
found up to a few words at its ends.

Two passes. The first shuffles 32 bits of each unit's digest and counts them. What is found more than once becomes a bitmap
of ``BITS_EACH`` bits for each, at most ``MOST_BITS`` (16 MB) however many there are. The second pass
sends on only units whose bit is set, so what it shuffles follows the repeats and not the input; units that share bits by
chance are counted apart there by whole digests. Beyond the most bits the bitmap lets more through, and the result is the same.
Units then meet the repeated digests in a join that Spark may split where one digest is frequent; nothing is gathered per
digest. What is gathered is per document.

Null texts and texts under ``UNIT_WORDS`` words have no units. Rows without an id take no part and stay as they
are. Equal rows count as one document; rows that share an id but not the text are told apart by a hash of the
text. An empty table gives an empty result, and further columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillshard.llm.common import staged, table, text_batches, with_extras_aside

UNIT_WORDS = 16
CUT_BITS = 2
MAX_CHUNK_WORDS = 64
GEAR = np.random.default_rng(20).integers(0, 1 << 16, 256, dtype=np.uint16)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
# A unit's place: its first word times this, plus its words, of which there are at most UNIT_WORDS + MAX_CHUNK_WORDS.
PLACE = 1 << 8
# Bits of the bitmap for a repeated digest, and all it may have: the size of what is broadcast.
BITS_EACH, MOST_BITS = 16, 1 << 27
UNIT_SCHEMA = "d1 bigint, d2 int, doc_id bigint, tie int, place bigint"


def gear_hashes(data: bytes) -> np.ndarray:
    """The rolling gear hash after each byte."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8):
        step = h.copy()
        step[shift:] += h[:-shift] << np.uint16(shift)
        h = step
    return h


def cut_words(words: list[bytes], joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk boundaries as word numbers (0 and the word count included) and the byte span of each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    at = np.flatnonzero(gear_hashes(joined)[ends - 1] < (1 << (16 - CUT_BITS))) + 1
    cuts = np.unique(np.concatenate(([0], at, [len(words)])))
    gaps = np.flatnonzero(np.diff(cuts) > MAX_CHUNK_WORDS)
    if len(gaps):
        forced = [np.arange(cuts[g] + MAX_CHUNK_WORDS, cuts[g + 1], MAX_CHUNK_WORDS) for g in gaps]
        cuts = np.union1d(cuts, np.concatenate(forced))
    return cuts, ends - lengths, ends


def units_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest pairs, first words and end words of a text's units."""
    words = text.split()
    if len(words) < UNIT_WORDS:
        return np.empty((0, 2), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    joined = b" ".join(words)
    cuts, starts, ends = cut_words(words, joined)
    to = np.searchsorted(cuts, cuts[:-1] + UNIT_WORDS)
    whole = to < len(cuts)
    first, end = cuts[:-1][whole], cuts[to[whole]]
    digest = xxhash.xxh3_128_digest
    spans = zip(starts[first].tolist(), ends[end - 1].tolist(), strict=True)
    digests = b"".join([digest(joined[a:b]) for a, b in spans])
    return np.frombuffer(digests, np.int64).reshape(-1, 2), first, end


def _slot_batches(batches):
    """32 bits of each unit's digest."""
    for batch in batches:
        found = [units_of(t or b"")[0][:, 0] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int32))], names=["slot"])


def _unit_batches(bitmap):
    """The units whose bit is set."""

    def kept(batches):
        bits, mask = bitmap.value
        for batch in batches:
            digests, first, end, rows = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                d, a, b = units_of(text or b"")
                slot = d[:, 0].astype(np.int32).astype(np.int64) & mask
                hit = (bits[slot >> 6] >> (slot & 63)) & 1 == 1
                if hit.any():
                    digests.append(d[hit])
                    first.append(a[hit])
                    end.append(b[hit])
                    rows.append(np.full(int(hit.sum()), row))
            if not rows:
                continue
            d, row = np.concatenate(digests), pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(d[:, 0]),
                    pa.array((d[:, 1] >> 32).astype(np.int32)),
                    batch.column("doc_id").take(row),
                    batch.column("tie").take(row),
                    pa.array(np.concatenate(first) * PLACE + (np.concatenate(end) - np.concatenate(first))),
                ],
                names=["d1", "d2", "doc_id", "tie", "place"],
            )

    return kept


def _bitmap(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Words of the bitmap of digest slots that occur more than once, and the mask that gives a slot's bit."""
    slots = rows.select("text").mapInArrow(_slot_batches, "slot int").groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    repeated = staged(slots.where(F.col("n") > 1).select("slot"), "substring-slots")
    size = 1 << 12
    wanted = repeated.count() * BITS_EACH
    while size < min(wanted, MOST_BITS):
        size *= 2
    bit = F.col("slot").cast("bigint").bitwiseAND(F.lit(size - 1))
    words = repeated.groupBy(F.shiftright(bit, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    found = words.toArrow()
    bits = np.zeros(size >> 6, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits, size - 1


def units(docs: DataFrame) -> DataFrame:
    """The units whose digest may occur more than once."""
    text_batches(docs.sparkSession)
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.hash("text").alias("tie"), F.col("text").cast("binary").alias("text"))
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(rows))
    return rows.mapInArrow(_unit_batches(bitmap), UNIT_SCHEMA)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Word spans to remove: ``doc_id, tie, start, end, kept_doc_id``, disjoint within a document.

    ``kept_doc_id`` is the document in which the span's first unit stays; ``start`` and ``end`` count words from 0.
    """
    all_units = staged(units(docs), "substring-units")
    counted = all_units.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("kept_doc_id"))
    repeated = counted.where(F.col("n") > 1).select("d1", "d2", "kept_doc_id")
    met = staged(all_units.join(repeated, ["d1", "d2"]), "substring-repeats")
    start = F.shiftright("place", 8)
    met = met.withColumns({"start": start.cast("int"), "end": (start + F.col("place") % PLACE).cast("int")})
    elsewhere = met.where(F.col("doc_id") != F.col("kept_doc_id")).select("doc_id", "tie", "start", "end", "kept_doc_id")
    # in the document that keeps the digest the first unit stays; a group here is one document's
    own = Window.partitionBy("d1", "d2").orderBy("tie", "start")
    place = met.where(F.col("doc_id") == F.col("kept_doc_id")).withColumns({
        "nth": F.dense_rank().over(own),
        "stays": F.struct(F.first("tie").over(own).alias("tie"), F.first("end").over(own).alias("end")),
    })
    overlap = F.when(F.col("stays.tie") == F.col("tie"), F.greatest("start", "stays.end")).otherwise(F.col("start"))
    inside = place.where(F.col("nth") > 1).select("doc_id", "tie", overlap.alias("start"), "end", "kept_doc_id")
    spans = elsewhere.union(inside.where(F.col("start") < F.col("end")))
    by_doc = Window.partitionBy("doc_id", "tie").orderBy("start", "end", "kept_doc_id")
    reach = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.when(reach >= F.col("start"), 0).otherwise(1))
    joined = opened.withColumn("part", F.sum("opens").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy("doc_id", "tie", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kept_doc_id", "start").alias("kept_doc_id")
    ).drop("part")


def cut_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; blanks before a cut stay, those after a cut word go with it."""
    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    kept, last = [], 0
    for start, end in spans:
        kept.append(text[last : at[start]])
        last = at[end]
    kept.append(text[last:])
    return b"".join(kept)


def _cut_batches(batches):
    for batch in batches:
        cut = [
            t if s is None else cut_text(t, sorted((x["start"], x["end"]) for x in s))
            for t, s in zip(batch.column("__raw").to_pylist(), batch.column("__spans").to_pylist(), strict=True)
        ]
        keep = [n for n in batch.schema.names if n not in ("__raw", "__spans")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in keep], pa.array(cut, pa.binary())], names=[*keep, "__raw"])


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The stage form: documents without their repeated spans; a document of which no word is left goes.

    Further columns pass through, whatever their names are.
    """
    return with_extras_aside(docs, _without_repeats)


def _without_repeats(docs: DataFrame) -> DataFrame:
    text_batches(docs.sparkSession)
    spans = repeated_spans(docs).groupBy(F.col("doc_id").alias("__doc"), F.col("tie").alias("__tie")).agg(
        F.collect_list(F.struct("start", "end")).alias("__spans"))
    same = (F.col("doc_id").cast("bigint") == F.col("__doc")) & (F.hash("text") == F.col("__tie"))
    joined = docs.join(spans, same, "left").drop("__doc", "__tie")
    hit = joined.where(F.col("__spans").isNotNull()).withColumn("__raw", F.col("text").cast("binary")).drop("text")
    schema = hit.drop("__raw", "__spans").withColumn("__raw", F.lit(b"")).schema
    cut = hit.mapInArrow(_cut_batches, schema).withColumn("text", F.col("__raw").cast("string"))
    cut = cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("bigint"))
    return joined.where(F.col("__spans").isNull()).select(*docs.columns).unionByName(cut.select(*docs.columns))


def op9_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spans.select(
        "doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"),
        (F.col("end") - F.col("start")).alias("n_words"), "kept_doc_id")
