"""Conflict-constrained best-fit packing of documents into training sequences.

Two documents conflict if they have the same source (unless ``spread_sources`` is off) or the same duplicate cluster; no
sequence holds a conflicting pair. A document longer than a sequence is cut into full pieces and a rest, and no words are lost.

Pieces are dealt by a hash into groups of about ``GROUP_ROWS`` and packed by one task each, largest first. Equal
rows are numbered, and each goes to the group after its predecessor's, so a row repeated without end fills all groups alike.
Open bins stand in the order of their residual room, and each carries a bitmap of its sources and one of its
clusters. The search starts at the successor of the piece's length and goes on to roomier bins until the
first, hence tightest, one that is compatible; without one a new bin opens. Groups have equal sizes whatever
source or cluster is frequent, and only ids, lengths and hashes are shuffled, never texts.

Null texts and texts without words are pieces of length 0 and need a compatible bin like any other. A null source
or cluster conflicts with nothing. Repeated rows are separate pieces. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillshard.llm.common import WORD, n_words, numbered, staged, table

CAPACITY = 2048
GROUP_ROWS = 2048


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(length, source bit, cluster bit) in packing order -> (bin, offset of the piece in it)."""
    room: list[tuple[int, int]] = []
    used: list[int] = []
    sources: list[int] = []
    clusters: list[int] = []
    placed = []
    for length, source, cluster in items:
        at = bisect_left(room, (length, -1))
        while at < len(room):
            b = room[at][1]
            if not (sources[b] & source or clusters[b] & cluster):
                break
            at += 1
        if at < len(room):
            del room[at]
        else:
            b = len(used)
            used.append(0)
            sources.append(0)
            clusters.append(0)
        placed.append((b, used[b]))
        used[b] += length
        sources[b] |= source
        clusters[b] |= cluster
        insort(room, (capacity - used[b], b))
    return placed


def _bits(values: list) -> list[int]:
    """A bit of its own for each distinct value of the group; none for nulls."""
    index: dict = {}
    return [0 if v is None else 1 << index.setdefault(v, len(index)) for v in values]


def _pack_group(capacity: int, spread_sources: bool, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("tie", "ascending")])
    sources = rows["source"].to_pylist() if spread_sources else [None] * len(rows)
    items = zip(rows["n_words"].to_pylist(), _bits(sources), _bits(rows["cluster"].to_pylist()), strict=True)
    placed = best_fit(list(items), capacity)
    rows = rows.set_column(rows.schema.get_field_index("bin"), "bin", pa.array([b for b, _ in placed], pa.int64()))
    return rows.set_column(rows.schema.get_field_index("bin_start"), "bin_start", pa.array([o for _, o in placed], pa.int64()))


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    cluster: str | None = None,
    group_rows: int = GROUP_ROWS,
    spread_sources: bool = True,
) -> DataFrame:
    """One row per piece: ``doc_id, source, cluster, piece, doc_start, n_words, pack_id, bin_start``.

    ``cluster`` names the column of duplicate clusters; by default equal texts are a cluster. ``doc_start`` is the
    piece's first word in its document, ``bin_start`` its place in the sequence ``pack_id``.
    """
    label = F.col(cluster).cast("string") if cluster else F.md5("text")
    lengths = staged(numbered(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        label.alias("cluster"),
        F.xxhash64("text").alias("tie"),
        n_words(F.col("text")).alias("n"),
    ), "copy"), "pack-lengths")
    last = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)) - 1
    pieces = lengths.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    total = lengths.agg(F.sum(last + 1)).first()[0] or 0
    groups = max(1, -(-total // group_rows))
    rows = pieces.select(
        "doc_id", "source", "cluster", "tie", "piece",
        (F.col("piece") * capacity).alias("doc_start"),
        F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("n_words"),
        F.pmod(F.pmod(F.xxhash64("doc_id", "tie", "piece", "source"), F.lit(groups)) + F.col("copy"), F.lit(groups)).alias("group"),
        F.lit(None).cast("bigint").alias("bin"),
        F.lit(None).cast("bigint").alias("bin_start"),
    )
    packed = rows.groupBy("group").applyInArrow(lambda t: _pack_group(capacity, spread_sources, t), rows.schema)
    return packed.select(
        "doc_id", "source", "cluster", "tie", "piece", "doc_start", "n_words",
        F.shiftleft("group", 24).bitwiseOR(F.col("bin")).alias("pack_id"), "bin_start")


def packed_texts(docs: DataFrame, placements: DataFrame) -> DataFrame:
    """The sequences: ``pack_id, n_words, text`` with the words of its pieces in order, joined by blanks.

    The pieces of one sequence hold at most its capacity of words, which bounds every group built here.
    """
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"),
        F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("words"),
    ).dropDuplicates(["doc_id", "tie"])
    right = texts.withColumnsRenamed({"doc_id": "__d", "tie": "__t"})
    joined = placements.join(right, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("tie") == F.col("__t")))
    part = F.slice("words", (F.col("doc_start") + 1).cast("int"), F.col("n_words").cast("int"))
    pieces = joined.select("pack_id", "bin_start", "n_words", F.array_join(part, " ").alias("part"))
    return pieces.where(F.col("n_words") > 0).groupBy("pack_id").agg(
        F.sum("n_words").alias("n_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin_start", "part"))), lambda x: x["part"]), " ").alias("text"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("tie")
