"""Hard-negative mining over candidate blocks in Hilbert order, with zone maps.

Vectors become whole numbers, ``floor(SCALE * x)``. Candidates are sorted by label and, within a label, along a Hilbert
curve through all dimensions (each cut into ``1 << CURVE_BITS`` cells between the mean and ``SPREAD`` deviations to either
side), and are written as Parquet blocks: a row holds a block's label, its per-dimension minima and maxima (the zone
map), and, in columns of their own, its ids and vectors. Planning reads the zone maps only.

A question is a vector, a window of scores, whether it asks for the question's own label or for the others, and how many rows
it wants. Interval arithmetic over a zone map bounds the score of every row of a block from both sides. A block is read
for a question if its label fits, its bounds meet the window, and its upper bound reaches the question's floor: the score that
blocks which lie wholly inside the window guarantee for enough rows. The floor is drawn from a task's own zone maps first
and then, in a window over what is left, from all. Chosen blocks meet their questions in a join on the block's number, scores are
exact, and at most as many rows as asked for leave a block.

Positives are the first answers among the anchor's own label, without limits; each positive then asks for negatives between
half and 95 hundredths of its score. Questions are broadcast ``ASK_BYTES`` at a time, in as many passes over the zone maps
as it takes. A label that a third of all rows hold is many blocks; a block is bounded in bytes.

Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; so do
components that are beyond a double once scaled. Scores are exact up to 2**125, where they end, and ranked so; one beyond a
long is *shown* as the nearest long. Scores are taken between vectors of one dimension. An anchor is never its own positive or negative, nor
is a row that shares its id; anchors that are equal in all columns are asked once, repeated candidates count as often as
they occur. Ties go to the smaller id. Further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillshard.llm.common import staged, table, text_batches
from quillshard.llm.vectors import MOST as LARGEST
from quillshard.llm.vectors import SCALE, SPLIT, cells, exact_scores, parts, shown, usable
from quillshard.session import scratch_dir

ANCHOR_EVERY = 50
POSITIVES, NEGATIVES = 5, 3
# Share of a positive's score, in hundredths, that a negative must have at least and at most.
LEAST, MOST = 50, 95
CURVE_BITS, SPREAD = 3, 2.0
BLOCK_BYTES = 128 << 10
ASK_BYTES = 4 << 20
BLOCK = ("block bigint, dimension int, label bigint, n int, low array<double>, high array<double>, "
         "ids array<bigint>, cells array<double>")
READ = "ask bigint, block bigint, upper double, lower double, sure int"
FOUND = "ask bigint, vec_id bigint, high bigint, low bigint"


def hilbert_keys(grid: np.ndarray, bits: int) -> list[bytes]:
    """Places along the Hilbert curve through cells ``grid`` (rows by dimensions, below ``1 << bits``), as sortable bytes."""
    x = np.ascontiguousarray(grid.T).astype(np.uint8)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint8(1 << level), np.uint8((1 << level) - 1)
        for axis in range(len(x)):
            # upper half of this axis: mirror the first axis; lower half: swap this axis with the first
            upper = (x[axis] & bit) != 0
            swap = np.where(upper, 0, (x[0] ^ x[axis]) & below).astype(np.uint8)
            x[0] ^= np.where(upper, below, swap).astype(np.uint8)
            x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    flip = np.zeros(x.shape[1], np.uint8)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & np.uint8(1 << level), np.uint8((1 << level) - 1), np.uint8(0)).astype(np.uint8)
    x ^= flip
    planes = np.concatenate([(x >> np.uint8(level)) & np.uint8(1) for level in range(bits - 1, -1, -1)])
    return [row.tobytes() for row in np.packbits(planes.T, axis=1)]


def _keyed(shape):
    """Adds the curve key; ``shape`` maps a dimension count to per-dimension means and deviations."""

    def keyed(batches):
        for batch in batches:
            sizes = batch.column("dimension").to_numpy()
            keys = np.empty(batch.num_rows, object)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                rows = batch.column("cells").take(pa.array(at)).flatten().to_numpy().reshape(-1, d)
                mean, deviation = shape[d]
                with np.errstate(all="ignore"):
                    place = np.nan_to_num((rows - mean) / deviation / (2 * SPREAD) + 0.5)
                grid = np.clip(place * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.int64)
                keys[at] = hilbert_keys(grid, CURVE_BITS)
            yield batch.append_column("curve", pa.array(keys.tolist(), pa.binary()))

    return keyed


def _block_batches(batches):
    """Cuts sorted rows into blocks of one label and dimension."""
    part, n = TaskContext.get().partitionId(), 0
    label = dimension = None
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    held = 0

    def block():
        nonlocal n, ids, rows, held
        own = np.concatenate(rows)
        out = [(part << 32) + n, dimension, label, held, own.min(axis=0), own.max(axis=0), np.concatenate(ids), own.ravel()]
        n, ids, rows, held = n + 1, [], [], 0
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.list_(pa.float64())] * 2, pa.list_(pa.int64()), pa.list_(pa.float64())]
        names = ["block", "dimension", "label", "n", "low", "high", "ids", "cells"]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, types, strict=True)], names=names)

    for batch in batches:
        sizes, labels = batch.column("dimension").to_numpy(), batch.column("label").to_numpy()
        own_ids, flat = batch.column("vec_id").to_numpy(), batch.column("cells").flatten().to_numpy()
        starts = np.concatenate(([0], np.cumsum(sizes)))
        edges = np.flatnonzero((sizes[1:] != sizes[:-1]) | (labels[1:] != labels[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if held and (label, dimension) != (int(labels[a]), int(sizes[a])):
                yield block()
            label, dimension = int(labels[a]), int(sizes[a])
            room = max(1, BLOCK_BYTES // (8 * dimension))
            while a < b:
                to = min(b, a + room - held)
                ids.append(own_ids[a:to])
                rows.append(flat[starts[a] : starts[to]].reshape(-1, dimension))
                held, a = held + to - a, to
                if held == room:
                    yield block()
    if held:
        yield block()


def write_blocks(vectors: DataFrame) -> DataFrame:
    """Blocks of the usable rows of ``vec_id, label, vector``, in the order of label and curve."""
    spark = vectors.sparkSession
    text_batches(spark)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.size("vector").alias("dimension"), cells(F.col("vector")).alias("cells"))
    spread = rows.select("dimension", F.posexplode("cells").alias("at", "x")).groupBy("dimension", "at").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation")).orderBy("dimension", "at")
    shape: dict[int, tuple[list, list]] = {}
    for r in spread.collect():
        own = shape.setdefault(r["dimension"], ([], []))
        own[0].append(r["mean"])
        own[1].append(r["deviation"] or 1.0)
    keyed = rows.mapInArrow(_keyed(shape), "vec_id bigint, label bigint, dimension int, cells array<double>, curve binary")
    order = ["dimension", "label", "curve", "vec_id"]
    path = scratch_dir(spark, "negatives-blocks")
    keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("curve").mapInArrow(_block_batches, BLOCK).write.parquet(path)
    return spark.read.schema(BLOCK).parquet(path)


def bounds(questions: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of the scores, questions by blocks, widened by what doubles may lose."""
    plus, minus = np.maximum(questions, 0), np.minimum(questions, 0)
    with np.errstate(all="ignore"):
        upper, lower = plus @ high.T + minus @ low.T, plus @ low.T + minus @ high.T
        slack = 1e-12 * (np.abs(questions) @ np.maximum(np.abs(low), np.abs(high)).T)
        upper, lower = upper + slack, lower - slack
    upper, lower = np.where(np.isnan(upper), np.inf, upper), np.where(np.isnan(lower), -np.inf, lower)
    # scores end there, so bounds beyond it tell no rows apart
    return np.clip(upper, -float(LARGEST), float(LARGEST)), np.clip(lower, -float(LARGEST), float(LARGEST))


def _guaranteed(lower: np.ndarray, rows: np.ndarray, need: int) -> float:
    """The score that ``need`` rows of these blocks have at least."""
    order = np.argsort(-lower, kind="stable")
    reach = np.cumsum(rows[order])
    at = int(np.searchsorted(reach, need))
    return float(lower[order[at]]) if at < len(order) else -np.inf


def _planner(asked, need: int, same: bool):
    """From zone maps, the blocks that a question may have to read."""

    def plan(batches):
        for batch in batches:
            sizes, labels, n = (batch.column(c).to_numpy() for c in ("dimension", "label", "n"))
            for d, (asks, _, own_labels, questions, least, most) in asked.value.items():
                at = np.flatnonzero(sizes == d)
                if not len(at):
                    continue
                low, high = (batch.column(c).take(pa.array(at)).flatten().to_numpy().reshape(-1, d) for c in ("low", "high"))
                upper, lower = bounds(questions, low, high)
                fits = (own_labels[:, None] == labels[at]) == same
                least_f = np.array([-np.inf if x is None else float(x) for x in least])[:, None]
                most_f = np.array([np.inf if x is None else float(x) for x in most])[:, None]
                fits &= (upper >= least_f - np.abs(least_f) * 1e-12) & (lower <= most_f + np.abs(most_f) * 1e-12)
                sure = fits & (lower >= least_f) & (upper <= most_f)
                out = []
                for q in np.flatnonzero(fits.any(axis=1)).tolist():
                    inside = np.flatnonzero(sure[q])
                    read = np.flatnonzero(fits[q] & (upper[q] >= _guaranteed(lower[q, inside], n[at[inside]], need)))
                    out.append((np.full(len(read), asks[q]), at[read], upper[q, read], lower[q, read], np.where(sure[q, read], n[at[read]], 0)))
                if out:
                    ask, block, up, lo, rows = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ask), batch.column("block").take(pa.array(block)), pa.array(up), pa.array(lo), pa.array(rows.astype(np.int32))],
                        names=["ask", "block", "upper", "lower", "sure"])

    return plan


def _opener(asked, k: int):
    """Scores chosen blocks exactly; a question takes at most ``k`` rows from a block."""

    def opened(batches):
        found: list[tuple[int, int, int, int]] = []
        for batch in batches:
            numbers = batch.column("dimension").to_pylist()
            for r, d in enumerate(numbers):
                asks, anchors, _, questions, least, most = asked.value[d]
                wanted = np.searchsorted(asks, np.sort(batch.column("asks")[r].values.to_numpy()))
                ids = batch.column("ids")[r].values.to_numpy()
                rows = batch.column("cells")[r].values.to_numpy().reshape(-1, d)
                for start in range(0, len(wanted), 1024):
                    own = wanted[start : start + 1024]
                    scores = exact_scores(questions[own], rows)
                    for q, score in zip(own.tolist(), scores, strict=True):
                        keep = ids != anchors[q]
                        if least[q] is not None:
                            keep &= np.asarray(score >= least[q], bool) & np.asarray(score <= most[q], bool)
                        at = np.flatnonzero(keep)
                        if len(at) > k and score.dtype != object:
                            # ties of the k-th score come along, so that the smaller ids win
                            at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
                        best = sorted((-int(s), int(i)) for s, i in zip(score[at].tolist(), ids[at].tolist(), strict=True))[:k]
                        found += [(int(asks[q]), i, *parts(-s)) for s, i in best]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["ask", "vec_id", "high", "low"])
                found = []

    return opened


def _packed(rows: list) -> dict:
    """Questions by dimension: numbers (ascending), anchor ids, labels, vectors and score windows."""
    packed = {}
    for d in sorted({len(r["cells"]) for r in rows}):
        own = sorted((r for r in rows if len(r["cells"]) == d), key=lambda r: r["ask"])
        least, most = [], []
        for r in own:
            score = None if r["high"] is None else (r["high"] << SPLIT) + r["low"]
            least.append(None if score is None else -(-LEAST * score // 100))
            most.append(None if score is None else MOST * score // 100)
        packed[d] = (*(np.array([r[c] for r in own], np.int64) for c in ("ask", "anchor_id", "label")),
                     np.array([r["cells"] for r in own], np.float64), least, most)
    return packed


def answers(blocks: DataFrame, questions: DataFrame, same: bool, k: int, ask_bytes: int = ASK_BYTES) -> DataFrame:
    """``ask, vec_id, high, low, rank`` for questions ``ask, anchor_id, label, cells, high, low`` (a window's positive score, or null)."""
    spark = blocks.sparkSession
    questions = staged(questions, "negatives-questions")
    size = questions.agg(F.sum(F.size("cells") * 8 + 64)).first()[0] or 0
    path = scratch_dir(spark, "negatives-found")
    passes = -(-size // ask_bytes)
    need = k + 1 if same else k  # the anchor itself may be in a block of its own label
    for p in range(passes):
        rows = questions.where(F.pmod(F.xxhash64("ask"), F.lit(passes)) == p).collect()
        if not rows:
            continue
        asked = spark.sparkContext.broadcast(_packed(rows))
        planned = blocks.select("block", "dimension", "label", "n", "low", "high").mapInArrow(_planner(asked, need, same), READ)
        planned = staged(planned, "negatives-reads")
        running = F.sum("sure").over(Window.partitionBy("ask").orderBy(F.desc("lower"), "block"))
        floors = planned.where(F.col("sure") > 0).withColumn("reach", running).where(F.col("reach") >= need).groupBy("ask").agg(
            F.max("lower").alias("floor"))
        reads = planned.join(floors, "ask", "left").where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
        # at most the questions of one pass
        by_block = reads.groupBy("block").agg(F.collect_list("ask").alias("asks"))
        chosen = blocks.select("block", "dimension", "ids", "cells").join(by_block, "block")
        chosen.mapInArrow(_opener(asked, k), FOUND).write.mode("append").parquet(path)
        asked.unpersist()
    found = spark.read.schema(FOUND).parquet(path) if passes else spark.createDataFrame([], FOUND)
    best = Window.partitionBy("ask").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, ask_bytes: int = ASK_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows ``vec_id, label, vector``."""
    blocks = write_blocks(vectors)
    rows = vectors.where(is_anchor & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))).select(
        F.col("vec_id").cast("bigint").alias("anchor_id"), F.col("label").cast("bigint").alias("label"), cells(F.col("vector")).alias("cells"))
    nothing = F.lit(None).cast("bigint")
    anchors = staged(rows.distinct().withColumn("ask", F.monotonically_increasing_id()), "negatives-anchors")
    first = answers(blocks, anchors.withColumns({"high": nothing, "low": nothing}), True, positives, ask_bytes)
    near = first.select("ask", F.col("vec_id").alias("positive_id"), "high", "low", F.col("rank").alias("nth"))
    pairs = staged(anchors.join(near, "ask").withColumn("ask", F.col("ask") * positives + F.col("nth") - 1).drop("nth"), "negatives-pairs")
    second = answers(blocks, pairs.select("ask", "anchor_id", "label", "cells", "high", "low"), False, negatives, ask_bytes)
    of_pair = pairs.select("ask", "anchor_id", "positive_id", shown(F.col("high"), F.col("low")).alias("positive_score"))
    return second.select("ask", "rank", F.col("vec_id").alias("negative_id"), shown(F.col("high"), F.col("low")).alias("negative_score")).join(
        of_pair, "ask").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.cast("bigint").alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(vectors, F.col("vec_id") % ANCHOR_EVERY == 0)


OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.vec_id % {ANCHOR_EVERY} = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth
  FROM scored WHERE same),
ranked AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, nth ORDER BY score DESC, vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT same
  WHERE nth <= {POSITIVES} AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {NEGATIVES}
"""
