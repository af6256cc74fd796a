"""Exact top-k inner-product search by norm-bucketed retrieval.

Vectors become integers, ``floor(SCALE * x)``, and are written in buckets of about ``BUCKET_ROWS`` of similar
length, longest first (a range partitioning on length and id, so a frequent vector or length spreads). Queries
come in blocks of a bounded byte size, which are broadcast one after the other; a block meets all buckets in
parallel, and a bucket is only ever read in its own task.

First a block is held against the bucket of the longest vectors, which gives each query a score that its k-th
best cannot fall below. In every bucket that floor, divided by the query's and the bucket's length, is a local
threshold on the cosine:
* above 1: no vector of the bucket can do it, the query skips the bucket;
* at least ``COORDINATE_COSINE``: coordinate pruning. On the query's ``FOCUS`` largest coordinates, a unit vector with
  that cosine lies in a known interval, so only vectors inside all the intervals are candidates;
* lower: length pruning. Only vectors long enough for the floor, a prefix of the bucket, are candidates.
Candidates are verified by their exact products, and what they score raises the floor for the next bucket of
the task. A task returns at most k rows per query, those that reach the floor; the last step ranks them.

Vectors that are null, empty or hold null or non-finite components, and rows without an id, take no part. Components
may be of any size: lengths and thresholds are doubles, widened by what these may lose, and products are Python integers where doubles
would not be exact. Ranks follow the exact scores, which end at 2**125; a score beyond a long is *shown* as the nearest long. Products are taken
between vectors of one dimension. A repeated candidate row is listed as often as it occurs; a repeated query row
is answered once. Ties go to the smaller id. A query without candidates has no rows; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillshard.llm.common import table
from quillshard.llm.vectors import SCALE, cells, exact_scores, parts, shown, usable
from quillshard.session import scratch_dir

K = 5
QUERY_EVERY = 50
BUCKET_ROWS = 4096
BLOCK_BYTES = 32 << 20
COORDINATE_COSINE = 0.6
FOCUS = 4
FOUND = "query_id bigint, query_no bigint, vec_id bigint, high bigint, low bigint"
_SLACK = 1e-9


def feasible(u: float, t: float) -> tuple[float, float]:
    """Where a coordinate of a unit vector can lie if its cosine with a unit vector that has ``u`` there is at least ``t``."""
    reach = math.sqrt(max(0.0, (1 - t * t) * (1 - u * u)))
    return (-1.0 if -u > t else t * u - reach) - _SLACK, (1.0 if u > t else t * u + reach) + _SLACK


class _Best:
    """The k best of each query so far, and the score its k-th best cannot fall below."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor.copy()
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k and scores.dtype != object:
            # all ties of the k-th score come along, so that the smaller ids win
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= least
            scores, ids = scores[keep], ids[keep]
        own = self.found[q]
        own.extend(zip((-scores).tolist(), ids.tolist(), strict=True))
        own.sort()
        del own[self.k :]
        if len(own) == self.k:
            # as a double that is not above the score
            self.floor[q] = max(self.floor[q], np.nextafter(float(-own[-1][0]), -np.inf))


def search_bucket(queries: np.ndarray, query_ids: np.ndarray, bucket: np.ndarray, ids: np.ndarray, best: _Best) -> dict[str, int]:
    """Hold a block of queries against one bucket; returns how many queries took which way."""
    with np.errstate(over="ignore"):
        lengths = np.sqrt((bucket.astype(np.float64) ** 2).sum(axis=1))
        q_lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    bucket, ids, lengths = bucket[order], ids[order], lengths[order]
    # lengths beyond a double rule nothing out
    measured = math.isfinite(float(lengths[0])) and math.isfinite(float(q_lengths.max()))
    exact = measured and float(lengths[0]) * float(q_lengths.max()) < 2.0**52
    wide = bucket.astype(np.float64)
    with np.errstate(all="ignore"):
        unit = bucket / np.maximum(lengths, 1e-300)[:, None]
        local = best.floor / (q_lengths * lengths[0])
    local = np.where(np.isnan(local) | (not measured), -np.inf, local)
    ways = {"skipped": 0, "coordinate": 0, "length": 0}
    for q in range(len(queries)):
        floor, t = best.floor[q], local[q]
        if t > 1 + _SLACK:
            ways["skipped"] += 1
            continue
        if t >= COORDINATE_COSINE:
            ways["coordinate"] += 1
            u = queries[q] / q_lengths[q]
            t = min(max(t - _SLACK, 0.0), 1.0)
            inside = np.ones(len(ids), dtype=bool)
            for f in np.argsort(-np.abs(u))[:FOCUS]:
                low, high = feasible(float(u[f]), t)
                inside &= (unit[:, f] >= low) & (unit[:, f] <= high)
            at = np.flatnonzero(inside)
        else:
            ways["length"] += 1
            n = len(ids)
            if floor > 0 and measured:
                # lengths fall; those below floor / |q| end the prefix
                n = int(np.searchsorted(-lengths, -(floor / q_lengths[q]) * (1 - _SLACK), side="right"))
            at = slice(0, n)
        near, near_ids = wide[at], ids[at]
        if not len(near_ids):
            continue
        asked = queries[q].astype(np.float64)
        scores = (near @ asked).astype(np.int64) if exact else exact_scores(asked[None], near)[0]
        keep = np.asarray(scores >= floor, bool) & (near_ids != query_ids[q])
        if keep.any():
            best.add(q, scores[keep], near_ids[keep])
    return ways


def _buckets(batches, rows: int):
    """Runs of about ``rows`` rows, whatever the session's batch size."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _searcher(block, k: int, bucket_rows: int):
    """The map function that holds a broadcast block of queries against the buckets of its partition."""

    def search(batches):
        by_dimension = block.value
        best = {d: _Best(len(ids), k, floor) for d, (ids, _, _, floor) in by_dimension.items()}
        for bucket in _buckets(batches, bucket_rows):
            sizes = bucket.column("dimension").to_numpy()
            for d in np.unique(sizes).tolist():
                if d in by_dimension:
                    rows = bucket.filter(pa.array(sizes == d))
                    ids, _, queries, _ = by_dimension[d]
                    vectors = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, d)
                    search_bucket(queries, ids, vectors, rows.column("vec_id").to_numpy(), best[d])
        for d, (ids, numbers, _, _) in by_dimension.items():
            found = [(int(ids[q]), int(numbers[q]), v, *parts(-s)) for q, own in enumerate(best[d].found) for s, v in own]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query_id", "query_no", "vec_id", "high", "low"])

    return search


def write_buckets(vectors: DataFrame, root: str) -> DataFrame:
    """Vectors as written runs: id, integer vector, dimension and squared length, longest first. A task cuts its run into buckets."""
    rows = vectors.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), cells(F.col("vector")).alias("vector"))
    rows = rows.withColumns({
        "dimension": F.size("vector"),
        "squared": F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x),
    })
    rows.repartitionByRange(F.desc("squared"), "vec_id").sortWithinPartitions(F.desc("squared"), "vec_id").write.parquet(root)
    return vectors.sparkSession.read.schema(rows.schema).parquet(root)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, bucket_rows: int = BUCKET_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` (``vec_id, vector``) that are queries."""
    spark = vectors.sparkSession
    buckets = write_buckets(vectors, scratch_dir(spark, "topk-buckets"))
    asked_path = scratch_dir(spark, "topk-queries")
    asked = buckets.where(is_query).dropDuplicates(["vec_id", "vector"]).withColumn("query_no", F.monotonically_increasing_id())
    asked.write.parquet(asked_path)
    asked = spark.read.schema(asked.schema).parquet(asked_path)
    shape = asked.agg(F.count(F.lit(1)).alias("n"), F.max("dimension").alias("d"), F.sum("dimension").alias("cells")).first()
    found_path = scratch_dir(spark, "topk-found")
    # bounds what one broadcast holds, whatever the number of queries
    n_blocks = -(-(shape["cells"] or 0) * 16 // block_bytes)
    longest = buckets.orderBy(F.desc("squared"), "vec_id").limit(bucket_rows)
    seeds = longest.collect() if n_blocks else []
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_no"), F.lit(n_blocks)) == b).orderBy("query_no").collect()
        packed = _pack(rows, seeds, k)
        block = spark.sparkContext.broadcast(packed)
        buckets.select("vec_id", "vector", "dimension").mapInArrow(_searcher(block, k, bucket_rows), FOUND).write.mode("append").parquet(found_path)
        block.unpersist()
    found = spark.read.schema(FOUND).parquet(found_path) if n_blocks else spark.createDataFrame([], FOUND)
    ranked = Window.partitionBy("query_id", "query_no").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", shown(F.col("high"), F.col("low")).alias("score"))


def _pack(rows: list, seeds: list, k: int) -> dict:
    """By dimension: ids, numbers, query matrix and the floors that the longest vectors give."""
    packed = {}
    for d in sorted({r["dimension"] for r in rows}):
        own = [r for r in rows if r["dimension"] == d]
        ids = np.array([r["vec_id"] for r in own], np.int64)
        queries = np.array([r["vector"] for r in own], np.float64)
        best = _Best(len(own), k, np.full(len(own), -np.inf))
        first = [r for r in seeds if r["dimension"] == d]
        if first:
            search_bucket(queries, ids, np.array([r["vector"] for r in first], np.float64), np.array([r["vec_id"] for r in first], np.int64), best)
        packed[d] = (ids, np.array([r["query_no"] for r in own], np.int64), queries, best.floor)
    return packed


def op3_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return top_k(vectors, F.pmod("vec_id", F.lit(QUERY_EVERY)) == 0)


OP3_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.x AS asked, p.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * p.x[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % {QUERY_EVERY} = 0) q JOIN v p ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
