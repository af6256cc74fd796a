"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its weight's share of all words, at most ``MAX_COPIES`` times its own words; what a
full source cannot take is shared again by weight among the others. Each document of a source then has the
same wished number of copies, ``target / source_size``: its whole part is given, its fraction is a probability.

Pivotal rounding pairs two fractional documents and moves *words* from one to the other at random, up or
down with the chances that keep every expectation, until one of them is at no or one copy. Every duel
keeps the sum of words, so a source ends within the words of its one last document of its target. Duels
run inside chunks of a source (about ``CHUNK_ROWS`` documents, by a hash, largest first); each chunk leaves at
most one undecided document, and those meet again in the next level of a reduction tree of that fan-in.
A source that holds most rows has more chunks, no larger ones: rows without words or without a fraction are
decided where they are read, and equal rows are numbered and dealt to one chunk after the other. Coins are hashes of the seed and the chunk, and
ties in size go by id and the row's hash, so a rerun on any cluster decides alike.

A row is known by its id, source and a hash of all its columns: rows that differ anywhere are mixed apart, and columns
of any name pass through.

Null texts and texts without words have size 0: they take their whole copies and no words. A null source is a
source of its own, the last one. Null and repeated ids are allowed: every row is decided by itself. An
empty table gives an empty result. Sources are one row each in one small table (ordering them by code
point is a single task over that table).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillshard.llm.common import RUN_ROWS, n_words, numbered, row_key, sized, staged, table, with_extras_aside

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
CHUNK_ROWS = 8192
SEED = 42
NONE, ONE, OPEN = 0, 1, -1


def source_targets(items: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: ``source_size``, ``n_open`` (documents with words), ``target``."""
    sources = items.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_open"))
    everyone = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sources.withColumn("weight", F.get(cycle, rank % len(weights))).withColumns({
        "cap": F.lit(float(MAX_COPIES)) * F.col("source_size"),
        "total": F.sum("source_size").over(everyone).cast("double"),
        "weights": F.sum("weight").over(everyone),
    })
    # sources fill up in the order of cap / weight; what the full ones before leave is shared by weight
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    spread = ranked.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    }).withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
    full = F.col("cap") <= F.col("level") * F.col("weight")
    water = F.max(F.when(~full, F.col("level"))).over(everyone)
    return spread.withColumn("target", F.when(full, F.col("cap")).otherwise(water * F.col("weight"))).select(
        "source", "source_size", "n_open", "target")


def pivotal(sizes: np.ndarray, fractions: np.ndarray, coins) -> tuple[np.ndarray, np.ndarray]:
    """Decide all but at most one of the rows, in the given order; the rest keeps its moved fraction."""
    take = np.zeros(len(sizes), dtype=np.int8)
    left = fractions.copy()
    a, pa_, sa = -1, 0.0, 0.0
    for i in np.flatnonzero((fractions > 0) & (sizes > 0)).tolist():
        pb, sb = float(fractions[i]), float(sizes[i])
        if a < 0:
            a, pa_, sa = i, pb, sb
            continue
        to_a = min((1 - pa_) * sa, pb * sb)
        to_b = min(pa_ * sa, (1 - pb) * sb)
        if coins.random() * (to_a + to_b) < to_b:
            if (1 - pa_) * sa <= pb * sb:
                take[a], a, pa_, sa = ONE, i, pb - to_a / sb, sb
            else:
                take[i], pa_ = NONE, pa_ + to_a / sa
        elif pa_ * sa <= (1 - pb) * sb:
            take[a], a, pa_, sa = NONE, i, pb + to_b / sb, sb
        else:
            take[i], pa_ = ONE, pa_ - to_b / sa
        if pa_ <= 1e-12 or pa_ >= 1 - 1e-12:
            take[a], a = (NONE if pa_ < 0.5 else ONE), -1
    if a >= 0:
        take[a], left[a] = OPEN, pa_
    return take, left


def _rounder(seed: int, level: int):
    """The function that rounds one chunk at one level of the tree."""
    return lambda rows: _round_chunk(seed, level, rows)


def _round_chunk(seed: int, level: int, rows: pa.Table) -> pa.Table:
    """One chunk of one source: ``take`` is decided for all rows but at most one."""
    rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending"), ("tie", "ascending")])
    name = repr((seed, level, rows["source"][0].as_py(), rows["chunk"][0].as_py()))
    coins = np.random.default_rng(zlib.crc32(name.encode()))
    take, left = pivotal(rows["size"].to_numpy(), rows["fraction"].to_numpy(), coins)
    rows = rows.set_column(rows.schema.get_field_index("take"), "take", pa.array(take, pa.int32()))
    return rows.set_column(rows.schema.get_field_index("fraction"), "fraction", pa.array(left, pa.float64()))


def row_tie(docs: DataFrame, text: str = "text") -> Column:
    """A hash of the whole row, whatever types its columns have; nulls differ from empty texts."""
    rest = [F.col(c) for c in docs.columns if c != text]
    return F.xxhash64(F.col(text), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}))


def plan_copies(
    docs: DataFrame,
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    chunk_rows: int = CHUNK_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """Per row: ``doc_id, source, tie`` (a hash of the row), ``size, source_size, target, copies``."""
    items = staged(numbered(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        row_tie(docs, text).alias("tie"),
        n_words(F.col(text)).alias("size"),
    ), "copy"), "mix-items")
    targets = staged(source_targets(items, weights), "mix-targets").withColumnRenamed("source", "__s")
    joined = items.join(sized(targets, targets.count()), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    wish = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(wish + 1e-12)
    fraction = F.greatest(wish - base, F.lit(0.0))
    chunks = F.greatest(F.ceil(F.col("n_open") / chunk_rows), F.lit(1))
    rows = joined.select(
        "doc_id", "source", "tie", "size", "source_size", "target",
        base.cast("bigint").alias("base"),
        F.when(fraction < 1e-12, 0.0).otherwise(fraction).alias("fraction"),
        F.pmod(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tie", "size"), chunks) + F.col("copy"), chunks).alias("chunk"),
        F.lit(NONE).alias("take"),
    )
    duels = (F.col("size") > 0) & (F.col("fraction") > 0)
    done, level = [rows.where(~duels)], 0
    rows = rows.where(duels)
    while True:
        step = rows.groupBy("source", "chunk").applyInArrow(_rounder(seed, level), rows.schema)
        step = staged(step, f"mix-level{level}")
        done.append(step.where(F.col("take") != OPEN))
        rows, level = step.where(F.col("take") == OPEN), level + 1
        most = rows.groupBy("source").count().agg(F.max("count").alias("most")).first()["most"] or 0
        if most <= 1:
            break
        # the next level of the tree: neighbouring chunks send what they left undecided to one task
        rows = rows.withColumn("chunk", F.floor(F.col("chunk") / chunk_rows)).select(*step.columns)
    coin = F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id", "tie"), F.lit(1 << 30)) / float(1 << 30)
    done.append(rows.withColumn("take", F.when(coin < F.col("fraction"), ONE).otherwise(NONE)))
    decided = done[0]
    for more in done[1:]:
        decided = decided.union(more)
    return decided.select(
        "doc_id", "source", "tie", "size", "source_size", "target", (F.col("base") + F.col("take")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mixed table: every document as often as the plan takes it, in the input's columns.

    Rows that are equal in all columns are one document with the sum of their copies.
    """
    return with_extras_aside(docs, lambda rows: _mixed(rows, weights))


def _mixed(docs: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    plan = plan_copies(docs, weights=weights).withColumn("__key", row_key("doc_id", "source", "tie"))
    copies = staged(plan.groupBy("__key").agg(
        F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")).where(F.col("__copies") > 0), "mix-copies")
    keyed = docs.withColumn("__key", F.md5(F.to_json(F.struct(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        row_tie(docs).alias("tie")), {"ignoreNullFields": "false"})))
    if not copies.where(F.col("__rows") > 1).isEmpty():
        # equal rows are folded where they are read, so that a row repeated without end does not travel as often
        keyed = keyed.dropDuplicates(["__key"])
    taken = keyed.join(copies, "__key")
    runs = taken.withColumn("__run", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"), F.lit(RUN_ROWS).cast("bigint"))))
    end = F.least(F.col("__run") + RUN_ROWS - 1, F.col("__copies"))
    repeated = runs.withColumn("__copy", F.explode(F.sequence("__run", end)))
    return repeated.select(*docs.columns)


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_copies(table(spark, sf_dir, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
