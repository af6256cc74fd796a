"""Minimum-cost-flow resharding: move the fewest bytes from old shards to new capacities.

A sharded table is a folder of files, ``shard=S/block=B``; blocks are hash classes of a shard of about
``BLOCK_BYTES``. From the byte sizes of the old shards and the capacities of the new ones, a minimum-cost flow on
the graph of shards (staying costs nothing, a moved byte costs one) says how many bytes go where. Each old
shard's bytes are then cut, in the order of its blocks, into the runs of that flow. A block inside one run moves or
stays whole; only the few blocks that a cut crosses (at most one per edge of the flow) are split by rows, and
rewritten. Blocks that stay are not read for writing at all: the new table is the manifest of kept blocks, the folder of moved rows
and the folder of what stays of crossed blocks. ``read_resharded`` needs nothing else, so the old folders of
blocks that the manifest does not name can be deleted.

The flow graph has one node per shard and lives on the driver; block tables and rows stay in Spark. Running
sums go by block first (one row per block) and then inside one block, so no task ever holds a shard, and
shards and blocks are hashes of the id and text, so hot sources and groups of copies spread.

Sizes are UTF-8 bytes of the text plus ``ROW_BYTES``, so a null text has the size ``ROW_BYTES``. Null ids are hashed like
any value. Repeated rows are separate rows with separate slots. An empty table gives an empty result. Further columns pass
through; one that bears a name of this module (``RESERVED``, in any case) is stored as ``original_`` and its name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillshard.llm.common import sized, staged, table
from quillshard.session import scratch_dir

OLD_SHARDS = 16
NEW_SHARDS = 24
ROW_BYTES = 8
BLOCK_BYTES = 64 << 20
MIN_BLOCKS = 8
# Fixed-width rows of the table of blocks (one row per block) up to which it is broadcast.
FATE_ROWS = 4_000_000
# Beside the folder of moved rows: what stays of crossed blocks, and the manifest of kept blocks.
CUT, KEPT = "-cut", "-kept"
RESERVED = ("shard", "block", "old_shard", "moved", "slot", "__size", "__tie", "__to", "__start", "__first", "__last", "__n", "__before")


def row_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest flow from supplies to capacities by successive shortest augmenting paths.

    ``cost(i, j)`` is the price per byte from old shard i to new shard j. Needs sum(supply) <= sum(capacity). Shards
    are few: the graph has len(supply) * len(capacity) edges.
    """
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(capacity)
    n, m = len(supply), len(capacity)
    while any(left):
        # Bellman-Ford over old shards (0..n-1) and new shards (n..n+m-1) in the residual graph
        distance = [0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        parent: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if distance[i] + cost(i, j) < distance[n + j]:
                        distance[n + j], parent[n + j], changed = distance[i] + cost(i, j), i, True
            for (i, j), units in flow.items():
                if units and distance[n + j] - cost(i, j) < distance[i]:
                    distance[i], parent[i], changed = distance[n + j] - cost(i, j), n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: distance[n + j])
        path, at = [], n + end
        while parent[at] is not None:
            path.append((parent[at], at))
            at = parent[at]
        units = min(left[at], room[end], *[flow[(b, a - n)] for a, b in path if a >= n])
        for a, b in path:
            edge = (a, b - n) if a < n else (b, a - n)
            flow[edge] = flow.get(edge, 0) + (units if a < n else -units)
        left[at] -= units
        room[end] -= units
    return {edge: units for edge, units in flow.items() if units}


@dataclass(frozen=True)
class Run:
    """Bytes ``start`` to ``end`` of an old shard, in its block order, belong to the shard ``to``."""

    shard: int
    start: int
    end: int
    to: int


def plan_runs(old_sizes: list[int], capacities: list[int]) -> list[Run]:
    """The flow as runs; what stays comes first, so that whole leading blocks keep their place."""
    flow = min_cost_flow(old_sizes, capacities, lambda i, j: 0 if i == j else 1)
    runs = []
    for i in range(len(old_sizes)):
        at = 0
        for j, units in sorted(((j, u) for (k, j), u in flow.items() if k == i), key=lambda x: (x[0] != i, x[0])):
            runs.append(Run(i, at, at + units, j))
            at += units
    return runs


def set_aside(docs: DataFrame) -> DataFrame:
    """Give columns that bear a reserved name another one."""
    taken = {c.lower() for c in docs.columns} | set(RESERVED)
    names = []
    for name in docs.columns:
        if name.lower() in RESERVED:
            name = f"original_{name}"
            while name.lower() in taken:
                name = f"original_{name}"
            taken.add(name.lower())
        names.append(name)
    return docs.toDF(*names)


def write_sharded(docs: DataFrame, root: str, n_shards: int = OLD_SHARDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write a table of hash shards and blocks, one file per block; returns the written table.

    ``__size`` and ``__tie`` (a hash of the text) are stored with each row, so that planning reads no text.
    """
    docs = set_aside(docs)
    total = docs.agg(F.sum(row_size())).first()[0] or 0
    blocks = max(MIN_BLOCKS, -(-total // (n_shards * block_bytes)))
    placed = docs.withColumns({"__size": row_size(), "__tie": F.xxhash64("text")}).withColumns({
        "shard": F.pmod(F.xxhash64("doc_id", "__tie"), F.lit(n_shards)).cast("int"),
        "block": F.pmod(F.xxhash64(F.lit("block"), "doc_id", "__tie"), F.lit(blocks)).cast("int"),
    })
    placed.repartition("shard", "block").write.partitionBy("shard", "block").option("compression", "zstd").parquet(root)
    return docs.sparkSession.read.schema(placed.schema).parquet(root)


def _interval(shard: Column, at: Column, runs: list[Run]) -> Column:
    """The new shard of byte ``at``; the runs number at most one per edge of a spanning forest of shards."""
    to = F.lit(None).cast("int")
    by_shard: dict[int, list[Run]] = {}
    for run in runs:
        by_shard.setdefault(run.shard, []).append(run)
    for old, own in by_shard.items():
        inside = F.lit(own[-1].to)
        for run in reversed(own[:-1]):
            inside = F.when(at < run.end, run.to).otherwise(inside)
        to = F.when(shard == old, inside).otherwise(to)
    return to


def reshard(old: DataFrame, moved_root: str, n_new: int = NEW_SHARDS) -> DataFrame:
    """Reshard a table of ``write_sharded`` to equal byte capacities; returns the resharded rows.

    Rows that move are written under ``moved_root``, what stays of a crossed block and the manifest of kept blocks beside it; kept
    blocks stay in their old files. ``shard`` is the new shard; ``old_shard`` and ``block`` name where a row was, ``moved``
    whether it left.
    """
    spark = old.sparkSession
    sizes = staged(old.groupBy("shard", "block").agg(F.sum("__size").alias("bytes")), "shards-sizes")
    by_shard = {
        r["shard"]: r for r in sizes.groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
    }
    n_blocks = sum(r["n"] for r in by_shard.values())
    old_sizes = [by_shard[i]["bytes"] if i in by_shard else 0 for i in range(max(by_shard, default=-1) + 1)]
    share, more = divmod(sum(old_sizes), n_new)
    runs = plan_runs(old_sizes, [share + (j < more) for j in range(n_new)])
    blocks = sizes.withColumn("end", F.sum("bytes").over(Window.partitionBy("shard").orderBy("block")))
    first = _interval(F.col("shard"), F.col("end") - F.col("bytes"), runs)
    last = _interval(F.col("shard"), F.col("end") - 1, runs)
    fate = blocks.select(
        "shard", "block", (F.col("end") - F.col("bytes")).alias("__start"), first.alias("__first"), last.alias("__last"))
    fate = staged(fate, "shards-fate")
    rows = old.join(sized(fate, n_blocks, FATE_ROWS), ["shard", "block"])
    whole = rows.where(F.col("__first") == F.col("__last")).withColumn("__to", F.col("__first"))
    # a block that a cut crosses: the row's middle byte decides
    inside = Window.partitionBy("shard", "block").orderBy("__tie", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("__start") + F.coalesce(F.sum("__size").over(inside), F.lit(0)) + F.floor(F.col("__size") / 2)
    crossed = rows.where(F.col("__first") != F.col("__last")).withColumn("__to", _interval(F.col("shard"), middle, runs))
    whole, crossed = (r.drop("__start", "__first", "__last").withColumnRenamed("shard", "old_shard") for r in (whole, crossed))
    goes = F.col("__to") != F.col("old_shard")
    for written, place in ((whole.unionByName(crossed).where(goes), moved_root), (crossed.where(~goes), moved_root + CUT)):
        written.write.partitionBy("__to").option("compression", "zstd").parquet(place)
    kept = fate.where((F.col("__first") == F.col("shard")) & (F.col("__last") == F.col("shard")))
    kept.select("shard", "block").write.parquet(moved_root + KEPT)
    return read_resharded(old, moved_root)


def read_resharded(old: DataFrame, moved_root: str) -> DataFrame:
    """The table that ``reshard`` left under ``moved_root``, with the kept blocks of the table it came from."""
    spark = old.sparkSession
    kept = spark.read.schema("shard int, block int").parquet(moved_root + KEPT)
    stay = old.join(sized(kept, kept.count(), FATE_ROWS), ["shard", "block"]).withColumn("old_shard", F.col("shard"))
    fields = [T.StructField("old_shard" if f.name == "shard" else f.name, f.dataType) for f in old.schema]
    schema = T.StructType([*fields, T.StructField("__to", T.IntegerType())])
    rows = stay.withColumn("moved", F.lit(False))
    for place, moved in ((moved_root + CUT, False), (moved_root, True)):
        written = spark.read.schema(schema).parquet(place).withColumnRenamed("__to", "shard")
        rows = rows.unionByName(written.withColumn("moved", F.lit(moved)))
    return rows


def with_slots(rows: DataFrame) -> DataFrame:
    """``slot``, gapless from 0 in a shard: rows of earlier pieces first, a piece being what one old block gave."""
    piece = ["shard", "old_shard", "block"]
    counts = rows.groupBy(*piece).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*piece, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy(*piece).orderBy("doc_id", "__tie")
    numbered = rows.join(offsets, piece).withColumn("slot", F.col("__before") + F.row_number().over(order) - 1)
    return numbered.drop("__before")


def op6_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = write_sharded(table(spark, sf_dir, "documents"), scratch_dir(spark, "shards-old"))
    rows = reshard(old, scratch_dir(spark, "shards-moved")).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.lit(None).cast("int").alias("grown_shard"),
        "moved", "old_shard", "block", "__tie",
    )
    # the slots need two passes over these short rows, not over the resharding
    return with_slots(staged(rows, "shards-light")).drop("__tie")
