"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillshard.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``a, b`` links; ``comp`` is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours and then the label of that label (pointer
    jumping), so rounds grow with the logarithm of a component's diameter. A node with many links only
    adds rows to joins and to a minimum, which combines before its shuffle.
    """
    edges = staged(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct(), "component-edges")
    labels = staged(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")), "component-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), F.col("comp").alias("theirs")), "other")
        best = near.groupBy("node").agg(F.min("theirs").alias("best"))
        hooked = labels.join(best, "node").select("node", F.least("comp", "best").alias("next"), "comp")
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("jumped"))
        moved = staged(
            hooked.join(jump, "next").select("node", F.least("next", "jumped").alias("comp"), F.col("comp").alias("was")),
            "component-labels")
        if moved.where(F.col("comp") != F.col("was")).isEmpty():
            return moved.drop("was")
        labels = moved.drop("was")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links. Only the components that these links tie together are worked on again."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    alone = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("comp"))
    known = staged(labels.select("node", "comp").union(alone), "component-known")
    tied = links.join(known.toDF("a", "ca"), "a").join(known.toDF("b", "cb"), "b").where(F.col("ca") != F.col("cb"))
    pairs = tied.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    merged = components(pairs).toDF("comp", "into")
    return staged(known.join(merged, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")), "component-labels")
