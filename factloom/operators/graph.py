"""Groups of facts that agree: connected components by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import drop_work, write_work


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root``: each node of the undirected ``edges(a, b)`` with the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, so the number of rounds
    grows with the logarithm of the longest path. Self-loops give a component of one. No edges, no rows.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a is not null and b is not null").distinct()
    links, links_path = write_work(both, "links")
    labels, path = write_work(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(max_rounds):
        near = links.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        hooked = labels.join(near, "node").select("node", "root", F.least("root", "r").alias("new"))
        jump = hooked.join(labels.select(F.col("node").alias("new"), F.col("root").alias("far")), "new").select("node", "root", F.least("new", "far").alias("new"))
        nxt, nxt_path = write_work(jump, "labels")
        changed = nxt.filter("new <> root").isEmpty()
        drop_work(spark, path)
        labels, path = nxt.select("node", F.col("new").alias("root")), nxt_path
        if changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def representatives(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """``fact_id, representative_id``: of each group the fact that arrived first stands for it; a fact without a group stands for itself."""
    placed = facts.select("fact_id", "ingest_seq").join(roots.select(F.col("node").alias("fact_id"), "root"), "fact_id", "left").withColumn("root", F.coalesce("root", "fact_id"))
    first = placed.groupBy("root").agg(F.min(F.struct("ingest_seq", "fact_id")).alias("m")).select("root", F.col("m.fact_id").alias("representative_id"))
    return placed.join(first, "root").select("fact_id", "representative_id")
