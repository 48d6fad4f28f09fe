"""PageRank by rounds, plain and with hot destinations spread over salts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import source_salt
from ..plans.lineage import cut
from . import graph, skew
from .skew import small_plan


def contributions(state: DataFrame) -> DataFrame:
    """(src, dst, amount): rank over out-degree for each occurrence of a neighbour. Sinks give nothing."""
    return state.select(F.col("node").alias("src"), F.explode("neighbors").alias("dst"), (F.col("rank") / F.size("neighbors")).alias("amount"))


def damped(total, damping: float, num_nodes: int):
    return F.lit((1 - damping) / num_nodes) + F.lit(damping) * F.coalesce(total, F.lit(0.0))


def sums(contrib: DataFrame) -> DataFrame:
    """(node, total), partial sums first."""
    return contrib.groupBy(F.col("dst").alias("node")).agg(F.sum("amount").alias("total"))


def salted_sums(contrib: DataFrame, plan: DataFrame) -> DataFrame:
    """(node, total) by way of undamped partial sums of (dst, salt), for the heavy destinations of ``plan`` (k, splits)."""
    joined = contrib.join(plan.withColumnRenamed("k", "dst"), "dst", "left")
    joined = joined.withColumn("salt", F.when(F.col("splits") > 0, source_salt(F.col("src"), F.col("splits"))))
    partial = joined.groupBy("dst", "salt").agg(F.sum("amount").alias("amount"))
    return sums(partial)


@dataclass
class Prepared:
    """``nodes`` (node) by node and ``edges`` (src, dst, degree) by source, both kept; ``n`` is the number of nodes that ranks are
    shared among. An edge is a row, so a source may have any number of them."""

    nodes: DataFrame
    edges: DataFrame
    n: int

    def unpersist(self) -> None:
        self.nodes.unpersist()
        self.edges.unpersist()


def prepared(edges: DataFrame, num_nodes: int | None = None) -> Prepared:
    edges = edges.select("src", "dst")
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    kept = edges.join(degree, "src").repartition("src").persist()
    nodes = graph.nodes(edges).repartition("node").persist()
    return Prepared(nodes, kept, num_nodes if num_nodes is not None else nodes.count())


def step(g: Prepared, ranks: DataFrame, damping: float, plan: DataFrame | None = None) -> DataFrame:
    """(node, rank) after one round. Nodes without contributions keep (1 - d) / N."""
    contrib = g.edges.join(ranks.withColumnRenamed("node", "src"), "src").select("src", "dst", (F.col("rank") / F.col("degree")).alias("amount"))
    total = sums(contrib) if plan is None else salted_sums(contrib, plan)
    return g.nodes.join(total, "node", "left").select("node", damped(F.col("total"), damping, g.n).alias("rank"))


def first_ranks(g: Prepared, initial: DataFrame | None = None) -> DataFrame:
    """(node, rank) before the first round: 1/N, or ``initial`` (node, rank), 0 for nodes that it lacks."""
    if initial is None:
        return g.nodes.select("node", F.lit(1.0 / g.n).alias("rank"))
    return g.nodes.join(initial.select("node", "rank"), "node", "left").fillna(0.0, ["rank"])


def pagerank(edges: DataFrame, iterations: int, damping: float = 0.85, num_nodes: int | None = None, plan: DataFrame | None = None, cut_every: int = 4, initial: DataFrame | None = None) -> DataFrame:
    """(node, rank) after ``iterations`` rounds from 1/N or ``initial``. Mass of sinks isn't given to others, so ranks may sum to
    less than 1.

    Edges are kept by source and nodes by node, and sums arrive by node: one exchange a round. The lineage is cut every
    ``cut_every`` rounds and at the end, when what was kept is given up."""
    spark: SparkSession = edges.sparkSession
    g = prepared(edges, num_nodes)
    try:
        if not g.n:
            return spark.createDataFrame([], "node string, rank double")
        plan = None if plan is None else small_plan(plan)
        ranks = first_ranks(g, initial)
        for i in range(iterations):
            ranks = step(g, ranks, damping, plan)
            if (i + 1) % cut_every == 0 and i + 1 < iterations:
                ranks = cut(ranks)
        return cut(ranks)
    finally:
        g.unpersist()


def round_kvs(state: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """(k, salt, v) of what a round sends to its reducers, uncombined: every node's adjacency and every contribution, as JSON."""
    sent = contributions(state).select(F.col("dst").alias("k"), "src", F.to_json(F.struct(F.lit("contribution").alias("type"), "amount")).alias("v"))
    if plan is not None:
        sent = sent.join(small_plan(plan), "k", "left").withColumn("salt", F.when(F.col("splits") > 0, source_salt(F.col("src"), F.col("splits"))))
    else:
        sent = sent.withColumn("salt", F.lit(None).cast("int"))
    kept = state.select(F.col("node").alias("k"), F.lit(None).cast("int").alias("salt"), F.to_json(F.struct(F.lit("adjacency").alias("type"), "neighbors")).alias("v"))
    return sent.select("k", "salt", "v").unionByName(kept)


def sampled_plan(state: DataFrame, rate: float, seed: int, heavy_pct: float, splits: int) -> DataFrame:
    """The plan (k, sample_count, estimated_freq, splits) of the keys that take a share ``heavy_pct`` of what a sample of the nodes
    sends, their own adjacency among it."""
    sample = skew.sample_rows(state, rate, seed, "node")
    sent = graph.edges_of(sample).select(F.col("dst").alias("k")).unionByName(sample.select(F.col("node").alias("k")))
    return skew.partition_plan(skew.sample_key_counts(sent), heavy_pct, splits)


def sorted_ranks(ranks: DataFrame) -> DataFrame:
    return ranks.orderBy(F.desc("rank"), "node")
