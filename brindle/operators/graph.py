"""Graphs from edges: nodes, degrees, initial states and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nodes(edges: DataFrame) -> DataFrame:
    """(node): every source and destination once."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def in_degree(edges: DataFrame) -> DataFrame:
    """(node, in_degree) of every destination; repeated edges count."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))


def adjacency(edges: DataFrame, position: str | None = None) -> DataFrame:
    """(node, neighbors) of every source, in the order of ``position`` or of the neighbours."""
    if position:
        kept = F.transform(F.sort_array(F.collect_list(F.struct(position, "dst"))), lambda s: s["dst"])
    else:
        kept = F.sort_array(F.collect_list("dst"))
    return edges.groupBy(F.col("src").alias("node")).agg(kept.alias("neighbors"))


def initial_state(edges: DataFrame, num_nodes: int | None = None) -> DataFrame:
    """(node, rank, neighbors): ranks 1/N, no neighbours for sinks. N is the number of nodes unless it is given."""
    every = nodes(edges)
    state = every.join(adjacency(edges), "node", "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<string>")))
    if num_nodes is None:
        n = every.agg(F.count("*").alias("n"))
        return state.crossJoin(F.broadcast(n)).select("node", (F.lit(1.0) / F.col("n")).alias("rank"), "neighbors")  # one row
    return state.select("node", F.lit(1.0 / num_nodes).alias("rank"), "neighbors")


def edges_of(state: DataFrame) -> DataFrame:
    """(src, dst) of node states, an edge for each occurrence of a neighbour."""
    return state.select(F.col("node").alias("src"), F.explode("neighbors").alias("dst"))


def checked_unique(state: DataFrame) -> DataFrame:
    """``state``, which fails at run time if a node has two rows."""
    n = F.count("*").over(Window.partitionBy("node"))
    return state.withColumn("__n", n).withColumn("node", F.when(F.col("__n") == 1, F.col("node")).otherwise(F.raise_error(F.concat(F.lit("repeated node "), "node")))).drop("__n")
