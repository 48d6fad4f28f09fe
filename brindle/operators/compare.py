"""Comparing two sets of ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORTED, TOLERATED = 1e-6, 1e-5


def rank_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node, rank_a, rank_b, difference) of every node of either side; a missing rank is 0."""
    x, y = a.select("node", F.col("rank").alias("rank_a")), b.select("node", F.col("rank").alias("rank_b"))
    return x.join(y, "node", "full_outer").fillna(0.0, ["rank_a", "rank_b"]).withColumn("difference", F.abs(F.col("rank_a") - F.col("rank_b")))


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node) of ``a`` that ``b`` lacks."""
    return a.select("node").join(b.select("node"), "node", "left_anti").distinct()


def comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: nodes, reported (differences over 1e-6), largest, matches (none over 1e-5)."""
    d = rank_differences(a, b)
    return d.agg(F.count("*").alias("nodes"), F.count_if(F.col("difference") > REPORTED).alias("reported"), F.coalesce(F.max("difference"), F.lit(0.0)).alias("largest"), F.coalesce(F.max("difference") <= TOLERATED, F.lit(True)).alias("matches"))
