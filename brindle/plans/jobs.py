"""What a map-reduce job is here, and the registry of jobs."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import pagerank, skew


class Job(Protocol):
    """``map`` turns records into rows (k, v); ``combine`` is an algebraic aggregate of v, the same before and after the shuffle
    and for salted partial results; ``finish`` makes the result of the aggregated rows (k, v)."""

    name: str
    supports_salting: bool

    def map(self, records: DataFrame) -> DataFrame: ...
    def combine(self, v: Column) -> Column: ...
    def finish(self, reduced: DataFrame) -> DataFrame: ...


@dataclass
class WordCount:
    name: str = "wordcount"
    supports_salting: bool = True

    def map(self, records: DataFrame) -> DataFrame:
        return records.select(F.explode(tokens(F.col("text"))).alias("k"), F.lit(1).cast("bigint").alias("v"))

    def combine(self, v: Column) -> Column:
        return F.sum(v)

    def finish(self, reduced: DataFrame) -> DataFrame:
        return reduced.select("k", "v")


@dataclass
class PageRank:
    """One round; records are (node, rank, neighbors). The number of nodes is required."""

    name: str = "pagerank"
    supports_salting: bool = True
    parameters: dict[str, Any] = field(default_factory=lambda: {"damping": 0.85})

    def map(self, records: DataFrame) -> DataFrame:
        sent = pagerank.contributions(records).select(F.col("dst").alias("k"), F.col("amount").alias("v"))
        return sent.unionByName(records.select(F.col("node").alias("k"), F.lit(0.0).alias("v")))

    def combine(self, v: Column) -> Column:
        return F.sum(v)

    def finish(self, reduced: DataFrame) -> DataFrame:
        if "num_nodes" not in self.parameters:
            raise ValueError("pagerank needs num_nodes")
        return reduced.select(F.col("k").alias("node"), pagerank.damped(F.col("v"), self.parameters["damping"], self.parameters["num_nodes"]).alias("rank"))


REGISTRY: dict[str, type] = {"wordcount": WordCount, "pagerank": PageRank}


def register(name: str, job: type) -> None:
    REGISTRY[name] = job


def get(name: str, **parameters: Any) -> Job:
    if name not in REGISTRY:
        raise KeyError(f"no job named {name}; there are {', '.join(sorted(REGISTRY))}")
    job = REGISTRY[name]()
    if parameters:
        job.parameters = {**getattr(job, "parameters", {}), **parameters}
    return job


def run(job: Job, records: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """The job's result; with a plan (k, splits) of heavy keys by way of partial results of (k, salt), which gives the same."""
    kvs = job.map(records)
    if plan is not None and job.supports_salting:
        # the salt is the number of the task that emits the row, taken before any shuffle: a retried task keeps it
        kvs = kvs.withColumn("task", F.spark_partition_id()).join(skew.small_plan(plan), "k", "left")
        kvs = kvs.withColumn("salt", F.when(F.col("splits") > 0, F.pmod(F.col("task"), F.col("splits"))))
        kvs = kvs.groupBy("k", "salt").agg(job.combine(F.col("v")).alias("v"))
    return job.finish(kvs.groupBy("k").agg(job.combine(F.col("v")).alias("v")))
