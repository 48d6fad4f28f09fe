"""Word count, plain and with hot keys spread over salts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import row_salt
from ..functions.text import tokens
from .skew import small_plan


def emitted(docs: DataFrame, *carry: str) -> DataFrame:
    """(*carry, pos, k, v): one row with v = 1 for each token of ``text``."""
    return docs.select(*carry, F.posexplode(tokens(F.col("text"))).alias("pos", "k")).withColumn("v", F.lit(1).cast("bigint"))


def word_count(docs: DataFrame) -> DataFrame:
    """(k, v). Counts are combined before the shuffle, so a hot key costs one row a task."""
    return docs.select(F.explode(tokens(F.col("text"))).alias("k")).groupBy("k").agg(F.count("*").alias("v"))


def salted(kvs: DataFrame, plan: DataFrame, *identity: str) -> DataFrame:
    """``kvs`` with a salt for the heavy keys of ``plan`` (k, splits), null for others. Rows get it where they are, before any
    shuffle, as long as the plan is small enough to be broadcast."""
    joined = kvs.join(small_plan(plan), "k", "left")
    return joined.withColumn("salt", F.when(F.col("splits") > 0, row_salt(F.col("splits"), *(F.col(c) for c in identity)))).drop("splits")


def unsalted(partials: DataFrame) -> DataFrame:
    """(k, v) of partial counts by (k, salt)."""
    return partials.groupBy("k").agg(F.sum("v").alias("v"))


def salted_word_count(docs: DataFrame, plan: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The same as ``word_count``, by way of partial counts of (k, salt)."""
    kvs = salted(emitted(docs, id_column), plan, id_column, "pos")
    return unsalted(kvs.groupBy("k", "salt").agg(F.sum("v").alias("v")))


def top_words(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("v"), "k").limit(n)
