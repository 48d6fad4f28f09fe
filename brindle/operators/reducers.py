"""Reducers as partitions: keys placed by CRC32, a file and statistics for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import partition_id
from .skew import kv_bytes


def combined(kvs: DataFrame) -> DataFrame:
    """(k, v, records, bytes): sums of v by key with how many rows went in and the bytes of their lines."""
    rows = kvs.groupBy("k", "v").agg(F.count("*").alias("c"))
    return rows.groupBy("k").agg(F.sum(F.col("v") * F.col("c")).alias("v"), F.sum("c").alias("records"), F.sum(kv_bytes(F.col("k"), F.col("v")) * F.col("c")).alias("bytes"))


def placed(df: DataFrame, n: int, key: str = "k") -> DataFrame:
    """``df`` in ``n`` partitions, each row in the one that the CRC32 of its key names."""
    return df.repartitionById(n, partition_id(F.col(key), n))


def reducer_stats(kvs: DataFrame, n: int) -> DataFrame:
    """(reducer, bytes_read, records_read, records_written) of all ``n`` reducers."""
    rows = combined(kvs).groupBy(partition_id(F.col("k"), n).alias("reducer")).agg(F.sum("bytes").cast("bigint").alias("bytes_read"), F.sum("records").alias("records_read"), F.count("*").alias("records_written"))
    every = kvs.sparkSession.range(n).select(F.col("id").cast("int").alias("reducer"))
    return every.join(F.broadcast(rows), "reducer", "left").fillna(0)  # n rows at most


def write_reduced(counts: DataFrame, path: str, n: int) -> None:
    """(k, v) as JSON lines, a file a reducer; the number in a file's name is the reducer's."""
    placed(counts.select("k", "v"), n).write.mode("overwrite").json(path)


def read_reduced(spark, path: str) -> DataFrame:
    """(k, v, reducer) of what ``write_reduced`` wrote."""
    number = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("int")
    return spark.read.schema("k string, v bigint").json(path).select("k", "v", number.alias("reducer"))
