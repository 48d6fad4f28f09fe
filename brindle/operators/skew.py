"""Finding heavy keys by sampling, and how evenly work falls on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import partition_id, sampled
from ..functions.text import tokens
from ..plans.lineage import cut


def sample_rows(df: DataFrame, rate: float, seed: int, *identity: str) -> DataFrame:
    """A share ``rate`` of the rows, the same on every run and partitioning."""
    return df.where(sampled(rate, seed, *(F.col(c) for c in identity)))


def sample_key_counts(kvs: DataFrame) -> DataFrame:
    """(k, sample_count) of sampled key-value rows."""
    return kvs.groupBy("k").agg(F.count("*").alias("sample_count"))


def partition_plan(counts: DataFrame, heavy_pct: float, splits: int) -> DataFrame:
    """(k, sample_count, estimated_freq, splits) of heavy keys: at least the share ``heavy_pct`` of all sampled rows, and at least
    one row."""
    total = counts.agg(F.sum("sample_count").alias("total"))
    heavy = counts.crossJoin(F.broadcast(total))  # one row
    least = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(heavy_pct)))
    return heavy.where(F.col("sample_count") >= least).select("k", "sample_count", (F.col("sample_count") / F.col("total")).alias("estimated_freq"), F.lit(splits).alias("splits"))


def heavy_top_k(counts: DataFrame, key: str, count: str, k: int, splits: int) -> DataFrame:
    """The ``k`` most frequent keys, ties by key, with a number of splits."""
    return counts.orderBy(F.desc(count), key).limit(k).withColumn("splits", F.lit(splits))


#: A plan of at most so many keys is broadcast.
MOST_HEAVY = 10_000


def small_plan(plan: DataFrame) -> DataFrame:
    """(k, splits) of a plan, computed once and to be broadcast if it has at most ``MOST_HEAVY`` rows, which is checked. A plan of
    the share p has 2 / p keys at most; one of more rows than that stays a plain table, to be joined by a shuffle."""
    slim = plan.select("k", F.col("splits").cast("int").alias("splits"))
    rows = slim.limit(MOST_HEAVY + 1).collect()
    return F.broadcast(plan.sparkSession.createDataFrame([tuple(r) for r in rows], "k string, splits int")) if len(rows) <= MOST_HEAVY else slim


def split_count(df: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """``df`` with ``splits`` (0: not heavy) and ``is_heavy`` from a plan of (k, splits)."""
    p = small_plan(plan).withColumnRenamed("k", key)
    return df.join(p, key, "left").withColumn("splits", F.coalesce("splits", F.lit(0))).withColumn("is_heavy", F.col("splits") > 0)


def kv_bytes(key: Column, value: Column) -> Column:
    """Bytes of the line ``{"k":...,"v":...}``, with <, > and & as six-byte escapes and line separators as well."""
    line = F.to_json(F.struct(key.alias("k"), value.alias("v")))
    escapes = F.regexp_count(key, F.lit("[<>&]")) * 5 + F.regexp_count(key, F.lit("[\\u2028\\u2029]")) * 3
    return (F.octet_length(line) + escapes).cast("bigint")


def reducer_load(kvs: DataFrame, n: int, salt: str | None = None, size: Column | None = None) -> DataFrame:
    """(reducer, bytes, records) of all ``n`` reducers, those without rows too, before any combining: the logical load, which is
    where skew shows. Equal rows are counted first, so hashes and bytes are worked out once for each; ``size`` gives a row's bytes
    in place of ``kv_bytes``."""
    kvs = kvs.select(F.col("k"), (F.col(salt) if salt else F.lit(None).cast("int")).alias("salt"), (size if size is not None else F.col("v")).alias("v"))
    rows = kvs.groupBy("k", "salt", "v").agg(F.count("*").alias("c"))
    each = F.col("v") if size is not None else kv_bytes(F.col("k"), F.col("v"))
    rows = rows.select(partition_id(F.col("k"), n, F.col("salt") if salt else None).alias("reducer"), "c", (each * F.col("c")).alias("b"))
    load = rows.groupBy("reducer").agg(F.sum("b").cast("bigint").alias("bytes"), F.sum("c").alias("records"))
    every = kvs.sparkSession.range(n).select(F.col("id").cast("int").alias("reducer"))
    return every.join(load, "reducer", "left").fillna(0, ["bytes", "records"])


def coefficient_of_variation(v: Column) -> Column:
    """Population standard deviation over mean; 0 for no rows or a mean of 0."""
    return F.coalesce(F.stddev_pop(v) / F.nullif(F.avg(v), F.lit(0.0)), F.lit(0.0))


def max_median_ratio(v: Column) -> Column:
    """Maximum over median, an even count's median being the integer below the middle; 0 for no rows or a median of 0."""
    return F.coalesce(F.max(v) / F.nullif(F.floor(F.median(v)), F.lit(0)), F.lit(0.0))


def load_metrics(load: DataFrame) -> DataFrame:
    """One row: cov_bytes, cov_records, max_median_bytes, max_median_records."""
    return load.agg(
        coefficient_of_variation(F.col("bytes")).alias("cov_bytes"),
        coefficient_of_variation(F.col("records")).alias("cov_records"),
        max_median_ratio(F.col("bytes")).alias("max_median_bytes"),
        max_median_ratio(F.col("records")).alias("max_median_records"),
    )


def round_robin_salt(kvs: DataFrame, splits: int, key: str, *order: str) -> DataFrame:
    """Salts in exact turns for each key, by ``order``. Rows are cut into ranges of ``order``, numbered within key and range, and moved
    on by what the key has in the ranges before, so no task sees all rows of a key. ``row_salt`` spreads about as well and needs
    no sort."""
    ranged = cut(kvs.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(key, "__range").agg(F.count("*").alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    n = F.row_number().over(Window.partitionBy(key, "__range").orderBy(*order)) - 1
    rows = ranged.withColumn("__n", n).join(counts, [key, "__range"])
    return rows.withColumn("salt", F.pmod(F.col("__n") + F.col("__before"), F.lit(splits)).cast("int")).select(*kvs.columns, "salt")


def map_stats(docs: DataFrame) -> DataFrame:
    """One row: records_processed, kvs_emitted."""
    return docs.agg(F.count("*").alias("records_processed"), F.coalesce(F.sum(F.size(tokens(F.col("text")))), F.lit(0)).cast("bigint").alias("kvs_emitted"))
