"""JSON-lines sources with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KV = "k string, salt int, v bigint"
NODE = "node string, rank double, neighbors array<string>"


def lines(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Lines of files, folders or globs; blank lines are dropped. There is no limit on a line's length."""
    given = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.text(given) if given else spark.createDataFrame([], "value string")
    return df.where(F.length("value") > 0)


def listed_files(spark: SparkSession, list_path: str) -> list[str]:
    """The paths in a file that names one a line."""
    return [r["value"] for r in spark.read.text(list_path).where("trim(value) <> ''").collect()]


def _text_of(line: Column) -> tuple[Column, Column]:
    v = F.try_parse_json(line)
    text = F.try_variant_get(v, "$.text", "variant")
    kind = F.schema_of_variant(v)
    fits = v.isNotNull() & (kind.startswith("OBJECT") | (kind == "VOID")) & (text.isNull() | F.schema_of_variant(text).isin("STRING", "VOID"))
    return fits, F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit(""))


def text_records(spark: SparkSession, paths: str | Iterable[str], id_column: str | None = None) -> DataFrame:
    """(text), with a number of each line in ``id_column`` if it is named, of lines ``{"text": ...}``. A line that isn't a JSON object, or whose text isn't a string, is skipped; a missing or
    null text is empty."""
    fits, text = _text_of(F.col("value"))
    # taken as lines are read: the place in the file's split, which a retried task sees again
    numbered = lines(spark, paths).withColumn("__id", F.monotonically_increasing_id())
    return numbered.where(fits).select(*([F.col("__id").alias(id_column)] if id_column else []), text.alias("text"))


def kv_records(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """(k, salt, v) of key-value lines; lines that don't decode, or lack a key, are skipped."""
    return lines(spark, paths).select(F.from_json("value", KV).alias("r")).where("r.k is not null").select("r.*")


def node_of(text: Column) -> Column:
    """A node record from its JSON; null if it doesn't decode or lacks a node. Missing neighbours are an empty array."""
    r = F.from_json(text, NODE)
    full = F.struct(r["node"].alias("node"), F.coalesce(r["rank"], F.lit(0.0)).alias("rank"), F.coalesce(r["neighbors"], F.array().cast("array<string>")).alias("neighbors"))
    return F.when(r["node"].isNotNull(), full)


def node_states(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """(node, rank, neighbors) of node lines, bare or wrapped as ``{"text": "<node JSON>"}``."""
    wrapped = F.get_json_object("value", "$.text")
    return lines(spark, paths).select(node_of(F.coalesce(wrapped, F.col("value"))).alias("n")).where("n is not null").select("n.*")


def edge_list(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """(src, dst) of lines of two fields or more between white space; other lines and ``#`` comments are skipped. Self-loops and
    repeated edges stay."""
    parts = F.split(F.trim("value"), r"(?U)\s+")
    rows = lines(spark, paths).where(~F.trim("value").startswith("#")).select(F.filter(parts, lambda p: p != "").alias("p"))
    return rows.where(F.size("p") >= 2).select(F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"))


def sharded(df: DataFrame, n: int) -> DataFrame:
    """Rows dealt round robin over ``n`` partitions."""
    return df.repartition(n)
