"""JSON-lines sinks, run folders and summaries."""

from __future__ import annotations

import json
import logging
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("brindle")


def _opened(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A file in whatever file system the path names, as Spark's own writers do."""
    where, fs = _opened(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a file; None if there is none."""
    where, fs = _opened(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(where) else None


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order."""
    where, fs = _opened(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def run_folder(spark: SparkSession, base: str, kind: str) -> str:
    """A new folder for a run; the name has a random part, so runs that start in one second don't meet."""
    path = f"{base}/{kind}_{time.strftime('%Y%m%d_%H%M%S')}_{uuid.uuid4().hex[:8]}"
    for part in ("final", "metrics"):
        where, fs = _opened(spark, f"{path}/{part}")
        fs.mkdirs(where)
    log.info("run folder %s", path)
    return path


def write_counts(df: DataFrame, path: str) -> None:
    """(k, v) as JSON lines."""
    df.select("k", "v").write.mode("overwrite").json(path)


def write_states(df: DataFrame, path: str, wrapped: bool = True) -> None:
    """(node, rank, neighbors) as JSON lines, wrapped as ``{"text": ...}`` or bare."""
    node = F.struct("node", "rank", "neighbors")
    out = df.select(F.to_json(F.struct(F.to_json(node).alias("text"))).alias("value")) if wrapped else df.select(F.to_json(node).alias("value"))
    out.write.mode("overwrite").text(path)


def write_sorted_ranks(df: DataFrame, path: str) -> None:
    """(node, rank) as JSON lines from the highest rank on."""
    df.select("node", "rank").orderBy(F.desc("rank"), "node").write.mode("overwrite").json(path)


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    write_text(spark, json.dumps(summary, indent=2, sort_keys=True), path)
    log.info("summary written to %s", path)


def read_summary(spark: SparkSession, path: str) -> dict | None:
    text = read_text(spark, path)
    return None if text is None else json.loads(text)
