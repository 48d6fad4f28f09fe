"""Shared-folder scratch tables, lineage cuts and small plan helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a plain ``local[...]`` session gets a temporary folder of
    its own; any other master is refused, since its executors share no machine-local folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, folder[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/brindle-{name}-{uuid.uuid4().hex}"


def plain(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, the first of each where several share the name: nothing else can clash."""
    at = [df.columns.index(n) for n in names]
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*(F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)))


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns called c0, c1, ..., and what the named ones are called there; ``toDF(*df.columns)`` names them back."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), [f"c{df.columns.index(n)}" for n in names]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, and no lineage behind it."""
    return Scratch(df.sparkSession).written(df, name)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path in whatever file system it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of the shared folder that are needed on the way to a result only: at the end of a ``with`` they are deleted. What the
    result itself reads is written apart."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)  # keeps the id in use
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            removed(self.spark, self.paths.pop(id(t))[0])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*(t for _, t in self.paths.values()))


def join_skewed(rows: DataFrame, table: DataFrame, key: list[str], count: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and in ``count`` (dropped) how many of ``rows`` hold it. Keys with a
    thousandth of all rows or more, a thousand at most, are joined by broadcast where the rows are; only the others are shuffled."""
    total = table.agg(F.sum(count)).first()[0] or 0
    hot, rest = table.where(F.col(count) * 1000 >= total).drop(count), table.where(F.col(count) * 1000 < total).drop(count)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def cut(df: DataFrame) -> DataFrame:
    """``df`` by an eager reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
