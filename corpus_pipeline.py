"""The corpus pipeline: documents in, packed training windows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import mixing, neardup, packing, pii, toxicity
from brindle.llm.shared import read, removed, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels`` and the texts of ``docs``, rejects go. Documents with a null text stay,
    as do all where ``labels`` lack a class; empty texts are judged by their all-zero features; of repeated rows all go or stay;
    an empty table stays empty. Columns are kept, whatever their names."""
    return toxicity.without_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id; of rows equal in id and text one. Null ids and
    texts are no copies of anything but such rows; texts without a word only of equal ones; an empty table stays empty."""
    return neardup.deduplicated(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; no document goes. Null and empty texts stay as they are, repeated rows
    are redacted alike, an empty table stays empty."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated towards weights of tokens ** 0.7, four times at most; the budget is the least at which none falls
    below one repetition, so every document stays. A null source is the source ""; documents without a word are repeated with
    their source, but a source without any word goes; rows of one id and source share one draw; an empty table stays empty."""
    return mixing.mixed(docs, alpha=0.7, max_epochs=4.0, budget_ratio=None, seed=1)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 words in the proportions that the mix has. Documents without a word (null, empty) fill nothing and have no
    row; null ids and repeated rows are packed like others; an empty table gives no windows."""
    return packing.packed(docs, window=2048, alpha=1.0, seed=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: A trained classifier and near-duplicate groups have no SQL; tests/llm hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again by the next; each is deleted once
    the next is written, the last but one with the windows' own queue."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    windows = STAGES[-1][1](spark, docs, sf_dir)
    removed(spark, before)  # packing reads its queue from here on
    return windows
