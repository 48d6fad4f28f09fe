"""Mixture-controlled packing of documents into windows by deficit round-robin over source queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, plain, written
from .tokens import word_count

#: Credits are counted in this fraction of a token, so quanta need not be whole tokens.
UNIT = 1024
#: Rounds in a block of the second running total.
ROUNDS_A_BLOCK = 4096


def _running(df: DataFrame, group: list[str], block: str, order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of ``group`` up to this one, by block and order. Blocks are summed apart,
    then offset by the sums of the blocks before them: no task sorts a whole group."""
    inner = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__in", F.sum(value).over(inner))
    offsets = df.groupBy(*group, block).agg(F.sum(value).alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    return local.join(offsets, [*group, block]).withColumn(name, F.col("__in") + F.col("__before")).drop("__in", "__before")


def packed(docs: DataFrame, window: int = 2048, weights: dict[str, float] | None = None, alpha: float = 1.0, seed: int = 1, tokens: str | None = None) -> DataFrame:
    """(window_id, position, source, doc_id, doc_start, n_tokens): the pieces of documents that fill each window, by position.

    Deficit round-robin: a round gives every source that has documents left a credit of its share of ``window`` tokens; the
    source serves documents from the head of its queue as long as its credit covers them, and carries what is left over to the
    next round. A queue's order is a seeded hash of doc_id and of the number of the copy. The stream that the rounds serve is cut
    into windows of exactly ``window`` tokens (the last may be shorter), so a document splits only where a window ends, and
    deviations from the shares don't add up. As a source's credit by round k is k quanta, the round that serves a document
    follows from the running total of its queue, and the place in the stream from a second running total, by round: both are
    summed over blocks, so counters carry over every window and partition although no task sees them all.

    Shares are ``weights``, or the sources' tokens to the power ``alpha``; sources that ``weights`` doesn't name get the least
    credit there is. ``tokens`` names a column of counts; without it words are counted. Null sources are the source "". Rows
    without tokens (null or empty texts, null or negative counts) fill nothing and give no row. Null ids and repeated rows are
    packed like others. An empty table gives no rows. Extra columns are ignored."""
    counted = tokens or "text"
    n = word_count(F.col(counted)) if tokens is None else F.greatest(F.coalesce(F.col(counted).cast("bigint"), F.lit(0)), F.lit(0))
    rows = plain(docs, "source", "doc_id", counted).select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"), n.alias("n")).where("n > 0")
    copy = F.row_number().over(Window.partitionBy("doc_id", "source").orderBy("n"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), copy.cast("string")))
    # slim rows, written once: the texts are read and counted a single time
    scratch = Scratch(docs.sparkSession)
    rows = scratch.written(rows.withColumn("key", key).withColumn("slot", F.substring("key", 1, 3)), "pack-rows")

    sizes = rows.groupBy("source").agg(F.sum("n").alias("tokens"))
    if weights is None:
        weight = F.pow(F.col("tokens").cast("double"), F.lit(float(alpha)))
    else:
        given = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(given[F.col("source")].cast("double"), F.lit(0.0))
    sizes = sizes.withColumn("weight", weight)
    share = F.col("weight") / F.greatest(F.sum("weight").over(Window.partitionBy()), F.lit(1e-300))
    quanta = sizes.select("source", F.greatest(F.lit(1), F.round(share * (window * UNIT))).cast("bigint").alias("quantum"))

    queue = _running(rows, ["source"], "slot", ["key", "n"], "n", "upto").join(quanta, "source")
    queue = queue.withColumn("round", F.expr(f"(upto * {UNIT} + quantum - 1) div quantum - 1")).withColumn("block", F.expr(f"round div {ROUNDS_A_BLOCK}"))
    queue = written(queue.select("source", "doc_id", "n", "upto", "round", "block"), "pack-queue")
    scratch.drop(rows)
    stream = _running(queue.withColumn("all", F.lit(0)), ["all"], "block", ["round", "source", "upto"], "n", "end").withColumn("start", F.expr("end - n"))
    piece = stream.select("source", "doc_id", "start", "end", F.explode(F.expr(f"sequence(start div {window}, (end - 1) div {window})")).alias("window_id"))
    lo, hi = F.greatest("start", F.col("window_id") * window), F.least("end", (F.col("window_id") + 1) * window)
    return piece.select("window_id", (lo - F.col("window_id") * window).alias("position"), "source", "doc_id", (lo - F.col("start")).alias("doc_start"), (hi - lo).alias("n_tokens"))
