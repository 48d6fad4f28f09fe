"""Mixing sources to target weights by capped water-filling, and seeded sampling of whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbered, plain
from .tokens import word_count

#: The table of sources is broadcast up to this many; beyond, the join shuffles.
BROADCAST_SOURCES = 10_000


def water_fill(sizes: DataFrame, max_epochs: float, budget_ratio: float | None) -> DataFrame:
    """(source, tokens, weight) in; (source, tokens, weight, epochs) out.

    The level L solves sum(min(max_epochs * tokens, L * weight)) = budget. With sources in the order of the level at which they
    reach their cap, a source is clamped if the budget reaches the fill at that level; what the clamped leave is shared among
    the others by weight. It is where clamping and redistributing in turns ends, without the turns. The budget is
    ``budget_ratio`` times all tokens, or, if that is None, the least at which no source falls below one repetition."""
    cap = max_epochs * F.col("tokens")
    every = Window.partitionBy()
    upto = Window.orderBy("full_at", "source").rowsBetween(Window.unboundedPreceding, 0)
    s = sizes.where("tokens > 0 and weight > 0").withColumn("full_at", cap / F.col("weight"))
    if budget_ratio is None:
        least = F.max(F.col("tokens") / F.col("weight")).over(every)
        s = s.withColumn("least_level", least).withColumn("budget", F.sum(F.least(cap, F.col("least_level") * F.col("weight"))).over(every))
    else:
        s = s.withColumn("budget", budget_ratio * F.sum("tokens").over(every))
    s = s.withColumns({"capped": F.sum(cap).over(upto), "open": F.sum("weight").over(every) - F.sum("weight").over(upto)})
    s = s.withColumn("clamped", F.col("capped") + F.col("full_at") * F.col("open") <= F.col("budget") * (1 + 1e-12))
    s = s.withColumns({"held": F.coalesce(F.sum(F.when(F.col("clamped"), cap)).over(every), F.lit(0.0)), "rest": F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(every)})
    epochs = F.when(F.col("clamped"), F.lit(float(max_epochs))).otherwise((F.col("budget") - F.col("held")) * F.col("weight") / F.col("rest") / F.col("tokens"))
    return s.select("source", "tokens", "weight", epochs.alias("epochs"))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def plan_mix(docs: DataFrame, weights: dict[str, float] | None, alpha: float, max_epochs: float, budget_ratio: float | None) -> DataFrame:
    sizes = docs.groupBy("source").agg(F.sum("n").alias("tokens"))
    if weights is None:
        weight = F.pow(F.col("tokens").cast("double"), F.lit(float(alpha)))
    else:
        given = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(given[F.col("source")].cast("double"), F.lit(0.0))
    return water_fill(sizes.withColumn("tokens", F.col("tokens").cast("double")).withColumn("weight", weight), max_epochs, budget_ratio)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, max_epochs: float = 4.0, budget_ratio: float | None = None, seed: int = 1, copy_column: str | None = None) -> DataFrame:
    """``docs``, each row as many times as its source's epochs say: the whole part always, the fraction by a hash of seed,
    source and doc_id, so a retried task draws alike. Needs doc_id, source and text; keeps all columns and adds ``copy_column``
    (1, 2, ...) if it is named, in place of a column of that name.

    ``weights`` are target shares by source, in any unit; sources that they don't name get none and go. Without them a source
    weighs its tokens to the power ``alpha``. A null source is the source "". Rows with no words (null, empty) weigh nothing
    and are sampled with their source; a source without any word goes. Rows with the same doc_id and source share one draw.
    An empty table gives no rows."""
    spark = docs.sparkSession
    slim = plain(docs, "source", "text").select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), word_count(F.col("text")).alias("n"))
    plan = plan_mix(slim, weights, alpha, max_epochs, budget_ratio).select("source", "epochs")
    rows = plan.limit(BROADCAST_SOURCES + 1).collect()  # checked: a row a source
    if len(rows) <= BROADCAST_SOURCES:
        plan = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in rows], "source string, epochs double"))
    plan = plan.select(F.col("source").alias("of"), "epochs")
    inner, (source, doc_id) = numbered(docs, "source", "doc_id")
    out = inner.join(plan, F.coalesce(F.col(source).cast("string"), F.lit("")) == F.col("of"))
    whole = F.floor("epochs")
    copies = (whole + (uniform(seed, F.col(source), F.col(doc_id)) < F.col("epochs") - whole).cast("int")).cast("int")
    kept = [i for i, c in enumerate(docs.columns) if c != copy_column]
    out = out.withColumn("copies", copies).where("copies > 0").select(*(f"c{i}" for i in kept), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    names = [docs.columns[i] for i in kept]
    return out.toDF(*names, copy_column) if copy_column else out.drop("copy").toDF(*names)
