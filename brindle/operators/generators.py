"""Skewed texts and graphs to try things on. Every value comes from a hash of the seed and the row, so a retried task agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _uniform(seed: int, *keys: Column) -> Column:
    """52 bits of an MD5, as a number in [0, 1)."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _by_table(spark: SparkSession, rows: DataFrame, u: str, n: int, s: float, v: float, name: str) -> DataFrame:
    """``rows`` with ``name``: a Zipf index 1..n for the uniform column ``u``, by a table of buckets joined on u's bucket and a
    range inside it."""
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    t = spark.range(n).select((F.col("id") + 1).cast("int").alias("i"), F.pow(F.lit(v) + F.col("id"), F.lit(-s)).alias("w"))
    t = t.withColumn("hi", F.sum("w").over(w) / F.sum("w").over(Window.partitionBy()))
    t = t.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("i")), F.lit(0.0))).withColumn("hi", F.when(F.col("i") == n, F.lit(1.0)).otherwise(F.col("hi")))
    t = t.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * n), F.least(F.floor(F.col("hi") * n), F.lit(n - 1))))).select("cell", "lo", "hi", F.col("i").alias(name))
    rows = rows.withColumn("__cell", F.floor(F.col(u) * n))
    return rows.join(t, (F.col("__cell") == F.col("cell")) & (F.col(u) >= F.col("lo")) & (F.col(u) < F.col("hi"))).drop("__cell", "cell", "lo", "hi", u)


def word(i: Column) -> Column:
    return F.concat(F.lit("w"), F.lpad(i.cast("string"), 6, "0"))


def node(i: Column) -> Column:
    return F.concat(F.lit("n"), F.lpad(i.cast("string"), 6, "0"))


def _texts(words: DataFrame) -> DataFrame:
    return words.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "w"))).alias("ws")).select("id", F.concat_ws(" ", F.transform("ws", lambda s: s["w"])).alias("text"))


def _places(spark: SparkSession, n_records: int, words_per_record: int) -> DataFrame:
    return spark.range(n_records).select("id", F.explode(F.sequence(F.lit(0), F.lit(words_per_record - 1))).alias("pos"))


def zipf_text(spark: SparkSession, n_records: int = 10_000, vocab_size: int = 1_000, zipf_s: float = 1.1, zipf_v: float = 1.0, words_per_record: int = 20, seed: int = 0) -> DataFrame:
    """(id, text) with words of Zipf frequencies."""
    if min(n_records, vocab_size, words_per_record) < 1 or zipf_s <= 0 or zipf_v < 1:
        raise ValueError("counts must be positive, zipf_s above 0, zipf_v at least 1")
    places = _places(spark, n_records, words_per_record).withColumn("u", _uniform(seed, F.col("id"), F.col("pos")))
    words = _by_table(spark, places, "u", vocab_size, zipf_s, zipf_v, "i")
    return _texts(words.select("id", "pos", word(F.col("i")).alias("w")))


def hot_key_text(spark: SparkSession, n_records: int = 10_000, vocab_size: int = 1_000, hot_frac: float = 0.5, words_per_record: int = 20, seed: int = 0, hot: str = "HOT") -> DataFrame:
    """(id, text) in which one word takes the share ``hot_frac``; the others are uniform."""
    if min(n_records, vocab_size, words_per_record) < 1 or not 0 <= hot_frac <= 1:
        raise ValueError("counts must be positive and hot_frac between 0 and 1")
    p = _places(spark, n_records, words_per_record)
    other = word(F.floor(_uniform(seed + 1, F.col("id"), F.col("pos")) * vocab_size) + 1)
    return _texts(p.select("id", "pos", F.when(_uniform(seed, F.col("id"), F.col("pos")) < hot_frac, F.lit(hot)).otherwise(other).alias("w")))


_BUCKETS = 4096


def _first_ids(edges: DataFrame, want: int, span: int) -> DataFrame:
    """The ``want`` edges of least id, ids lying below ``span``. A count by ranges of ids, 4096 at most, finds the range in which the
    last of them lies, so only that one range is sorted."""
    width = -(-span // _BUCKETS)
    bucket = F.floor(F.col("id") / width)
    left, last = want, 0
    for r in edges.groupBy(bucket.alias("b")).count().orderBy("b").collect():
        last = r["b"]
        if left <= r["count"]:
            break
        left -= r["count"]
    return edges.where(bucket < last).unionByName(edges.where(bucket == last).orderBy("id").limit(left)).select("src", "dst")


def _distinct_edges(draw, want: int, most: int, every) -> DataFrame:
    """``want`` distinct edges of ``draw(count)``, which is asked for more until there are enough. Where 64 draws for each possible
    edge aren't, as in the tail of a steep distribution, the rest comes from ``every()``, all edges there can be."""
    if want > most:
        raise ValueError(f"{want} distinct edges asked of {most}")
    count = 2 * want
    while True:
        edges = draw(count).where("src <> dst").groupBy("src", "dst").agg(F.min("id").alias("id"))
        if count > 64 * most:
            rest = every().join(edges, ["src", "dst"], "left_anti").withColumn("id", F.col("id") + count)
            return _first_ids(edges.unionByName(rest), want, count + most + 1)
        if edges.count() >= want:
            return _first_ids(edges, want, count)
        count *= 2


def _every(spark: SparkSession, num_nodes: int, lo: int, n: int):
    """Edges from each of ``num_nodes`` nodes to each of the ``n`` after the first ``lo``, loops left out, numbered in a mixed order."""

    def run() -> DataFrame:
        e = spark.range(num_nodes * n).select((F.col("id") % num_nodes + 1).alias("s"), (F.floor(F.col("id") / num_nodes) + 1 + lo).alias("d")).where("s <> d")
        return e.select(node(F.col("s")).alias("src"), node(F.col("d")).alias("dst"), F.pmod(F.xxhash64("s", "d"), F.lit(num_nodes * n)).alias("id"))

    return run


def zipf_graph(spark: SparkSession, num_nodes: int = 1_000, num_edges: int = 10_000, zipf_s: float = 1.1, zipf_v: float = 1.0, seed: int = 0) -> DataFrame:
    """(src, dst): uniform sources, Zipf destinations, no self-loops, no repeated edges, exactly ``num_edges`` of them."""

    def draw(count: int) -> DataFrame:
        rows = spark.range(count).select("id", (F.floor(_uniform(seed, F.col("id")) * num_nodes) + 1).alias("s"), _uniform(seed + 1, F.col("id")).alias("u"))
        return _by_table(spark, rows, "u", num_nodes, zipf_s, zipf_v, "d").select("id", node(F.col("s")).alias("src"), node(F.col("d")).alias("dst"))

    return _distinct_edges(draw, num_edges, num_nodes * (num_nodes - 1), _every(spark, num_nodes, 0, num_nodes))


def hot_node_graph(spark: SparkSession, num_nodes: int = 1_000, num_edges: int = 10_000, num_hot_nodes: int = 3, hot_edge_frac: float = 0.8, seed: int = 0) -> DataFrame:
    """(src, dst): the share ``hot_edge_frac`` of the edges goes to the first ``num_hot_nodes`` nodes, the rest to the others."""
    if not 0 < num_hot_nodes < num_nodes or not 0 <= hot_edge_frac <= 1:
        raise ValueError("there must be hot and other nodes, and hot_edge_frac between 0 and 1")
    hot = round(num_edges * hot_edge_frac)

    def draw(lo: int, n: int, salt: int):
        return lambda count: spark.range(count).select("id", node(F.floor(_uniform(seed + salt, F.col("id")) * num_nodes) + 1).alias("src"), node(F.floor(_uniform(seed + salt + 1, F.col("id")) * n) + 1 + lo).alias("dst"))

    rest = num_nodes - num_hot_nodes
    to_hot = _distinct_edges(draw(0, num_hot_nodes, 10), hot, num_hot_nodes * (num_nodes - 1), _every(spark, num_nodes, 0, num_hot_nodes))
    to_rest = _distinct_edges(draw(num_hot_nodes, rest, 20), num_edges - hot, rest * (num_nodes - 1), _every(spark, num_nodes, num_hot_nodes, rest))
    return to_hot.unionByName(to_rest)


def top_destinations(edges: DataFrame, n: int = 10) -> DataFrame:
    """(dst, count) of the most frequent destinations."""
    return edges.groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(n)


def hot_node_counts(edges: DataFrame, hot: list[str]) -> DataFrame:
    """(dst, count) of the nodes ``hot``, the most frequent first; those without an edge are left out."""
    return edges.where(F.col("dst").isin(hot)).groupBy("dst").count().orderBy(F.desc("count"), "dst")


def graph_metadata(edges: DataFrame) -> dict:
    """Counts of nodes and edges, the mean out-degree and the top destinations."""
    r = edges.agg(F.count("*").alias("e"), F.countDistinct("src").alias("s")).first()
    n = edges.select(F.explode(F.array("src", "dst")).alias("n")).distinct().count()
    return {"num_nodes": n, "num_edges": r["e"], "avg_outdegree": r["e"] / n if n else 0.0, "top_dest_freq": {x["dst"]: x["count"] for x in top_destinations(edges).collect()}}
