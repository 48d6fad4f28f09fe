"""Whole runs from files to files, with metrics and timings."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, generators, graph, pagerank, reducers, skew, wordcount
from ..sources import jsonl, sinks
from .lineage import cut
from .stages import ReducerTimes


@contextmanager
def _timed(times: dict, name: str):
    began = time.perf_counter()
    yield
    times[name] = round((time.perf_counter() - began) * 1000)


def _metrics(load: DataFrame) -> dict:
    load = load.persist()
    try:
        rows = load.orderBy("reducer").collect()
        return {"records": [r["records"] for r in rows], "bytes": [r["bytes"] for r in rows], **skew.load_metrics(load).first().asDict()}
    finally:
        load.unpersist()


def _mode(mode: str) -> None:
    if mode not in ("baseline", "mitigation"):
        raise ValueError("mode is baseline or mitigation")


def run_wordcount(spark: SparkSession, inputs, out: str, mode: str = "baseline", n_reducers: int = 8, sample_rate: float = 0.01, heavy_pct: float = 0.01, splits: int = 8, seed: int = 0) -> dict:
    """Word count of JSON lines. ``mitigation`` samples keys, salts the heavy ones and merges; the counts are the same. They are
    written as a file a reducer."""
    _mode(mode)
    folder, times, summary = sinks.run_folder(spark, out, "wordcount"), {}, {"job": "wordcount", "mode": mode, "reducers": n_reducers}
    docs = jsonl.text_records(spark, inputs, "doc_id")
    plan = None
    if mode == "mitigation":
        with _timed(times, "plan"):
            counts = skew.sample_key_counts(wordcount.emitted(skew.sample_rows(docs, sample_rate, seed, "doc_id")))
            rows = skew.partition_plan(counts, heavy_pct, splits).collect()  # 2 / heavy_pct at most
            summary["heavy_hitters"] = {r["k"]: {"sample_count": r["sample_count"], "estimated_freq": r["estimated_freq"]} for r in rows}
            plan = spark.createDataFrame([(r["k"], r["splits"]) for r in rows], "k string, splits int")
    with _timed(times, "count"), ReducerTimes(spark) as reduced:
        result = wordcount.word_count(docs) if plan is None else wordcount.salted_word_count(docs, plan)
        reducers.write_reduced(result, f"{folder}/final/counts", n_reducers)
    with _timed(times, "metrics"):
        kvs = wordcount.emitted(docs, "doc_id")
        if plan is None:
            load = skew.reducer_load(kvs, n_reducers)
        else:
            load = skew.reducer_load(wordcount.salted(kvs, plan, "doc_id", "pos"), n_reducers, "salt")
        summary["reducer_load"] = _metrics(load)
        summary["reducer_stats"] = [r.asDict() for r in reducers.reducer_stats(kvs, n_reducers).orderBy("reducer").collect()]
        summary["map_stats"] = skew.map_stats(docs).first().asDict()
    summary["reducer_time"], summary["times_ms"] = reduced.summary(), times
    sinks.write_summary(spark, summary, f"{folder}/metrics/run_summary.json")
    return summary | {"folder": folder}


def run_pagerank(
    spark: SparkSession, edges: DataFrame | None, out: str, iterations: int = 10, damping: float = 0.85, mode: str = "baseline", n_reducers: int = 8, heavy_pct: float = 0.01,
    splits: int = 8, num_nodes: int | None = None, plan: DataFrame | None = None, state: DataFrame | None = None, sample_rate: float = 1.0, seed: int = 0,
) -> dict:
    """PageRank of edges (src, dst), or of node states (node, rank, neighbors) from their ranks on; a node with two states is an
    error. ``mitigation`` salts the destinations of ``plan`` (k, splits), or those with at least ``heavy_pct`` of what a sample of
    the nodes sends in a round. Every round is written to the shared folder, and the summary has its times and its load."""
    _mode(mode)
    folder, times, rounds = sinks.run_folder(spark, out, "pagerank"), {}, []
    summary = {"job": "pagerank", "mode": mode, "iterations": iterations, "damping": damping, "reducers": n_reducers, "rounds": rounds}
    initial = None
    if state is not None:
        state = cut(graph.checked_unique(state))
        initial, edges, num_nodes = state.select("node", "rank"), graph.edges_of(state), num_nodes if num_nodes is not None else state.count()
    g = pagerank.prepared(edges, num_nodes)
    if initial is not None:  # nodes without an edge have a state too
        old, g.nodes = g.nodes, g.nodes.union(initial.select("node")).distinct().repartition("node").persist()
        g.nodes.count()
        old.unpersist()
    summary["num_nodes"] = g.n
    try:
        neighbors = g.nodes.join(graph.adjacency(g.edges), "node", "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<string>")))
        ranks = cut(pagerank.first_ranks(g, initial)) if g.n else spark.createDataFrame([], "node string, rank double")
        if mode == "mitigation" and plan is None:
            with _timed(times, "plan"):
                rows = pagerank.sampled_plan(neighbors, sample_rate, seed, heavy_pct, splits).collect()  # 2 / heavy_pct at most
                summary["heavy_hitters"] = {r["k"]: r["sample_count"] for r in rows}
                plan = spark.createDataFrame([(r["k"], r["splits"]) for r in rows], "k string, splits int")
        plan = skew.small_plan(plan) if mode == "mitigation" else None
        for i in range(iterations if g.n else 0):
            took: dict = {}
            with _timed(took, "round"), ReducerTimes(spark) as reduced:
                following = cut(pagerank.step(g, ranks, damping, plan))
            with _timed(took, "metrics"):
                sent = pagerank.round_kvs(neighbors.join(ranks, "node"), plan)
                load = _metrics(skew.reducer_load(sent, n_reducers, "salt"))
            rounds.append({"round": i + 1, "times_ms": took, "reducer_load": load, "reducer_time": reduced.summary()})
            ranks = following
        with _timed(times, "write"):
            sinks.write_states(ranks.join(neighbors, "node"), f"{folder}/final/ranks")
            sinks.write_sorted_ranks(ranks, f"{folder}/final/ranks_sorted")
            summary["rank_sum"] = ranks.agg(F.sum("rank")).first()[0] or 0.0
    finally:
        g.unpersist()
    summary["reducer_load"] = rounds[-1]["reducer_load"] if rounds else None
    summary["times_ms"] = times
    sinks.write_summary(spark, summary, f"{folder}/metrics/run_summary.json")
    return summary | {"folder": folder}


def compare_runs(spark: SparkSession, a: str, b: str) -> dict:
    """Two PageRank runs' folders against the tolerances."""
    x, y = (jsonl.node_states(spark, f"{f}/final/ranks") for f in (a, b))
    return compare.comparison(x, y).first().asDict() | {"only_in_a": compare.only_in(x, y).count(), "only_in_b": compare.only_in(y, x).count()}


def latest_runs(spark: SparkSession, base: str, kind: str, n: int = 2) -> list[str]:
    return [f"{base}/{d}" for d in [d for d in sinks.listed(spark, base) if d.startswith(kind + "_")][-n:]]


def nodes_said(spark: SparkSession, path: str) -> int | None:
    """The number of nodes that the metadata beside a graph's file states, if there are any."""
    said = sinks.read_summary(spark, path.rstrip("/") + ".meta.json")
    return said.get("num_nodes") if said else None


def write_graph(spark: SparkSession, edges: DataFrame, path: str, num_nodes: int, **parameters) -> dict:
    """The edges as text, and beside them ``.meta.json``: nodes, edges, parameters, mean out-degree, top destinations."""
    edges.selectExpr("concat(src, ' ', dst) AS value").write.mode("overwrite").text(path)
    written = jsonl.edge_list(spark, path)
    n = written.count()
    top = {r["dst"]: r["count"] for r in generators.top_destinations(written).collect()}
    meta = {**parameters, "num_nodes": num_nodes, "num_edges": n, "avg_outdegree": n / num_nodes if num_nodes else 0.0, "top_dest_freq": top}
    sinks.write_summary(spark, meta, path.rstrip("/") + ".meta.json")
    return meta


def analyze_heavy(edges: DataFrame, k: int, splits: int) -> dict:
    """{"heavy_nodes": {node: splits}} of the ``k`` destinations of greatest in-degree."""
    top = skew.heavy_top_k(graph.in_degree(edges), "node", "in_degree", k, splits)
    return {"heavy_nodes": {r["node"]: r["splits"] for r in top.collect()}}


def heavy_plan(spark: SparkSession, config: dict) -> DataFrame:
    """(k, splits) of a heavy config."""
    return spark.createDataFrame(list(config.get("heavy_nodes", {}).items()), "k string, splits int")
