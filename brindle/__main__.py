"""python -m brindle COMMAND: wordcount, pagerank, init, analyze-heavy, generate, compare."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import generators, graph
from .plans import runs
from .sources import jsonl, sinks


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="brindle")
    sub = p.add_subparsers(dest="command", required=True)
    w = sub.add_parser("wordcount")
    w.add_argument("--input", required=True)
    g = sub.add_parser("pagerank")
    source = g.add_mutually_exclusive_group(required=True)
    source.add_argument("--edges", help="an edge list")
    source.add_argument("--input", help="node states, bare or wrapped")
    g.add_argument("--iterations", type=int, default=10)
    g.add_argument("--damping", type=float, default=0.85)
    g.add_argument("--num-nodes", type=int, help="default: what <input>.meta.json says, else the number of nodes there are")
    g.add_argument("--heavy-config")
    for x in (w, g):
        x.add_argument("--out", default="runs")
        x.add_argument("--mode", choices=("baseline", "mitigation"), default="baseline")
        x.add_argument("--reducers", type=int, default=8)
        x.add_argument("--sample-rate", type=float, default=0.01)
        x.add_argument("--seed", type=int, default=0)
        x.add_argument("--heavy-pct", type=float, default=0.01)
        x.add_argument("--splits", type=int, default=8)
    i = sub.add_parser("init")
    i.add_argument("--edges", required=True)
    i.add_argument("--out", required=True)
    a = sub.add_parser("analyze-heavy")
    a.add_argument("--edges", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--top-k", type=int, default=10)
    a.add_argument("--splits", type=int, default=8)
    n = sub.add_parser("generate")
    n.add_argument("kind", choices=("zipf-text", "hot-key-text", "zipf-graph", "hot-node-graph"))
    n.add_argument("--out", required=True)
    n.add_argument("--options", default="{}", help="JSON of the generator's arguments")
    c = sub.add_parser("compare")
    c.add_argument("runs", nargs="*")
    c.add_argument("--base", default="runs")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("brindle").getOrCreate()

    if args.command == "wordcount":
        print(json.dumps(runs.run_wordcount(spark, args.input, args.out, args.mode, args.reducers, args.sample_rate, args.heavy_pct, args.splits, args.seed)))
    elif args.command == "pagerank":
        plan = runs.heavy_plan(spark, sinks.read_summary(spark, args.heavy_config) or {}) if args.heavy_config else None
        n = args.num_nodes if args.num_nodes is not None else runs.nodes_said(spark, args.edges or args.input)
        edges = jsonl.edge_list(spark, args.edges) if args.edges else None
        state = jsonl.node_states(spark, args.input) if args.input else None
        print(json.dumps(runs.run_pagerank(spark, edges, args.out, args.iterations, args.damping, args.mode, args.reducers, args.heavy_pct, args.splits, n, plan, state, args.sample_rate, args.seed)))
    elif args.command == "init":
        state = graph.initial_state(jsonl.edge_list(spark, args.edges))
        sinks.write_states(state, args.out)
        sinks.write_summary(spark, {"num_nodes": jsonl.node_states(spark, args.out).count(), "source_input_path": args.edges}, args.out.rstrip("/") + ".meta.json")
    elif args.command == "analyze-heavy":
        sinks.write_summary(spark, runs.analyze_heavy(jsonl.edge_list(spark, args.edges), args.top_k, args.splits), args.out)
    elif args.command == "generate":
        options = json.loads(args.options)
        made = {"zipf-text": generators.zipf_text, "hot-key-text": generators.hot_key_text, "zipf-graph": generators.zipf_graph, "hot-node-graph": generators.hot_node_graph}[args.kind](spark, **options)
        if args.kind.endswith("text"):
            made.select("text").write.mode("overwrite").json(args.out)
        else:
            print(json.dumps(runs.write_graph(spark, made, args.out, options.pop("num_nodes", 1_000), **options)))
    else:
        a, b = args.runs or runs.latest_runs(spark, args.base, "pagerank")
        result = runs.compare_runs(spark, a, b)
        print(json.dumps(result))
        raise SystemExit(0 if result["matches"] else 1)


if __name__ == "__main__":
    main()
