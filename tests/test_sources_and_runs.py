import json

import pytest

from brindle import __main__ as cli
from brindle.operators import graph
from brindle.plans import runs
from brindle.sources import jsonl, sinks
from brindle.streaming import each_record


def test_text_records(spark, tmp_path):
    f = tmp_path / "in.jsonl"
    f.write_text('{"text":"a b"}\n\n{"text":5}\nnot json\n{"other":1}\n{"text":null}\n[1]\n{"text":"' + "x" * 100_000 + '"}\n')
    got = sorted(r["text"] for r in jsonl.text_records(spark, str(f)).collect())
    assert got == ["", "", "a b", "x" * 100_000]


def test_globs_and_listed_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part_{i}.jsonl").write_text(f'{{"k":"w{i}","v":{i}}}\nbroken\n')
    (tmp_path / "list").write_text(f"{tmp_path}/part_0.jsonl\n{tmp_path}/part_2.jsonl\n\n")
    assert jsonl.kv_records(spark, f"{tmp_path}/part_*.jsonl").count() == 3
    paths = jsonl.listed_files(spark, str(tmp_path / "list"))
    assert {(r["k"], r["v"]) for r in jsonl.kv_records(spark, paths).collect()} == {("w0", 0), ("w2", 2)}
    assert jsonl.kv_records(spark, []).count() == 0


def test_edge_list(spark, tmp_path):
    f = tmp_path / "edges.txt"
    f.write_text("# note\na b\n a\tc  extra\nlonely\n\na b\nb b\n")
    assert sorted(tuple(r) for r in jsonl.edge_list(spark, str(f)).collect()) == [("a", "b"), ("a", "b"), ("a", "c"), ("b", "b")]


@pytest.mark.parametrize("wrapped", [True, False])
def test_states_round_trip(spark, tmp_path, wrapped):
    state = graph.initial_state(spark.createDataFrame([("a", 'b"#1'), ("a", "c")], "src string, dst string"))
    sinks.write_states(state, str(tmp_path / "s"), wrapped)
    back = jsonl.node_states(spark, str(tmp_path / "s"))
    key = lambda r: (r["node"], r["rank"], tuple(r["neighbors"]))
    assert sorted(map(key, back.collect())) == sorted(map(key, state.collect()))


def test_bad_node_lines_are_skipped(spark, tmp_path):
    f = tmp_path / "n.jsonl"
    f.write_text('{"node":"A","rank":0.25,"neighbors":["B","C"]}\nnot json\n{"node":"B","rank":0.5}\n{"rank":1}\n')
    assert sorted((r["node"], len(r["neighbors"])) for r in jsonl.node_states(spark, str(f)).collect()) == [("A", 2), ("B", 0)]


def test_each_record(spark):
    seen = []
    assert each_record(spark.range(5), lambda r: seen.append(r["id"])) == 5 and sorted(seen) == list(range(5))


def test_wordcount_runs_agree(spark, tmp_path):
    f = tmp_path / "in.jsonl"
    f.write_text("".join(json.dumps({"text": f"hot hot w{i % 7}"}) + "\n" for i in range(200)))
    a = runs.run_wordcount(spark, str(f), str(tmp_path / "runs"))
    b = runs.run_wordcount(spark, str(f), str(tmp_path / "runs"), "mitigation", sample_rate=1.0, heavy_pct=0.2)
    read = lambda r: sorted(tuple(x) for x in spark.read.json(r["folder"] + "/final/counts").select("k", "v").collect())
    assert read(a) == read(b) and a["map_stats"] == {"records_processed": 200, "kvs_emitted": 600}
    assert list(b["heavy_hitters"]) == ["hot"] and sum(b["reducer_load"]["records"]) == 600
    assert json.load(open(b["folder"] + "/metrics/run_summary.json"))["mode"] == "mitigation"
    with pytest.raises(ValueError):
        runs.run_wordcount(spark, str(f), str(tmp_path), "other")


def test_pagerank_runs_agree_and_the_command_line_works(spark, tmp_path, capsys):
    f = tmp_path / "edges.txt"
    f.write_text("".join(f"n{i} n{(i * i) % 5}\n" for i in range(30)))
    base = str(tmp_path / "runs")
    cli.main(["analyze-heavy", "--edges", str(f), "--out", str(tmp_path / "heavy.json"), "--top-k", "2", "--splits", "3"])
    assert set(json.load(open(tmp_path / "heavy.json"))["heavy_nodes"].values()) == {3}
    for more in (["--mode", "baseline"], ["--mode", "mitigation", "--heavy-config", str(tmp_path / "heavy.json")]):
        cli.main(["pagerank", "--edges", str(f), "--out", base, "--iterations", "3", *more])
    with pytest.raises(SystemExit) as done:
        cli.main(["compare", *runs.latest_runs(spark, base, "pagerank")])
    assert done.value.code == 0 and '"matches": true' in capsys.readouterr().out
    cli.main(["init", "--edges", str(f), "--out", str(tmp_path / "init")])
    assert jsonl.node_states(spark, str(tmp_path / "init")).count() == 30
    cli.main(["generate", "zipf-graph", "--out", str(tmp_path / "g"), "--options", '{"num_nodes": 20, "num_edges": 50}'])
    assert jsonl.edge_list(spark, str(tmp_path / "g")).count() == 50


def test_a_line_repeated_is_many_records(spark, tmp_path):
    """Lines are told apart by their place, so repeats are sampled and salted one by one."""
    f = tmp_path / "same.jsonl"
    f.write_text('{"text":"same words"}\n' * 500)
    docs = jsonl.text_records(spark, str(f), "doc_id")
    assert docs.select("doc_id").distinct().count() == 500
    from brindle.operators import skew, wordcount

    assert 5 < skew.sample_rows(docs, 0.05, 1, "doc_id").count() < 60
    plan = spark.createDataFrame([("same", 8)], "k string, splits int")
    salts = wordcount.salted(wordcount.emitted(docs, "doc_id"), plan, "doc_id", "pos").where("k = 'same'").groupBy("salt").count().collect()
    assert len(salts) == 8 and max(r["count"] for r in salts) < 120


def test_pagerank_from_states_with_metrics_of_each_round(spark, tmp_path):
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * i) % 5}") for i in range(30)], "src string, dst string")
    sinks.write_states(graph.initial_state(edges), str(tmp_path / "s"))
    state = jsonl.node_states(spark, str(tmp_path / "s"))
    a = runs.run_pagerank(spark, None, str(tmp_path / "runs"), 2, state=state)
    b = runs.run_pagerank(spark, edges, str(tmp_path / "runs"), 2, mode="mitigation", sample_rate=0.7, seed=3, heavy_pct=0.05)
    assert runs.compare_runs(spark, a["folder"], b["folder"])["matches"]
    for r in (a, b):
        assert [x["round"] for x in r["rounds"]] == [1, 2]
        for x in r["rounds"]:
            assert sum(x["reducer_load"]["records"]) == 60 and min(x["times_ms"].values()) >= 0
            assert x["reducer_time"]["seconds"] and x["reducer_time"]["cov"] >= 0
    assert sum(a["rounds"][0]["reducer_load"]["bytes"]) != sum(a["rounds"][1]["reducer_load"]["bytes"])
    with pytest.raises(Exception, match="repeated node n1"):
        runs.run_pagerank(spark, None, str(tmp_path / "runs"), 1, state=state.unionByName(state.where("node = 'n1'")))
    assert runs.run_pagerank(spark, edges.limit(0), str(tmp_path / "runs"), 2)["num_nodes"] == 0


def test_command_line_with_states_seeds_and_metadata(spark, tmp_path, capsys):
    out = str(tmp_path / "g")
    cli.main(["generate", "zipf-graph", "--out", out, "--options", '{"num_nodes": 20, "num_edges": 50}'])
    meta = sinks.read_summary(spark, out + ".meta.json")
    assert meta["num_nodes"] == 20 and meta["num_edges"] == 50 and runs.nodes_said(spark, out) == 20
    cli.main(["init", "--edges", out, "--out", str(tmp_path / "i")])
    cli.main(["pagerank", "--input", str(tmp_path / "i"), "--iterations", "1", "--mode", "mitigation", "--sample-rate", "0.5", "--seed", "4", "--out", str(tmp_path / "r")])
    assert '"num_nodes": ' in capsys.readouterr().out.splitlines()[-1]
    (tmp_path / "w.jsonl").write_text('{"text":"a a b"}\n' * 20)
    cli.main(["wordcount", "--input", str(tmp_path / "w.jsonl"), "--mode", "mitigation", "--sample-rate", "0.5", "--seed", "2", "--out", str(tmp_path / "r")])
    said = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert sum(r["records_read"] for r in said["reducer_stats"]) == 60 and said["reducer_time"]["seconds"]
