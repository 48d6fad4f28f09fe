import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import compare, generators, graph, pagerank


def _edges(spark, *pairs):
    return spark.createDataFrame([*pairs], "src string, dst string")


def _power(pairs, rounds, d=0.85):
    nodes = sorted({x for p in pairs for x in p})
    out = {n: [b for a, b in pairs if a == n] for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        new = dict.fromkeys(nodes, (1 - d) / len(nodes))
        for a in nodes:
            for b in out[a]:
                new[b] += d * rank[a] / len(out[a])
        rank = new
    return rank


def _ranks(df):
    return {r["node"]: r["rank"] for r in df.collect()}


ODD = [("a", "a"), ("a", "b"), ("a", "b"), ("b", "c"), ("d#1", "c"), ("c", "sink"), ("x", "a")]


def test_round_by_hand(spark):
    state = spark.createDataFrame([("A", 1.0, []), ("B", 1.0, ["A", "C"])], "node string, rank double, neighbors array<string>")
    assert {(r["src"], r["dst"], r["amount"]) for r in pagerank.contributions(state).collect()} == {("B", "A", 0.5), ("B", "C", 0.5)}
    total = spark.createDataFrame([(0.8,), (None,)], "t double").select(pagerank.damped(F.col("t"), 0.85, 4).alias("r")).collect()
    assert total[0]["r"] == pytest.approx(0.7175, abs=1e-9) and total[1]["r"] == pytest.approx(0.0375, abs=1e-9)


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_pagerank_with_loops_repeats_and_sinks(spark, rounds):
    got = _ranks(pagerank.pagerank(_edges(spark, *ODD), rounds))
    assert got == pytest.approx(_power(ODD, rounds), abs=1e-12)
    if rounds:
        assert sum(got.values()) < 1


@pytest.mark.parametrize("splits", [0, 1, 5])
def test_salted_pagerank_equals_plain(spark, splits):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.choice([0, 0, 0, rng.randrange(30)])}") for _ in range(200)]
    plan = spark.createDataFrame([("n0", splits), ("n1", splits)], "k string, splits int")
    assert _ranks(pagerank.pagerank(_edges(spark, *pairs), 5, plan=plan)) == pytest.approx(_power(pairs, 5), abs=1e-12)


def test_pagerank_of_no_edges(spark):
    assert pagerank.pagerank(_edges(spark).limit(0), 3).count() == 0


def test_given_number_of_nodes(spark):
    got = _ranks(pagerank.pagerank(_edges(spark, ("a", "b")), 1, num_nodes=10))
    assert got == pytest.approx({"a": 0.015, "b": 0.015 + 0.85 * 0.1})


def test_degrees_state_and_back(spark):
    e = _edges(spark, *ODD)
    assert {r["node"]: r["in_degree"] for r in graph.in_degree(e).collect()} == {"a": 2, "b": 2, "c": 2, "sink": 1}
    state = graph.checked_unique(graph.initial_state(e))
    rows = {r["node"]: (r["rank"], list(r["neighbors"])) for r in state.collect()}
    assert rows["a"] == (1 / 6, ["a", "b", "b"]) and rows["sink"] == (1 / 6, [])
    assert sorted(map(tuple, graph.edges_of(state).collect())) == sorted(ODD)


def test_repeated_nodes_are_refused(spark):
    twice = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "node string, rank double")
    with pytest.raises(Exception, match="repeated node a"):
        graph.checked_unique(twice).collect()


def test_comparison(spark):
    rows = lambda *r: spark.createDataFrame([*r], "node string, rank double")
    a, b = rows(("x", 0.5), ("y", 0.2)), rows(("x", 0.5 + 5e-6), ("z", 0.1))
    c = compare.comparison(a, b).first()
    assert (c["nodes"], c["reported"], c["matches"]) == (3, 3, False) and c["largest"] == pytest.approx(0.2)
    assert compare.comparison(a, a).first()["matches"] and [r["node"] for r in compare.only_in(a, b).collect()] == ["y"]


def test_zipf_text(spark):
    df = generators.zipf_text(spark, 2000, 200, 1.1, 1.0, 10, 3)
    words = [w for r in df.collect() for w in r["text"].split()]
    assert df.count() == 2000 and len(words) == 20000
    want = [(1 + i) ** -1.1 for i in range(200)]
    assert words.count("w000001") / len(words) == pytest.approx(want[0] / sum(want), rel=0.1)
    assert words.count("w000010") / len(words) == pytest.approx(want[9] / sum(want), rel=0.25)


def test_hot_key_text(spark):
    words = [w for r in generators.hot_key_text(spark, 1000, 50, 0.3, 10).collect() for w in r["text"].split()]
    assert words.count("HOT") / len(words) == pytest.approx(0.3, abs=0.02) and len(set(words)) == 51


def test_graphs(spark):
    for g, hot in ((generators.zipf_graph(spark, 200, 2000), None), (generators.hot_node_graph(spark, 200, 2000, 5, 0.4), 800)):
        rows = [tuple(r) for r in g.collect()]
        assert len(rows) == len(set(rows)) == 2000 and all(a != b for a, b in rows)
        if hot:
            assert sum(b <= "n000005" for _, b in rows) == hot
    meta = generators.graph_metadata(generators.zipf_graph(spark, 100, 500))
    assert meta["num_edges"] == 500 and next(iter(meta["top_dest_freq"])) == "n000001"


def test_impossible_graphs_are_refused(spark):
    with pytest.raises(ValueError):
        generators.zipf_graph(spark, 3, 7)
    with pytest.raises(ValueError):
        generators.hot_node_graph(spark, 3, 2, 3)


def test_thin_tails_give_every_edge(spark):
    """Under a steep distribution draws alone would hardly ever find the last edges."""
    rows = [tuple(r) for r in generators.zipf_graph(spark, 12, 12 * 11, zipf_s=6.0).collect()]
    assert len(rows) == len(set(rows)) == 132 and all(a != b for a, b in rows)
    rows = [tuple(r) for r in generators.hot_node_graph(spark, 6, 30, 2, 10 / 30).collect()]
    assert len(set(rows)) == 30


def test_first_ids_are_the_least(spark):
    edges = spark.range(10_000).selectExpr("id", "cast(id as string) src", "'x' dst").where("id % 3 = 0")
    got = sorted(int(r["src"]) for r in generators._first_ids(edges, 1000, 10_000).collect())
    assert got == list(range(0, 3000, 3))


def test_ranks_from_given_ones(spark):
    e = _edges(spark, *ODD)
    after = pagerank.pagerank(e, 2)
    assert _ranks(pagerank.pagerank(e, 3, initial=after)) == pytest.approx(_power(ODD, 5), abs=1e-12)
