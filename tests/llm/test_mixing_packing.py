import hashlib
import random
from collections import Counter, defaultdict

import pytest

from brindle.llm import mixing, queries
from brindle.llm.mixing import mixed, water_fill
from brindle.llm.packing import UNIT, packed

from .conftest import DOC, ODD


def _by_turns(tokens, weights, cap, budget):
    """Clamp, share the rest by weight, clamp again, until nothing is over."""
    clamped = {}
    while True:
        rest = {s for s in tokens if s not in clamped}
        left = budget - sum(clamped.values())
        total = sum(weights[s] for s in rest)
        given = {s: left * weights[s] / total for s in rest}
        over = {s: cap * tokens[s] for s in rest if given[s] >= cap * tokens[s] * (1 - 1e-12)}
        if not over:
            return {s: (clamped | given)[s] / tokens[s] for s in tokens}
        clamped |= over
        if len(clamped) == len(tokens):
            return dict.fromkeys(tokens, cap)


@pytest.mark.parametrize("seed", range(4))
def test_water_filling_equals_clamping_in_turns(spark, seed):
    rng = random.Random(seed)
    tokens = {f"s{i}": float(rng.randrange(1, 1000)) for i in range(9)}
    weights = {s: rng.choice([0.1, 1, 5, 50]) * rng.random() for s in tokens}
    cap, ratio = rng.choice([1.2, 2, 4]), rng.choice([0.3, 1, 1.9, 9])
    sizes = spark.createDataFrame([(s, tokens[s], weights[s]) for s in tokens], "source string, tokens double, weight double")
    got = {r["source"]: r["epochs"] for r in water_fill(sizes, cap, ratio).collect()}
    assert got == pytest.approx(_by_turns(tokens, weights, cap, min(ratio * sum(tokens.values()), cap * sum(tokens.values()))))


def test_default_budget_keeps_every_document(docs):
    rows = [(i, "w " * (1 + i % 5), "big" if i % 4 else "small") for i in range(400)]
    out = Counter(r["doc_id"] for r in mixed(docs(*rows)).collect())
    assert set(out) == set(range(400)) and max(out.values()) <= 4
    big = [out[i] for i in range(400) if i % 4]
    assert set(big) == {1} and sum(out[i] for i in range(0, 400, 4)) > 110


def test_sampling_is_seeded_and_near_its_rate(docs):
    rows = [(i, "one two", "a" if i % 2 else "b") for i in range(4000)]
    df = docs(*rows)
    run = lambda d, seed: sorted(r["doc_id"] for r in mixed(d, {"a": 3, "b": 1}, max_epochs=9, budget_ratio=1.0, seed=seed).collect())
    one = run(df, 1)
    assert one == run(df.repartition(7), 1) != run(df, 2)
    n = Counter(i % 2 for i in one)
    assert n[1] == pytest.approx(3000, rel=0.05) and n[0] == pytest.approx(1000, rel=0.08)
    assert all(c in (1, 2) for i, c in Counter(one).items() if i % 2)


def test_many_sources_are_joined_without_a_broadcast(docs, monkeypatch):
    rows = [(i, "one two three", f"s{i % 40}") for i in range(400)]
    df = docs(*rows, (400, "x", None))
    run = lambda: sorted((r["doc_id"], r["source"], r["copy"]) for r in mixed(df, alpha=0.5, max_epochs=2.0, budget_ratio=1.3, copy_column="copy").collect())
    want = run()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert "Broadcast" not in mixed(df, alpha=0.5)._jdf.queryExecution().logical().toString() and run() == want


def test_mixing_odd_rows(spark, odd, clashing):
    for df in (odd, clashing):
        out = mixed(df)
        assert out.columns == df.columns and sorted(map(repr, out.collect())) == sorted(map(repr, df.collect()))
    assert mixed(odd, copy_column="copy").columns == [*odd.columns, "copy"]
    assert mixed(odd, weights={}).count() == 0 and mixed(odd, weights={"other": 1.0}).count() == 0
    assert mixed(spark.createDataFrame([], DOC)).count() == 0
    null = spark.createDataFrame([(1, "a b", None, None, 3), (2, "c", None, "", 1)], DOC)
    assert mixed(null).count() == 2


def _robin(rows, window, quanta):
    """Round-robin with deficit counters, a document at a time, cut into windows."""
    seen, queues = Counter(), defaultdict(list)
    for doc_id, source, n in sorted(rows, key=lambda r: r[2]):
        if n:
            seen[doc_id, source] += 1
            key = hashlib.md5(f"1:{'' if doc_id is None else doc_id}:{seen[doc_id, source]}".encode()).hexdigest()
            queues[source].append((key, n, doc_id))
    queues = {s: sorted(q, key=lambda x: x[:2]) for s, q in sorted(queues.items())}
    deficit, out, at = dict.fromkeys(queues, 0), [], 0
    while any(queues.values()):
        for s, q in queues.items():
            if not q:
                continue
            deficit[s] += quanta[s]
            while q and q[0][1] * UNIT <= deficit[s]:
                _, n, doc_id = q.pop(0)
                deficit[s] -= n * UNIT
                done = 0
                while done < n:
                    take = min(n - done, window - at % window)
                    out.append((at // window, at % window, s, doc_id, done, take))
                    at, done = at + take, done + take
    return out


@pytest.mark.parametrize(("seed", "window", "weights"), [(1, 64, None), (2, 100, {"a": 5, "b": 1, "c": 2}), (3, 16, {"a": 1, "b": 1, "c": 30}), (4, 2048, {"a": 1, "b": 0.001, "c": 0.01})])
def test_packing_equals_deficit_round_robin(spark, docs, seed, window, weights):
    rng = random.Random(seed)
    rows = [(rng.randrange(200), "abc"[min(2, rng.randrange(5))], rng.choice([0, 1, 5, 40, 300])) for _ in range(300)]
    df = docs(*((i, "w " * n, s) for i, s, n in rows))
    total = {s: sum(n for _, t, n in rows if t == s) for s in "abc"}
    w = {s: float(total[s]) for s in "abc"} if weights is None else {s: float(weights.get(s, 0)) for s in "abc"}
    quanta = {s: max(1, int(w[s] / sum(w.values()) * window * UNIT + 0.5)) for s in "abc"}
    got = packed(df, window, weights and {k: float(v) for k, v in weights.items()})
    assert sorted(map(tuple, got.collect())) == sorted(_robin(rows, window, quanta))


def test_windows_are_full_and_near_the_shares(docs):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(20, 120), rng.choice("aabc")) for i in range(3000)]
    pieces = packed(docs(*rows), 2048).collect()
    size, share, spans = Counter(), defaultdict(Counter), defaultdict(list)
    for r in pieces:
        size[r["window_id"]] += r["n_tokens"]
        share[r["window_id"]][r["source"]] += r["n_tokens"]
        spans[r["doc_id"]].append((r["doc_start"], r["n_tokens"]))
    last = max(size)
    assert sorted(size) == list(range(last + 1)) and all(n == 2048 for w, n in size.items() if w != last)
    assert all(abs(share[w]["a"] / 2048 - 0.5) < 0.12 for w in range(last - 3))
    for i, text, _ in rows:
        at = 0
        for start, n in sorted(spans[i]):
            assert start == at
            at += n
        assert at == len(text.split())


def test_packing_odd_rows(spark, odd, clashing):
    words = sorted((r[0] or 0, len(r[1].split())) for r in ODD if r[1] and r[1].split())
    for df in (odd, clashing):
        total = Counter()
        for r in packed(df, 10).collect():
            total[r["doc_id"] or 0] += r["n_tokens"]
        want = Counter()
        for i, n in words:
            want[i] += n
        assert total == want
    assert packed(spark.createDataFrame([], DOC)).count() == 0
    counted = spark.createDataFrame([(1, "s", 5), (2, None, None), (3, "s", -1)], "doc_id bigint, source string, t int")
    assert [tuple(r) for r in packed(counted, 4, tokens="t").orderBy("window_id").collect()] == [(0, 0, "s", 1, 0, 4), (1, 0, "s", 1, 4, 1)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(name, against_sql, sf_dir):
    against_sql(queries.queries()[name], queries.oracle_sql()[name], sf_dir)
