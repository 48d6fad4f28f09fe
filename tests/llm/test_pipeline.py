from collections import Counter

import pytest

import corpus_pipeline
from brindle.llm import toxicity
from brindle.llm.mixing import uniform
from brindle.llm.pii import redact
from brindle.llm.shared import read
from pyspark.sql import functions as F

from .test_mixing_packing import UNIT, _by_turns, _robin
from .test_neardup import _brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The rows that each stage is given and leaves."""
    docs, out = read(spark, sf_dir, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        f(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return dict(zip((n for n, _ in corpus_pipeline.STAGES), out, strict=True))


def test_stages_keep_the_columns_but_the_last(spark, sf_dir, stages):
    want = read(spark, sf_dir, "documents").schema
    for name, (_, after) in stages.items():
        assert (after.schema == want) == (name != "packing")


def test_toxicity_stage(spark, sf_dir, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(before, read(spark, sf_dir, "labels"))
    rows = before.collect()
    clean = {r["doc_id"] for r, p in zip(rows, model.score([r["text"] for r in rows]), strict=True) if p < 0.5}
    assert {r["doc_id"] for r in after.collect()} == clean


def test_near_duplicate_stage_against_all_pairs(stages):
    before, after = stages["near_duplicates"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    group = _brute(texts)
    want = {i for i in texts if group.get(i, i) == i}
    assert {r["doc_id"] for r in after.collect()} == want and len(want) < len(texts)


def test_pii_stage(stages):
    before, after = stages["pii"]
    new = {r["doc_id"]: r for r in after.collect()}
    changed = 0
    for r in before.collect():
        text = redact(r["text"])
        changed += text != r["text"]
        assert new[r["doc_id"]]["text"] == text and (text == r["text"] or new[r["doc_id"]]["n_chars"] == len(text))
    assert changed and len(new) == before.count()


def test_mixing_stage(spark, stages):
    before, after = stages["mixing"]
    rows = before.withColumn("u", uniform(1, F.col("source"), F.col("doc_id"))).collect()
    tokens = Counter()
    for r in rows:
        tokens[r["source"]] += len(r["text"].split())
    weights = {s: n**0.7 for s, n in tokens.items()}
    level = max(tokens[s] / weights[s] for s in tokens)
    epochs = _by_turns(dict(tokens), weights, 4.0, sum(min(4.0 * tokens[s], level * weights[s]) for s in tokens))
    got = Counter(r["doc_id"] for r in after.collect())
    for r in rows:
        e = epochs[r["source"]]
        assert abs(e - round(e)) < 1e-9 or got[r["doc_id"]] == int(e) + (r["u"] < e - int(e))
    assert set(got) == {r["doc_id"] for r in rows}


def test_packing_stage(stages):
    before, after = stages["packing"]
    rows = [(r["doc_id"], r["source"], len([w for w in r["text"].replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\f", " ").split(" ") if w])) for r in before.collect()]
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    quanta = {s: max(1, int(n / sum(total.values()) * 2048 * UNIT + 0.5)) for s, n in total.items()}
    assert sorted(map(tuple, after.collect())) == sorted(_robin(rows, 2048, quanta))


def test_run_equals_the_stages(spark, sf_dir, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages["packing"][1].collect()))


def _chain(spark, docs, sf_dir):
    for _, f in corpus_pipeline.STAGES:
        names = docs.columns
        docs = f(spark, docs, sf_dir)
        rows = docs.collect()
        if docs.columns == names:
            docs = spark.createDataFrame(rows, docs.schema)
    return names, rows


def test_odd_clashing_and_empty_documents_go_through(spark, sf_dir, odd, clashing):
    """Of the odd rows the repeated ones and the copy (6) go, those without a word fill no window."""
    want = {None, 4, 5, 7, 8}
    for df in (odd, clashing):
        names, rows = _chain(spark, df, sf_dir)
        assert names == df.columns and {r["doc_id"] for r in rows} == want
        assert {r["source"] for r in rows} == {"s"}
    assert _chain(spark, odd.limit(0), sf_dir)[1] == []
