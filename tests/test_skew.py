import statistics

import pytest
from pyspark.sql import functions as F

from brindle.operators import skew, wordcount
from brindle.plans import jobs


def _metrics(spark, values):
    load = spark.createDataFrame([(i, v, v) for i, v in enumerate(values)], "reducer int, bytes bigint, records bigint")
    m = skew.load_metrics(load).first()
    return m["cov_records"], m["max_median_records"]


@pytest.mark.parametrize(
    ("values", "cov", "ratio"),
    [
        ([100] * 4, 0, 1),
        ([], 0, 0),
        ([0, 0], 0, 0),
        ([1000, 100, 100, 100], 1.1991120975, 10),
        ([10, 10, 10, 100], None, 10),
        ([1000, 80, 90, 75, 85, 70, 80, 95], 1.5423181500, 12.1951219512),
        ([200, 195, 190, 185, 180, 175, 180, 195], 0.0442216639, 1.0695187166),
    ],
)
def test_load_metrics(spark, values, cov, ratio):
    got = _metrics(spark, values)
    assert got[1] == pytest.approx(ratio, abs=1e-9)
    if cov is not None:
        assert got[0] == pytest.approx(cov, abs=1e-9)
    if values and sum(values):
        assert got[0] == pytest.approx(statistics.pstdev(values) / statistics.mean(values))


def _docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def _counts(df):
    return {r["k"]: r["v"] for r in df.collect()}


def test_word_count_of_nothing_and_of_one_word(spark):
    assert _counts(wordcount.word_count(_docs(spark, "", "  ", None))) == {}
    assert _counts(wordcount.word_count(_docs(spark, "the the the"))) == {"the": 3}
    assert _counts(wordcount.word_count(_docs(spark).limit(0))) == {}


@pytest.mark.parametrize("splits", [0, 1, 2, 7, 64])
@pytest.mark.parametrize("parts", [1, 5])
def test_salted_count_equals_plain_count(spark, splits, parts):
    docs = _docs(spark, *["hot hot hot a#1 a# b"] * 40, "c c", "#").repartition(parts)
    plan = spark.createDataFrame([("hot", splits), ("a#1", splits), ("absent", 3)], "k string, splits int")
    plain = _counts(wordcount.word_count(docs))
    assert _counts(wordcount.salted_word_count(docs, plan)) == plain == {"hot": 120, "a#1": 40, "a#": 40, "b": 40, "c": 2, "#": 1}
    assert _counts(jobs.run(jobs.get("wordcount"), docs, plan)) == plain


def test_load_has_every_reducer_and_all_records(spark):
    kvs = wordcount.emitted(_docs(spark, "a b a", "<x>  "))
    load = skew.reducer_load(kvs, 16).collect()
    assert [r["reducer"] for r in sorted(load)] == list(range(16))
    assert sum(r["records"] for r in load) == 4
    assert sum(r["bytes"] for r in load) == 3 * len('{"k":"a","v":1}') + len('{"k":"\\u003cx\\u003e","v":1}')


def test_salting_evens_the_load(spark):
    docs = _docs(spark, *["hot " * 50 + f"w{i}" for i in range(40)])
    plan = spark.createDataFrame([("hot", 64)], "k string, splits int")
    kvs = wordcount.emitted(docs, "doc_id")
    plain = skew.load_metrics(skew.reducer_load(kvs, 8)).first()
    spread = skew.load_metrics(skew.reducer_load(wordcount.salted(kvs, plan, "doc_id", "pos"), 8, "salt")).first()
    assert spread["cov_records"] < plain["cov_records"]
    assert spread["max_median_records"] < plain["max_median_records"]


def test_plan_keeps_keys_from_the_share_on(spark):
    counts = spark.createDataFrame([("a", 50), ("b", 10), ("c", 9), ("d", 31)], "k string, sample_count bigint")
    rows = {r["k"]: (r["estimated_freq"], r["splits"]) for r in skew.partition_plan(counts, 0.1, 4).collect()}
    assert rows == {"a": (0.5, 4), "b": (0.1, 4), "d": (0.31, 4)}
    assert skew.partition_plan(counts.limit(0), 0.1, 4).count() == 0


def test_exact_turns(spark):
    kvs = _docs(spark, *["x"] * 7)
    got = skew.round_robin_salt(kvs, 3, "text", "doc_id").orderBy("doc_id").collect()
    assert [r["salt"] for r in got] == [0, 1, 2, 0, 1, 2, 0]


def test_exact_turns_over_many_ranges(spark):
    kvs = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 7)) as k", "id div 10 as doc_id", "id % 10 as pos").repartition(6)
    got = {}
    for r in skew.round_robin_salt(kvs, 8, "k", "doc_id", "pos").orderBy("doc_id", "pos").collect():
        got.setdefault(r["k"], []).append(r["salt"])
    assert sum(map(len, got.values())) == 3000 and all(v == [i % 8 for i in range(len(v))] for v in got.values())


def test_sharding_deals_evenly(spark):
    from brindle.sources.jsonl import sharded

    sizes = sharded(spark.range(1000, numPartitions=1), 8).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and all(r["count"] == 125 for r in sizes)


def test_unknown_job():
    with pytest.raises(KeyError):
        jobs.get("nothing")
    with pytest.raises(ValueError):
        jobs.PageRank().finish(None)


def test_a_job_of_ones_own(spark):
    class Longest:
        name, supports_salting = "longest", True

        def map(self, records):
            return records.select(F.substring("text", 1, 1).alias("k"), F.length("text").alias("v"))

        def combine(self, v):
            return F.max(v)

        def finish(self, reduced):
            return reduced

    jobs.register("longest", Longest)
    assert _counts(jobs.run(jobs.get("longest"), _docs(spark, "ab", "abc", "b"))) == {"a": 3, "b": 1}


def _plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salts_are_given_before_any_shuffle(spark):
    """With a bounded plan the rows aren't exchanged by their bare key."""
    docs = _docs(spark, *["hot hot b"] * 40).repartition(8)
    plan = spark.createDataFrame([("hot", 8)], "k string, splits int")
    for df in (wordcount.salted_word_count(docs, plan), jobs.run(jobs.get("wordcount"), docs, plan)):
        text = _plan_text(df)
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
        first = text.rindex("hashpartitioning")  # the exchange nearest to the scan that shuffles by a key
        assert "salt" in text[first : text.index(")", first)]


def test_a_plan_too_large_for_a_broadcast_gives_the_same(spark, monkeypatch):
    docs = _docs(spark, *["hot hot b"] * 40).repartition(8)
    plan = spark.createDataFrame([("hot", 8), ("b", 2)], "k string, splits int")
    monkeypatch.setattr(skew, "MOST_HEAVY", 1)
    assert "broadcast" not in skew.small_plan(plan)._jdf.queryExecution().logical().toString()
    want = {"hot": 80, "b": 40}
    assert _counts(wordcount.salted_word_count(docs, plan)) == want and _counts(jobs.run(jobs.get("wordcount"), docs, plan)) == want


def test_every_salt_is_used_without_broadcasts(spark, tmp_path, monkeypatch):
    """The job protocol's salts come from the emitting task, whatever join follows."""
    for i in range(8):
        spark.createDataFrame([(i, "hot " * 20)], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    seen = []

    class Watched(jobs.WordCount):
        def finish(self, reduced):
            return reduced

        def combine(self, v):
            seen.append(v)
            return F.sum(v)

    monkeypatch.setattr(skew, "MOST_HEAVY", -1)
    monkeypatch.setattr(skew, "small_plan", lambda plan: plan.select("k", "splits"))
    docs = spark.read.option("maxPartitionBytes", 1).parquet(str(tmp_path / "d"))
    plan = spark.createDataFrame([("hot", 8)], "k string, splits int")
    kvs = Watched().map(docs).withColumn("task", F.spark_partition_id()).join(plan, "k", "left")
    assert kvs.select(F.pmod("task", F.col("splits"))).distinct().count() == docs.rdd.getNumPartitions()
    assert _counts(jobs.run(Watched(), docs, plan)) == {"hot": 160} and len(seen) == 2


def test_load_by_row_sizes(spark):
    kvs = spark.createDataFrame([("a", None, 5), ("a", None, 5), ("a", 1, 7)], "k string, salt int, v int")
    load = {r["reducer"]: (r["bytes"], r["records"]) for r in skew.reducer_load(kvs, 1, "salt", F.col("v")).collect()}
    assert load == {0: (17, 3)}
    assert skew.reducer_load(kvs.limit(0), 3).agg(F.sum("records")).first()[0] == 0
