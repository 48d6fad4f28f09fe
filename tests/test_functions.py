import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import keys
from brindle.functions.text import tokens


def _tokens(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["w"] for r in df.select("i", tokens(F.col("t")).alias("w")).orderBy("i").collect()]


def test_tokens(spark):
    assert _tokens(spark, "", "   \t  ", None, "  foo   bar  ", "Hello WORLD", "it's a-b. x#1") == [[], [], [], ["foo", "bar"], ["hello", "world"], ["it's", "a-b.", "x#1"]]


def test_tokens_split_at_unicode_white_space(spark):
    assert _tokens(spark, "a\u00a0b\u3000c\u0085d\u2003e\x0bf") == [["a", "b", "c", "d", "e", "f"]]


def _one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_canonical_keys(spark):
    k = lambda s, n=None: keys.encode_key(keys.salted_key(F.lit(s), n))
    assert list(_one(spark, k("hello"), k("the", 3), k("word", 0))) == ["hello", "the#3", "word#0"]


def test_keys_decode_and_bad_ones_do_not(spark):
    texts = ["hello", "the#3", "a#b#1", "a#x", "#1", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["d"] and (r["d"]["k"], r["d"]["salt"]) for r in df.select("i", keys.decode_key(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == [("hello", None), ("the", 3), None, None, ("", 1), ("", None)]


def test_partition_of_known_keys(spark):
    p = [keys.partition_id(F.lit("the"), 8), *(keys.partition_id(F.lit("the"), 8, F.lit(i)) for i in range(8))]
    assert list(_one(spark, *p)) == [6, 0, 6, 4, 2, 1, 7, 5, 3]


def test_partition_count_must_be_positive():
    with pytest.raises(ValueError):
        keys.partition_id(F.lit("a"), 0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(words=st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=12), min_size=1, max_size=20), n=st.integers(1, 50))
def test_partition_is_crc32(spark, words, n):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", keys.partition_id(F.col("w"), n).alias("p"))
    assert [r["p"] for r in df.orderBy("i").collect()] == [zlib.crc32(w.encode()) % n for w in words]


def test_source_salt(spark):
    assert list(_one(spark, keys.source_salt(F.lit("the"), F.lit(8)), keys.source_salt(F.lit("x"), F.lit(0)), keys.source_salt(F.lit("x"), F.lit(-1)))) == [6, 0, 0]


def test_sampling_is_repeatable_and_near_its_rate(spark):
    df = spark.range(20000)
    kept = lambda n: {r["id"] for r in df.repartition(n).where(keys.sampled(0.1, 5, F.col("id"))).collect()}
    a = kept(2)
    assert a == kept(7) and 1700 < len(a) < 2300
