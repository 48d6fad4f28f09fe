"""The registered queries of the engine's own operators, each over whole tables, with DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import keys
from .functions.text import tokens
from .operators import compare, generators, graph, pagerank, reducers, skew, wordcount
from .plans import jobs, runs
from .plans.lineage import scratch_path
from .sources import jsonl
from .sources import sinks as files
from .streaming import each_record

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

REDUCERS, SPLITS, HEAVY_PCT, SAMPLE_RATE, SEED, DAMPING = 8, 8, 0.01, 0.05, 7, 0.85


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


# --- SQL pieces ---

_TOKENS = r"(SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}\x{0085}\x{000B}]+'), lambda w: w <> '')) AS k FROM documents)"


def _crc(key: str) -> str:
    byte = f"list_transform(range(0, octet_length(encode({key}))::BIGINT), lambda i: ('0x' || substr(hex(encode({key})), 2 * i + 1, 2))::BIGINT)"
    inner = "list_reduce(list_prepend(xor(c, b), [0,0,0,0,0,0,0,0]::BIGINT[]), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: {inner}), 4294967295)"


_BYTES = r"""(octet_length(encode(to_json({'k': k, 'v': 1}))) + 5 * len(regexp_extract_all(k, '[<>&]')) + 3 * len(regexp_extract_all(k, '[\x{2028}\x{2029}]')))"""
_COUNTS = f"SELECT k, count(*) AS v FROM {_TOKENS} GROUP BY k"
_LOAD = f"""
WITH c AS ({_COUNTS}), p AS (SELECT v, {_BYTES} AS b, {_crc("k")} % {REDUCERS} AS reducer FROM c)
SELECT r.reducer::INT AS reducer, coalesce(sum(v * b), 0)::BIGINT AS bytes, coalesce(sum(v), 0)::BIGINT AS records
FROM (SELECT unnest(range({REDUCERS})) AS reducer) r LEFT JOIN p ON p.reducer = r.reducer GROUP BY r.reducer
"""


def _summary(load: str) -> str:
    cov = lambda c: f"coalesce(stddev_pop({c}) / nullif(avg({c}), 0), 0)::DOUBLE"
    ratio = lambda c: f"coalesce(max({c}) / nullif(floor(median({c})), 0), 0)::DOUBLE"
    return f"WITH l AS ({load}) SELECT round({cov('bytes')}, 9) AS cov_bytes, round({cov('records')}, 9) AS cov_records, round({ratio('bytes')}, 9) AS max_median_bytes, round({ratio('records')}, 9) AS max_median_records FROM l"


def _rounded(df: DataFrame, *columns: str, places: int = 10) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- word count ---


@_query(_COUNTS)
def wordcount_documents(spark, sf_dir):
    return wordcount.word_count(_docs(spark, sf_dir))


@_query(_COUNTS)
def wordcount_salted(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return wordcount.salted_word_count(docs, heavy_words(spark, sf_dir))


@_query(_COUNTS)
def wordcount_job(spark, sf_dir):
    """Through the job protocol, salted by a plan."""
    return jobs.run(jobs.get("wordcount"), _docs(spark, sf_dir), heavy_words(spark, sf_dir))


@_query(f"SELECT k, v FROM ({_COUNTS}) ORDER BY v DESC, k LIMIT 20")
def top_words(spark, sf_dir):
    return wordcount.top_words(wordcount_documents(spark, sf_dir), 20)


@_query(f"SELECT (SELECT count(*) FROM documents) AS records_processed, count(*) AS kvs_emitted FROM {_TOKENS}")
def map_stats(spark, sf_dir):
    return skew.map_stats(_docs(spark, sf_dir))


@_query(r"SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}\x{0085}\x{000B}]+'), lambda w: w <> '') AS words FROM documents".replace("list_filter", "array_to_string(list_filter").replace(" AS words", ", ' ') AS words"))
def tokenized(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("words"))


# --- partitions and skew ---


@_query(f"SELECT k, ({_crc('k')} % {REDUCERS})::INT AS reducer FROM ({_COUNTS})")
def partition_of_words(spark, sf_dir):
    return wordcount_documents(spark, sf_dir).select("k", keys.partition_id(F.col("k"), REDUCERS).alias("reducer"))


@_query(f"SELECT k, (({_crc('k')}) % {SPLITS})::INT AS salt, k || '#' || (({_crc('k')}) % {SPLITS}) AS encoded, len(string_split(k, '#')) = 1 AS decodes FROM ({_COUNTS})")
def salted_keys(spark, sf_dir):
    """Keys with a salt, their text form, and whether it decodes to the same (not if the key itself holds a #)."""
    s = wordcount_documents(spark, sf_dir).select("k", keys.source_salt(F.col("k"), F.lit(SPLITS)).alias("salt"))
    key = keys.salted_key(F.col("k"), F.col("salt"))
    s = s.withColumn("encoded", keys.encode_key(key)).withColumn("key", key)
    return s.select("k", "salt", "encoded", keys.decode_key(F.col("encoded")).eqNullSafe(F.col("key")).alias("decodes"))


def _load(spark, sf_dir) -> DataFrame:
    return skew.reducer_load(wordcount.emitted(_docs(spark, sf_dir)), REDUCERS)


@_query(_LOAD)
def reducer_load(spark, sf_dir):
    return _load(spark, sf_dir)


@_query(_summary(_LOAD))
def skew_summary(spark, sf_dir):
    return _rounded(skew.load_metrics(_load(spark, sf_dir)), "cov_bytes", "cov_records", "max_median_bytes", "max_median_records", places=9)


_KEPT = f"({_crc(repr(str(SEED) + ':') + ' || doc_id::VARCHAR')}) % 1000000 < {int(SAMPLE_RATE * 1_000_000)}"
_SAMPLE = f"SELECT k, count(*) AS sample_count FROM {_TOKENS} WHERE {_KEPT} GROUP BY k".replace(_TOKENS + " WHERE " + _KEPT, _TOKENS.replace("FROM documents", "FROM documents WHERE " + _KEPT))


def _sample(spark, sf_dir) -> DataFrame:
    docs = skew.sample_rows(_docs(spark, sf_dir), SAMPLE_RATE, SEED, "doc_id")
    return skew.sample_key_counts(wordcount.emitted(docs))


@_query(_SAMPLE)
def sample_key_counts(spark, sf_dir):
    return _sample(spark, sf_dir)


@_query(f"WITH s AS ({_SAMPLE}), t AS (SELECT sum(sample_count) AS total FROM s) SELECT k, sample_count, round(sample_count / total, 12) AS estimated_freq, {SPLITS}::INT AS splits FROM s, t WHERE sample_count >= greatest(1, floor(total * {HEAVY_PCT}))")
def heavy_words(spark, sf_dir):
    return _rounded(skew.partition_plan(_sample(spark, sf_dir), HEAVY_PCT, SPLITS), "estimated_freq", places=12)


_HEAVY = SQL["heavy_words"]
_PLACES = r"(SELECT doc_id, unnest(l) AS k, unnest(range(len(l))) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}\x{0085}\x{000B}]+'), lambda w: w <> '') AS l FROM documents))"


@_query(f"""
WITH h AS ({_HEAVY}), t AS ({_PLACES[1:-1]}),
g AS (SELECT t.k, CASE WHEN h.k IS NULL THEN NULL ELSE {_crc("(t.doc_id::VARCHAR || ':' || t.pos::VARCHAR)")} % {SPLITS} END AS salt FROM t LEFT JOIN h ON t.k = h.k),
c AS (SELECT k, salt, count(*) AS v FROM g GROUP BY k, salt), p AS (SELECT v, {_BYTES} AS b, {_crc("coalesce(k || '#' || salt::VARCHAR, k)")} % {REDUCERS} AS reducer FROM c)
SELECT r.reducer::INT AS reducer, coalesce(sum(v * b), 0)::BIGINT AS bytes, coalesce(sum(v), 0)::BIGINT AS records
FROM (SELECT unnest(range({REDUCERS})) AS reducer) r LEFT JOIN p ON p.reducer = r.reducer GROUP BY r.reducer
""")
def salted_reducer_load(spark, sf_dir):
    """The load once heavy words are spread."""
    kvs = wordcount.salted(wordcount.emitted(_docs(spark, sf_dir), "doc_id"), heavy_words(spark, sf_dir), "doc_id", "pos")
    return skew.reducer_load(kvs, REDUCERS, "salt")


@_query(f"WITH h AS ({_HEAVY}), t AS ({_PLACES[1:-1]}), n AS (SELECT t.k, ((row_number() OVER (PARTITION BY t.k ORDER BY doc_id, pos) - 1) % {SPLITS})::INT AS salt FROM t JOIN h ON t.k = h.k) SELECT k, salt, count(*) AS records FROM n GROUP BY k, salt")
def round_robin_turns(spark, sf_dir):
    """Heavy words spread in exact turns."""
    heavy = skew.small_plan(heavy_words(spark, sf_dir)).select("k")
    kvs = wordcount.emitted(_docs(spark, sf_dir), "doc_id").join(F.broadcast(heavy), "k")
    return skew.round_robin_salt(kvs, SPLITS, "k", "doc_id", "pos").groupBy("k", "salt").agg(F.count("*").alias("records"))


@_query(f"WITH c AS ({_COUNTS}) SELECT k, k AS base, k || '#' || ({_crc('k')} % {SPLITS}) AS salted_text, true AS salted, false AS plain_salted FROM c")
def base_keys(spark, sf_dir):
    """Keys back from their salted form, which is told by the salt and not by the text."""
    key = keys.salted_key(F.col("k"), keys.source_salt(F.col("k"), F.lit(SPLITS)))
    s = wordcount_documents(spark, sf_dir).withColumn("key", key).withColumn("unsalted", keys.salted_key(F.col("k")))
    return s.select("k", keys.base_key(F.col("key")).alias("base"), keys.encode_key(F.col("key")).alias("salted_text"), keys.is_salted(F.col("key")).alias("salted"), keys.is_salted(F.col("unsalted")).alias("plain_salted"))


@_query(f"""
WITH c AS ({_COUNTS}), p AS (SELECT v, {_BYTES} AS b, {_crc("k")} % {REDUCERS} AS reducer FROM c)
SELECT r.reducer::INT AS reducer, coalesce(sum(v * b), 0)::BIGINT AS bytes_read, coalesce(sum(v), 0)::BIGINT AS records_read, count(v) AS records_written
FROM (SELECT unnest(range({REDUCERS})) AS reducer) r LEFT JOIN p ON p.reducer = r.reducer GROUP BY r.reducer
""")
def reducer_stats(spark, sf_dir):
    return reducers.reducer_stats(wordcount.emitted(_docs(spark, sf_dir)), REDUCERS)


# --- files: written to the shared folder and read back ---


def _write_lines(df: DataFrame, path: str) -> str:
    df.write.text(path)
    return path


@_query("SELECT md5(coalesce(text, '')) AS digest, count(*) AS n FROM documents GROUP BY 1")
def text_lines(spark, sf_dir):
    """Documents as JSON lines, with lines that are none between them."""
    lines = _docs(spark, sf_dir).select(F.to_json(F.struct("text")).alias("value"))
    bad = spark.createDataFrame([("not json",), ("",), ('{"text":5}',), ("[1]",)], "value string")
    path = _write_lines(lines.unionByName(bad), scratch_path(spark, "text-lines"))
    return jsonl.text_records(spark, path).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@_query("SELECT count(*) AS records, sum(length(n_name))::BIGINT AS characters FROM nation")
def callback_records(spark, sf_dir):
    """Rows handed to a function one by one."""
    sizes: list[int] = []
    n = each_record(_table(spark, sf_dir, "nation"), lambda r: sizes.append(len(r["n_name"])))
    return spark.createDataFrame([(n, sum(sizes))], "records bigint, characters bigint")


@_query("SELECT how, 'c' || c_custkey AS k, c_nationkey::BIGINT AS v FROM customer, (VALUES ('glob'), ('list')) t(how)")
def files_by_glob_and_list(spark, sf_dir):
    """Key-value lines in several files, found by a pattern and by a file that names them."""
    path = scratch_path(spark, "kv")
    kvs = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("k"), F.col("c_nationkey").cast("bigint").alias("v"))
    kvs.repartition(4).write.json(path)
    names = [n for n in files.listed(spark, path) if n.startswith("part-")]
    files.write_text(spark, "".join(f"{path}/{n}\n" for n in names), path + ".list")
    by_glob = jsonl.kv_records(spark, f"{path}/part-*").select(F.lit("glob").alias("how"), "k", "v")
    return by_glob.unionByName(jsonl.kv_records(spark, jsonl.listed_files(spark, path + ".list")).select(F.lit("list").alias("how"), "k", "v"))


@_query("SELECT 8::BIGINT AS shards, count(*) AS records FROM orders")
def shards(spark, sf_dir):
    dealt = jsonl.sharded(_table(spark, sf_dir, "orders").select("o_orderkey"), 8)
    return dealt.groupBy(F.spark_partition_id().alias("p")).count().agg(F.count("*").alias("shards"), F.sum("count").alias("records"))


@_query(f"SELECT k, v, ({_crc('k')} % {REDUCERS})::INT AS reducer FROM ({_COUNTS})")
def reducer_files(spark, sf_dir):
    """Counts in a file a reducer; the reducer is read from the file's name."""
    path = scratch_path(spark, "reduced")
    reducers.write_reduced(wordcount_documents(spark, sf_dir), path, REDUCERS)
    return reducers.read_reduced(spark, path)


@_query(_COUNTS)
def counts_file(spark, sf_dir):
    path = scratch_path(spark, "counts")
    files.write_counts(wordcount_documents(spark, sf_dir), path)
    return jsonl.kv_records(spark, path).select("k", "v")


# --- graphs ---


def _geo(spark, sf_dir) -> DataFrame:
    """Customers and suppliers point to their nation, nations to their region: few, hot destinations and sinks."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c = _table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))
    s = _table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))
    n = _table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))
    return c.unionByName(s).unionByName(n)


def _trade(spark, sf_dir) -> DataFrame:
    """Suppliers and the parts they sell, both ways: no sinks."""
    pairs = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return pairs.select(F.explode(F.array(F.struct(s.alias("src"), p.alias("dst")), F.struct(p.alias("src"), s.alias("dst")))).alias("e")).select("e.*")


_GEO = "SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"
_TRADE = "SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem"


def _rank_sql(edges: str, rounds: int, select: str) -> str:
    parts = [
        f"e AS ({edges})",
        "nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)",
        "c AS (SELECT count(*)::DOUBLE AS n FROM nodes)",
        "o AS (SELECT src, count(*) AS deg FROM e GROUP BY src)",
        "r0 AS (SELECT node, 1 / n AS rank FROM nodes, c)",
    ]
    for i in range(rounds):
        parts.append(f"s{i} AS (SELECT e.dst AS node, sum(r.rank / o.deg) AS total FROM e JOIN r{i} r ON e.src = r.node JOIN o ON e.src = o.src GROUP BY e.dst)")
        parts.append(f"r{i + 1} AS (SELECT nodes.node, (1 - {DAMPING}) / n + {DAMPING} * coalesce(total, 0) AS rank FROM c, nodes LEFT JOIN s{i} ON nodes.node = s{i}.node)")
    return "WITH " + ",\n".join(parts) + "\n" + select


def _geo_rank_sql(rounds: int) -> str:
    return _rank_sql(_GEO, rounds, f"SELECT node, round(rank, 10) AS rank FROM r{rounds}")


@_query(f"WITH e AS ({_GEO}) SELECT src AS node FROM e UNION SELECT dst FROM e")
def graph_nodes(spark, sf_dir):
    return graph.nodes(_geo(spark, sf_dir))


@_query(f"SELECT dst AS node, count(*) AS in_degree FROM ({_GEO}) GROUP BY dst")
def in_degree(spark, sf_dir):
    return graph.in_degree(_geo(spark, sf_dir))


@_query(f"WITH e AS ({_TRADE}) SELECT src AS node, string_agg(dst, ' ' ORDER BY dst) AS neighbors FROM e GROUP BY src")
def adjacency(spark, sf_dir):
    return graph.adjacency(_trade(spark, sf_dir)).select("node", F.array_join("neighbors", " ").alias("neighbors"))


@_query(f"WITH e AS ({_GEO}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), o AS (SELECT src, string_agg(dst, ' ' ORDER BY dst) AS a FROM e GROUP BY src) SELECT node, round(1 / (SELECT count(*) FROM n)::DOUBLE, 12) AS rank, coalesce(a, '') AS neighbors FROM n LEFT JOIN o ON n.node = o.src")
def graph_init(spark, sf_dir):
    return graph.initial_state(_geo(spark, sf_dir)).select("node", F.round("rank", 12).alias("rank"), F.array_join("neighbors", " ").alias("neighbors"))


@_query(_GEO)
def edges_from_state(spark, sf_dir):
    return graph.edges_of(graph.initial_state(_geo(spark, sf_dir)))


@_query(f"SELECT dst AS node, count(*) AS in_degree, {SPLITS}::INT AS splits FROM ({_GEO}) GROUP BY dst ORDER BY in_degree DESC, node LIMIT 10")
def heavy_destinations(spark, sf_dir):
    return skew.heavy_top_k(graph.in_degree(_geo(spark, sf_dir)), "node", "in_degree", 10, SPLITS)


@_query(f"WITH d AS (SELECT dst AS node, count(*) AS in_degree FROM ({_GEO}) GROUP BY dst), h AS (SELECT node FROM d ORDER BY in_degree DESC, node LIMIT 10) SELECT d.node, in_degree, (CASE WHEN h.node IS NULL THEN 0 ELSE {SPLITS} END)::INT AS splits, h.node IS NOT NULL AS is_heavy FROM d LEFT JOIN h ON d.node = h.node")
def heavy_lookup(spark, sf_dir):
    d = graph.in_degree(_geo(spark, sf_dir))
    return skew.split_count(d, heavy_destinations(spark, sf_dir).select(F.col("node").alias("k"), "splits"), "node")


@_query(_geo_rank_sql(1))
def pagerank_1(spark, sf_dir):
    return _rounded(pagerank.pagerank(_geo(spark, sf_dir), 1, DAMPING), "rank")


@_query(_geo_rank_sql(10))
def pagerank_10(spark, sf_dir):
    return _rounded(pagerank.pagerank(_geo(spark, sf_dir), 10, DAMPING), "rank")


def _plan(spark, sf_dir) -> DataFrame:
    return heavy_destinations(spark, sf_dir).select(F.col("node").alias("k"), "splits")


@_query(_geo_rank_sql(3))
def pagerank_salted(spark, sf_dir):
    return _rounded(pagerank.pagerank(_geo(spark, sf_dir), 3, DAMPING, plan=_plan(spark, sf_dir)), "rank")


@_query(_rank_sql(_TRADE, 3, "SELECT node, round(rank, 10) AS rank FROM r3"))
def pagerank_trade(spark, sf_dir):
    return _rounded(pagerank.pagerank(_trade(spark, sf_dir), 3, DAMPING), "rank")


@_query(_geo_rank_sql(1))
def pagerank_job(spark, sf_dir):
    """One round through the job protocol."""
    state = graph.initial_state(_geo(spark, sf_dir))
    return _rounded(jobs.run(jobs.get("pagerank", damping=DAMPING, num_nodes=state.count()), state), "rank")


@_query(_rank_sql(_GEO, 3, "SELECT node, round(rank, 10) AS rank FROM r3 ORDER BY rank DESC, node"))
def ranks_sorted(spark, sf_dir):
    return pagerank.sorted_ranks(_rounded(pagerank.pagerank(_geo(spark, sf_dir), 3, DAMPING), "rank"))


@_query(_rank_sql(_GEO, 3, "SELECT r1.node, round(r1.rank, 10) AS rank_a, round(r3.rank, 10) AS rank_b, round(abs(r1.rank - r3.rank), 9) AS difference FROM r1 JOIN r3 ON r1.node = r3.node"))
def rank_differences(spark, sf_dir):
    e = _geo(spark, sf_dir)
    d = compare.rank_differences(pagerank.pagerank(e, 1, DAMPING), pagerank.pagerank(e, 3, DAMPING))
    return _rounded(_rounded(d, "rank_a", "rank_b"), "difference", places=9)


@_query(f"WITH e AS ({_GEO}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT count(*) AS nodes, 0::BIGINT AS reported, 0.0::DOUBLE AS largest, true AS matches FROM n")
def salted_matches_plain(spark, sf_dir):
    e = _geo(spark, sf_dir)
    return compare.comparison(pagerank.pagerank(e, 3, DAMPING), pagerank.pagerank(e, 3, DAMPING, plan=_plan(spark, sf_dir))).withColumn("largest", F.round("largest", 9))


@_query(f"WITH e AS ({_GEO}) SELECT DISTINCT dst AS node FROM e WHERE dst NOT IN (SELECT src FROM e)")
def sinks(spark, sf_dir):
    e = _geo(spark, sf_dir)
    return compare.only_in(e.select(F.col("dst").alias("node")), e.select(F.col("src").alias("node")))


_SENT = f"WITH e AS ({_GEO}), kv AS (SELECT dst AS k FROM e UNION ALL (SELECT src FROM e UNION SELECT dst FROM e)), p AS (SELECT {_crc('k')} % {REDUCERS} AS reducer FROM kv)"


@_query(f"{_SENT} SELECT r.reducer::INT AS reducer, count(p.reducer) AS records FROM (SELECT unnest(range({REDUCERS})) AS reducer) r LEFT JOIN p ON p.reducer = r.reducer GROUP BY r.reducer")
def pagerank_round_load(spark, sf_dir):
    """What a round sends to each reducer; it is the same every round."""
    kvs = pagerank.round_kvs(graph.initial_state(_geo(spark, sf_dir)))
    return skew.reducer_load(kvs, REDUCERS, size=F.lit(0)).select("reducer", "records")


@_query(f"""
WITH e AS ({_GEO}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), o AS (SELECT src, string_agg('"' || dst || '"', ',' ORDER BY dst) AS a FROM e GROUP BY src),
kv AS (SELECT node AS k, '{{"type":"adjacency","neighbors":[' || coalesce(a, '') || ']}}' AS v FROM n LEFT JOIN o ON n.node = o.src),
p AS (SELECT {_crc("k")} % {REDUCERS} AS reducer, octet_length(encode('{{"k":"' || k || '","v":"' || replace(v, '"', '\\"') || '"}}')) AS b FROM kv)
SELECT r.reducer::INT AS reducer, coalesce(sum(b), 0)::BIGINT AS bytes, count(b) AS records FROM (SELECT unnest(range({REDUCERS})) AS reducer) r LEFT JOIN p ON p.reducer = r.reducer GROUP BY r.reducer
""")
def adjacency_load(spark, sf_dir):
    """Bytes and records of the adjacency that a round sends; the text of a contribution's number is Java's, which SQL lacks."""
    kvs = pagerank.round_kvs(graph.initial_state(_geo(spark, sf_dir)))
    return skew.reducer_load(kvs.where(F.get_json_object("v", "$.type") == "adjacency"), REDUCERS)


@_query(f"""
WITH e AS ({_GEO}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), s AS (SELECT node FROM n WHERE ({_crc("'7:' || node")}) % 1000000 < 500000),
k AS (SELECT dst AS k FROM e JOIN s ON e.src = s.node UNION ALL SELECT node FROM s), c AS (SELECT k, count(*) AS sample_count FROM k GROUP BY k), t AS (SELECT sum(sample_count) AS total FROM c)
SELECT k, sample_count, round(sample_count / total, 12) AS estimated_freq, {SPLITS}::INT AS splits FROM c, t WHERE sample_count >= greatest(1, floor(total * {HEAVY_PCT}))
""")
def heavy_nodes(spark, sf_dir):
    """Keys of a round, adjacency among them, that are heavy in a sample of the nodes."""
    return _rounded(pagerank.sampled_plan(graph.initial_state(_geo(spark, sf_dir)), 0.5, SEED, HEAVY_PCT, SPLITS), "estimated_freq", places=12)


@_query(_GEO)
def edge_file(spark, sf_dir):
    """An edge list with comments, blanks and lines of one field."""
    lines = _geo(spark, sf_dir).select(F.concat_ws(" \t", "src", "dst", F.lit("note")).alias("value"))
    bad = spark.createDataFrame([("# a b",), ("lonely",), ("",)], "value string")
    return jsonl.edge_list(spark, _write_lines(lines.unionByName(bad), scratch_path(spark, "edges")))


def _state_file(spark, sf_dir) -> str:
    path = scratch_path(spark, "states")
    files.write_states(graph.initial_state(_geo(spark, sf_dir)), path)
    return path


@_query(SQL["graph_init"])
def state_file(spark, sf_dir):
    """Node states as wrapped JSON lines."""
    states = jsonl.node_states(spark, _state_file(spark, sf_dir))
    return states.select("node", F.round("rank", 12).alias("rank"), F.array_join("neighbors", " ").alias("neighbors"))


@_query(_geo_rank_sql(3))
def pagerank_from_states(spark, sf_dir):
    """From a file of node states, each node once."""
    state = graph.checked_unique(jsonl.node_states(spark, _state_file(spark, sf_dir)))
    return _rounded(pagerank.pagerank(graph.edges_of(state), 3, DAMPING, initial=state), "rank")


@_query(_rank_sql(_GEO, 3, "SELECT node, round(rank, 10) AS rank, (row_number() OVER (ORDER BY round(rank, 10) DESC, node))::INT AS place FROM r3"))
def ranks_file(spark, sf_dir):
    """Sorted ranks as JSON lines; the place of a line follows from its file and its place there."""
    path = scratch_path(spark, "ranks")
    files.write_sorted_ranks(_rounded(pagerank.pagerank(_geo(spark, sf_dir), 3, DAMPING), "rank"), path)
    rows = spark.read.schema("node string, rank double").json(path).select("node", "rank", F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("i"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    rows = rows.join(rows.groupBy("f").agg(F.count("*").alias("n")).withColumn("before", before), "f")
    return rows.select("node", "rank", (F.row_number().over(Window.partitionBy("f").orderBy("i")) + F.col("before")).cast("int").alias("place"))


@_query(f"WITH d AS ({SQL['heavy_destinations']}) SELECT node AS k, splits FROM d")
def heavy_config_file(spark, sf_dir):
    path = scratch_path(spark, "heavy") + ".json"
    files.write_summary(spark, runs.analyze_heavy(_geo(spark, sf_dir), 10, SPLITS), path)
    return runs.heavy_plan(spark, files.read_summary(spark, path))


@_query(f"WITH e AS ({_GEO}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT count(*) AS nodes, 0::BIGINT AS reported, 0.0::DOUBLE AS largest, true AS matches, 0::BIGINT AS only_in_a, 0::BIGINT AS only_in_b, 2::INT AS rounds FROM n")
def runs_agree(spark, sf_dir):
    """Whole runs from files to files, one with mitigation."""
    e, out = _geo(spark, sf_dir), scratch_path(spark, "runs")
    a, b = (runs.run_pagerank(spark, e, out, 2, DAMPING, mode, REDUCERS, HEAVY_PCT, SPLITS)["folder"] for mode in ("baseline", "mitigation"))
    r = runs.compare_runs(spark, a, b)
    r["rounds"] = len(files.read_summary(spark, f"{b}/metrics/run_summary.json")["rounds"])
    return spark.createDataFrame([(r["nodes"], r["reported"], round(r["largest"], 9), r["matches"], r["only_in_a"], r["only_in_b"], r["rounds"])], "nodes bigint, reported bigint, largest double, matches boolean, only_in_a bigint, only_in_b bigint, rounds int")


@_query(f"SELECT dst, count(*) AS count FROM ({_GEO}) WHERE dst IN ('n3', 'n7', 'n11', 'r1') GROUP BY dst")
def hot_node_counts(spark, sf_dir):
    return generators.hot_node_counts(_geo(spark, sf_dir), ["n3", "n7", "n11", "r1"])


@_query("SELECT * FROM (VALUES ('hot_key_text', 10000::BIGINT, 200000::BIGINT, true), ('hot_node_graph', 10000, 5000, true), ('zipf_graph', 10000, 10000, true), ('zipf_text', 10000, 200000, true)) t(generator, rows, counted, holds)")
def generator_facts(spark, sf_dir):
    """What must hold of the generators' output: rows, words or distinct edges (to hot nodes), and their shape."""
    words = lambda df: df.select(F.explode(F.split("text", " ")).alias("w"))
    z, h = words(zipf_text(spark, sf_dir)), words(hot_key_text(spark, sf_dir))
    first = lambda w: F.count_if(F.col("w") == w) / F.count("*")
    weight = sum((1 + i) ** -1.1 for i in range(1_000))
    edge = F.struct("src", "dst")
    out = [
        z.agg(F.lit("zipf_text").alias("generator"), F.count("*").alias("counted"), (F.abs(first("w000001") - 1 / weight) < 0.01).alias("holds")).crossJoin(F.broadcast(zipf_text(spark, sf_dir).agg(F.count("*").alias("rows")))),
        h.agg(F.lit("hot_key_text").alias("generator"), F.count("*").alias("counted"), (F.abs(first("HOT") - 0.5) < 0.01).alias("holds")).crossJoin(F.broadcast(hot_key_text(spark, sf_dir).agg(F.count("*").alias("rows")))),
        zipf_graph(spark, sf_dir).agg(F.lit("zipf_graph").alias("generator"), F.countDistinct(edge).alias("counted"), (F.count_if(F.col("src") == F.col("dst")) == 0).alias("holds"), F.count("*").alias("rows")),
        hot_node_graph(spark, sf_dir).agg(F.lit("hot_node_graph").alias("generator"), F.count_if(F.col("dst") <= "n000010").alias("counted"), ((F.count_if(F.col("src") == F.col("dst")) == 0) & (F.countDistinct(edge) == 10_000)).alias("holds"), F.count("*").alias("rows")),
    ]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).select("generator", "rows", "counted", "holds")


# --- generators: every value is a hash of the seed and the row, so SQL has the same ---


def _u(seed: int, *keys: str) -> str:
    return f"(('0x' || substr(md5({' || '.join([repr(str(seed)), *(f"':' || {k}::VARCHAR" for k in keys)])}), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


_ZIPF = "w AS (SELECT i, pow(i::DOUBLE, -1.1::DOUBLE) AS w FROM range(1, 1001) t(i)), c AS (SELECT i, CASE WHEN i = 1000 THEN 1.0 ELSE sum(w) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) / sum(w) OVER () END AS hi FROM w), z AS (SELECT i, coalesce(lag(hi) OVER (ORDER BY i), 0) AS lo, hi FROM c)"
_PADDED = lambda letter, i: f"'{letter}' || lpad(({i})::BIGINT::VARCHAR, 6, '0')"
_SLOTS = "range(10000) r(id), range(20) p(pos)"


def _first_edges(draws: str, want: int) -> str:
    return f"SELECT src, dst FROM (SELECT src, dst, min(id) AS id FROM ({draws}) WHERE src <> dst GROUP BY src, dst) ORDER BY id LIMIT {want}"


def _drawn(lo: int, n: int, salt: int) -> str:
    return f"SELECT id, {_PADDED('n', f'floor({_u(salt, "id")} * 1000) + 1')} AS src, {_PADDED('n', f'floor({_u(salt + 1, "id")} * {n}) + 1 + {lo}')} AS dst FROM range(100000) r(id)"


@_query(f"WITH {_ZIPF}, u AS (SELECT id, pos, {_u(0, 'id', 'pos')} AS u FROM {_SLOTS}) SELECT id, string_agg({_PADDED('w', 'i')}, ' ' ORDER BY pos) AS text FROM u JOIN z ON u >= lo AND u < hi GROUP BY id")
def zipf_text(spark, sf_dir):
    return generators.zipf_text(spark)


@_query(f"SELECT id, string_agg(CASE WHEN {_u(0, 'id', 'pos')} < 0.5 THEN 'HOT' ELSE {_PADDED('w', f'floor({_u(1, "id", "pos")} * 1000) + 1')} END, ' ' ORDER BY pos) AS text FROM {_SLOTS} GROUP BY id")
def hot_key_text(spark, sf_dir):
    return generators.hot_key_text(spark)


@_query(f"WITH {_ZIPF}, u AS (SELECT id, floor({_u(0, 'id')} * 1000) + 1 AS s, {_u(1, 'id')} AS u FROM range(320000) r(id)) " + _first_edges(f"SELECT id, {_PADDED('n', 's')} AS src, {_PADDED('n', 'i')} AS dst FROM u JOIN z ON u >= lo AND u < hi", 10_000))
def zipf_graph(spark, sf_dir):
    return generators.zipf_graph(spark)


@_query(f"(SELECT * FROM ({_first_edges(_drawn(0, 10, 10), 5_000)})) UNION ALL (SELECT * FROM ({_first_edges(_drawn(10, 990, 20), 5_000)}))")
def hot_node_graph(spark, sf_dir):
    return generators.hot_node_graph(spark, num_hot_nodes=10, hot_edge_frac=0.5)


@_query(f"SELECT dst, count(*) AS count FROM ({_GEO}) GROUP BY dst ORDER BY count DESC, dst LIMIT 10")
def top_destinations(spark, sf_dir):
    return generators.top_destinations(_geo(spark, sf_dir), 10)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
