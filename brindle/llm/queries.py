"""The queries of this folder, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, mixing, mpeg, neardup, packing, pii, reputation, tokencount, toxicity, warc
from .shared import read
from .tokens import WORD_PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no sound, so every whole text is carried as the payload of an MPEG stream first."""
    return mpeg.media_columns(mpeg.as_media(read(spark, sf_dir, "documents")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), window=2048, alpha=0.7, seed=1)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs, alpha=0.5, max_epochs=1.25, budget_ratio=1.0, seed=1, copy_column="copy").select("doc_id", "source", "copy")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages go through WARC files, some with whole records inside their payload."""
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(read(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id 50 divides, searched for among all."""
    found = ann.nearest_neighbours(read(spark, sf_dir, "embeddings"), every=50)
    return found.withColumn("distance", F.round("distance", 6))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return reputation.filtered_pages(pages, reputation.labelled_outcomes(pages, read(spark, sf_dir, "labels")), highest=0.15)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (pipeline, op1_token_counts, op2_media_columns, op3_packing, op4_mixing, op5_warc, op6_near_duplicates, op7_toxicity, op8_pii, op9_nearest_neighbours, op10_url_filter)}


_WORDS = f"len(regexp_extract_all(text, '{WORD_PATTERN}'))"

_OP4 = f"""
WITH sizes AS (SELECT coalesce(source, '') AS source, sum({_WORDS})::DOUBLE AS tokens FROM documents GROUP BY 1),
s AS (SELECT source, tokens, sqrt(tokens) AS weight, 1.25 * tokens AS cap, 1.25 * tokens / sqrt(tokens) AS full_at FROM sizes WHERE tokens > 0),
t AS (SELECT *, sum(tokens) OVER () AS budget, sum(cap) OVER w AS capped, sum(weight) OVER () - sum(weight) OVER w AS open
      FROM s WINDOW w AS (ORDER BY full_at, source ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, capped + full_at * open <= budget * (1 + 1e-12) AS clamped FROM t),
v AS (SELECT source, CASE WHEN clamped THEN 1.25 ELSE (budget - coalesce(sum(cap) FILTER (clamped) OVER (), 0)) * weight / sum(weight) FILTER (NOT clamped) OVER () / tokens END AS epochs FROM u),
d AS (SELECT doc_id, documents.source, floor(epochs) + (CASE WHEN ('0x' || substr(md5(concat_ws(':', '1', coalesce(documents.source, ''), coalesce(doc_id::VARCHAR, ''))), 1, 8))::BIGINT / 4294967296.0 < epochs - floor(epochs) THEN 1 ELSE 0 END) AS copies
      FROM documents JOIN v ON coalesce(documents.source, '') = v.source)
SELECT doc_id, source, unnest(range(1, copies::BIGINT + 1))::INT AS copy FROM d WHERE copies > 0
"""

_OP3 = f"""
WITH r AS (SELECT coalesce(source, '') AS source, doc_id, {_WORDS}::BIGINT AS n FROM documents),
k AS (SELECT *, md5(concat_ws(':', '1', coalesce(doc_id::VARCHAR, ''), (row_number() OVER (PARTITION BY doc_id, source ORDER BY n))::VARCHAR)) AS key FROM r WHERE n > 0),
w AS (SELECT source, pow(sum(n)::DOUBLE, 0.7::DOUBLE) AS weight FROM k GROUP BY source),
q AS (SELECT source, greatest(1, round(weight / (SELECT sum(weight) FROM w) * 2097152))::BIGINT AS quantum FROM w),
e AS (SELECT k.source, doc_id, n, quantum, (sum(n) OVER (PARTITION BY k.source ORDER BY key, n ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM k JOIN q ON k.source = q.source),
f AS (SELECT *, (upto * 1024 + quantum - 1) // quantum - 1 AS round FROM e),
g AS (SELECT source, doc_id, n, (sum(n) OVER (ORDER BY round, source, upto ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM f),
h AS (SELECT source, doc_id, stop, stop - n AS start, unnest(range((stop - n) // 2048, (stop - 1) // 2048 + 1)) AS window_id FROM g)
SELECT window_id, greatest(start, window_id * 2048) - window_id * 2048 AS position, source, doc_id, greatest(start, window_id * 2048) - start AS doc_start,
       least(stop, (window_id + 1) * 2048) - greatest(start, window_id * 2048) AS n_tokens
FROM h
"""


_SQL_STRING = lambda s: "'" + s.replace("'", "''").replace("\r\n", "' || chr(13) || chr(10) || '") + "'"

_OP5 = f"""
WITH p AS (SELECT page_id, url, {_SQL_STRING(warc.HTTP)} || coalesce(html, '') || CASE WHEN page_id % 5 = 0 THEN {_SQL_STRING(warc.DECOY)} ELSE '' END AS block FROM pages)
SELECT page_id, url, octet_length(encode(block))::BIGINT AS n_bytes, md5(block) AS digest FROM p
"""


#: The rules without wildcards, which no host of the tables needs.
_SUFFIX_PATTERN = "((?:^|[.])(?:" + "|".join(r.replace(".", "[.]") for r in reputation.SUFFIX_RULES if r[0] not in "*!") + ")|(?:^|[.])[^.]+)$"


def _parts(table: str, extra: str) -> str:
    return f"""
  SELECT {extra}, host, suffix, CASE WHEN label = '' OR host = suffix THEN host ELSE label || '.' || suffix END AS domain FROM (
   SELECT *, regexp_extract(substr(host, 1, greatest(length(host) - length(suffix) - 1, 0)::BIGINT), '([^.]*)$', 1) AS label FROM (
    SELECT *, CASE WHEN regexp_matches(host, '{reputation.ADDRESS_PATTERN}') THEN host ELSE regexp_replace(regexp_extract(host, '{_SUFFIX_PATTERN}', 1), '^[.]', '') END AS suffix FROM (
     SELECT *, regexp_replace(lower(coalesce(regexp_extract(url, '{reputation.HOST_PATTERN}', 1), '')), '[.]+$', '') AS host FROM {table})))"""


def _fit(level: str) -> str:
    return f"""(SELECT (1 - rho) / rho FROM (SELECT greatest(0.001::DOUBLE, least(0.99::DOUBLE, coalesce(sum((bad - n * mu) ** 2 - n * mu * (1 - mu)) / nullif(sum(n * (n - 1) * mu * (1 - mu)), 0), 0.5::DOUBLE))) AS rho FROM {level}))"""


def _post(level: str, keep: str) -> str:
    return f"""SELECT {keep}, mean, mean * (1 - mean) / (n + s + 1) + (s / (n + s)) * (s / (n + s)) * v AS var FROM (SELECT *, (bad + s * mu) / (n + s) AS mean FROM (SELECT *, {_fit(level)} AS s FROM {level}))"""


_OP10 = f"""
WITH pg AS ({_parts("pages", "page_id, url")}),
lab AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
seen AS (SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM pg JOIN lab ON lab.doc_id = try_cast(nullif(regexp_extract(url, '{reputation.DOC_PATTERN}', 1), '') AS BIGINT) GROUP BY host),
h AS (SELECT x.host, domain, suffix, coalesce(n, 0)::DOUBLE AS n, coalesce(bad, 0)::DOUBLE AS bad FROM (SELECT DISTINCT host, domain, suffix FROM pg) x LEFT JOIN seen ON x.host = seen.host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
t0 AS (SELECT coalesce(sum(n), 0)::DOUBLE AS n, (coalesce(sum(bad), 0)::DOUBLE + 1) / (coalesce(sum(n), 0)::DOUBLE + 2) AS mu FROM h),
t AS (SELECT mu, mu * (1 - mu) / (n + 3) AS v FROM t0),
x0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(mu) AS mu, any_value(v) AS v FROM d, t GROUP BY suffix),
x1 AS ({_post("x0", "suffix")}),
d0 AS (SELECT domain, d.suffix, n, bad, x1.mean AS mu, x1.var AS v FROM d JOIN x1 ON d.suffix = x1.suffix),
d1 AS ({_post("d0", "domain")}),
h0 AS (SELECT h.host, h.domain, suffix, n, bad, d1.mean AS mu, d1.var AS v FROM h JOIN d1 ON h.domain = d1.domain),
h1 AS ({_post("h0", "host, domain, suffix, n, bad")}),
h2 AS (SELECT *, greatest(0.0::DOUBLE, mean - 1.645::DOUBLE * sqrt(var)) AS lower FROM h1)
SELECT page_id, pg.host, h2.domain, h2.suffix, n::BIGINT AS n, bad::BIGINT AS bad, round(mean, 6) AS mean, round(lower, 6) AS lower, lower <= greatest(0.15, (SELECT mu FROM t)) AS kept
FROM pg JOIN h2 ON pg.host = h2.host
"""


#: All distances: the search is exact, as no vector is dropped that its bound doesn't rule out.
_OP9 = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.vec_id, x.vec_id AS neighbour_id, min(list_distance(q.e, x.e)) AS distance FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS rank FROM d)
SELECT vec_id, neighbour_id, rank::INT AS rank, round(distance, 6) AS distance FROM r WHERE rank <= 10
"""


#: Every pair of texts by its shared shingles. Bands miss few of the pairs at the threshold and none far above it.
_OP6 = r"""
WITH RECURSIVE t AS (SELECT doc_id::BIGINT AS doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
n AS (SELECT text, min(doc_id) AS own, row_number() OVER (ORDER BY min(doc_id), text) AS i FROM t GROUP BY text),
w AS (SELECT i, regexp_extract_all(lower(text), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM n),
s AS (SELECT DISTINCT i, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]) END) AS s FROM w WHERE len(w) > 0),
c AS (SELECT i, count(*) AS n FROM s GROUP BY i),
p AS (SELECT a.i AS a, b.i AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.i < b.i GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN c x ON a = x.i JOIN c y ON b = y.i WHERE m::DOUBLE / (x.n + y.n - m) >= 0.55::DOUBLE),
f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
g AS (SELECT DISTINCT a AS i, a AS j FROM f UNION SELECT g.i, f.b FROM g JOIN f ON g.j = f.a),
k AS (SELECT g.i, min(own) AS keep FROM g JOIN n ON n.i = g.j GROUP BY g.i)
SELECT DISTINCT doc_id, coalesce(keep, own) AS keep_id FROM t JOIN n ON t.text = n.text LEFT JOIN k ON n.i = k.i WHERE doc_id <> coalesce(keep, own)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_near_duplicates": _OP6, "op9_nearest_neighbours": _OP9, "op3_packing": _OP3, "op4_mixing": _OP4, "op5_warc": _OP5, "op10_url_filter": _OP10}
