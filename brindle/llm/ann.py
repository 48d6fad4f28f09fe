"""Nearest neighbours by additive quantisation, with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, plain, written


@dataclass(frozen=True)
class AnnConfig:
    """``codebooks`` of ``words`` full-dimensional codewords each, fitted in ``rounds`` of Lloyd's algorithm on at most ``sample``
    vectors; ``beam`` candidates are kept while encoding. Vectors are searched in blocks of about ``block`` by queries in blocks
    of about ``queries``; in each block a query's best ``shortlist`` share by looked-up scores are reranked exactly, and so is
    every other that the quantisation error doesn't rule out."""

    k: int = 10
    codebooks: int = 16
    words: int = 64
    rounds: int = 3
    beam: int = 8
    block: int = 8192
    queries: int = 8192
    sample: int = 32_768
    shortlist: float = 0.025


def greedy_residual(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    r = x.copy()
    for c in books:
        r -= c[nearest(r, c)]
    return r


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared norms of the reconstructions) of rows of ``x`` by beam search: of the sums of the first codewords the
    ``beam`` nearest to x are kept at each codebook."""
    n, (m, k, _) = len(x), books.shape
    flat = books.reshape(m * k, -1)
    inner = flat @ flat.T  # of codewords with one another
    norms = np.diagonal(inner).reshape(m, k)
    with_x = (x @ flat.T).reshape(n, m, k)
    codes = np.zeros((n, 1, 0), np.int64)
    dist = np.zeros((n, 1), np.float32)  # |sum|^2 - 2 <x, sum>
    for j in range(m):
        step = norms[j] - 2 * with_x[:, j]  # (n, k)
        total = dist[:, :, None] + step[:, None, :]
        for i in range(j):
            total += 2 * inner[i * k : (i + 1) * k, j * k : (j + 1) * k][codes[:, :, i]]
        b, width = min(beam, total.shape[1] * k), total.shape[1]
        flatter = total.reshape(n, width * k)
        best = np.argpartition(flatter, b - 1, axis=1)[:, :b] if b < width * k else np.broadcast_to(np.arange(width * k), (n, width * k))
        dist = np.take_along_axis(flatter, best, 1)
        codes = np.concatenate((np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None]), axis=2)
    pick = dist.argmin(1)
    codes = codes[np.arange(n), pick]
    sums = books[np.arange(m), codes].sum(1)
    return codes.astype(np.uint8 if k <= 256 else np.uint16), (sums * sums).sum(1).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0), np.float32)
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1).copy()


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def fit_codebooks(x: np.ndarray, cfg: AnnConfig) -> np.ndarray:
    """(codebooks, words, dim): each codebook by Lloyd rounds over what the codebooks before it leave of the rows of ``x``. Codewords
    start from rows taken in turns, moved a little so that equal ones part."""
    left, books = x.astype(np.float32), []
    for j in range(cfg.codebooks):
        start = np.arange(cfg.words) * cfg.codebooks % len(x) + (j if len(x) >= cfg.codebooks * cfg.words else 0)
        centers = left[start] + np.random.default_rng(j).normal(0, 1e-4, (cfg.words, x.shape[1])).astype(np.float32)
        for _ in range(cfg.rounds):
            code = nearest(left, centers)
            counts = np.bincount(code, minlength=cfg.words)
            order = np.argsort(code, kind="stable")
            some = np.flatnonzero(counts)
            sums = np.add.reduceat(left[order].astype(np.float64), np.concatenate(([0], np.cumsum(counts[some])[:-1])))
            centers[some] = (sums / counts[some, None]).astype(np.float32)
        books.append(centers)
        left = left - centers[nearest(left, centers)]
    return np.stack(books)


def train_codebooks(vectors: DataFrame, cfg: AnnConfig) -> np.ndarray:
    """The codebooks of at most ``cfg.sample`` vectors, picked by a hash of the id: so many vectors reach the driver, whatever
    the table's size."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").select("v").limit(cfg.sample).toArrow()
    return fit_codebooks(_matrix(rows.column("v").combine_chunks()), cfg)


def _coded(books: np.ndarray, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"))
            for at in range(0, len(x), 1024):
                codes, norms = encode(x[at : at + 1024], books, beam)
                yield pa.record_batch([b.column("vec_id").slice(at, 1024), b.column("v").slice(at, 1024), _packed(codes), pa.array(norms)], names=["vec_id", "v", "codes", "norm"])

    return run


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, as sums of squared differences in float64, in bounded pieces."""
    out = np.empty(len(x), np.float64)
    for at in range(0, len(x), 32768):
        d = x[at : at + 32768].astype(np.float64) - y[at : at + 32768]
        out[at : at + 32768] = np.einsum("ij,ij->i", d, d)
    return out


def _first(q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the first ``k`` ids of each q, by (d, id); an id counts once, at its least d."""
    order = np.lexsort((d, ids, q))
    new = np.ones(len(order), bool)
    new[1:] = (q[order][1:] != q[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[new]
    order = order[np.lexsort((ids[order], d[order], q[order]))]
    start = np.searchsorted(q[order], q[order])
    return order[np.arange(len(order)) - start < k]


def _spare(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The places of the rows that can be among the best ``k`` of any query: of equal vectors the k + 1 least ids, one of which
    may be the query's own."""
    row = np.ascontiguousarray(x + np.float32(0)).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()  # no -0
    group = np.unique(row, return_inverse=True)[1]
    order = np.lexsort((ids, group))
    new = np.ones(len(order), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[new]
    return np.sort(order[np.arange(len(order)) - np.searchsorted(group[order], group[order]) <= k])


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray, k: int, shortlist: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, neighbour id, squared distance) of the best ``k`` of a block for each query.

    With s the sum of x's codewords, |q - x| is at least |q - s| - |x - s|. Where that doesn't put every vector outside the
    shortlist beyond the shortlist's k-th distance, the vectors that it leaves are measured too, so nothing is cut. What ties
    with the k-th distance is ranked by id, whatever the order of the rows."""
    some = _spare(ids, x, k)
    ids, x, codes, norms = ids[some], x[some], codes[some], norms[some]
    m, words, dim = books.shape
    flat = books.reshape(m * words, dim)
    at = codes.astype(np.int64) + np.arange(m) * words
    error = np.empty(len(x), np.float64)
    for a in range(0, len(x), 1024):
        error[a : a + 1024] = np.sqrt(_squared(x[a : a + 1024], books.astype(np.float64)[np.arange(m), codes[a : a + 1024]].sum(1)))
    error *= 1 + 1e-9
    reach = np.sqrt((flat.astype(np.float64) ** 2).sum(1)).reshape(m, words).max(1).sum() + error.max()  # neither a vector nor its sum is longer
    most = np.unique(ids, return_counts=True)[1].max()  # rows of one id
    keep = min(len(x), max(4 * k, (k + 1) * most, int(np.ceil(shortlist * len(x)))))
    wide = x.astype(np.float64)
    square = (wide * wide).sum(1)
    out = []
    for a in range(0, len(q), 256):
        block = q[a : a + 256]
        n = len(block)
        table = np.ascontiguousarray(flat @ block.T)  # looked-up inner products, a row a codeword
        score = np.repeat(-0.5 * norms[:, None], n, axis=1)
        for j in range(m):
            score += table[at[:, j]]
        score = np.ascontiguousarray(score.T)
        near = np.argpartition(-score, keep - 1, axis=1)[:, :keep] if keep < len(x) else np.broadcast_to(np.arange(len(x)), (n, len(x)))
        row, col = np.repeat(np.arange(n), near.shape[1]), near.ravel()
        exact = _squared(x[col], block[row]).reshape(near.shape)
        own = ids[near] == q_ids[a : a + 256, None]
        exact[own] = np.inf
        last = min(k * most, keep) - 1
        kth = np.partition(exact, last, axis=1)[:, last] if k * most <= keep else np.full(n, np.inf)
        use = exact <= kth[:, None]
        row, col, exact = row[use.ravel()], col[use.ravel()], exact[use]
        if keep < len(x):
            size = (block.astype(np.float64) ** 2).sum(1)
            slack = 4 * (dim + 2 * m) * 2.0**-23 * (np.sqrt(size) + reach) ** 2  # rounding of the scores
            far = 0.5 * (size - slack - kth)  # |q - s| > kth distance + error, in terms of the score
            far = np.where((np.sqrt(size) + reach) ** 2 < 1e30, far, -np.inf)  # beyond, scores overflow and rule nothing out
            least = far.astype(np.float32)[:, None] - np.sqrt(kth).astype(np.float32)[:, None] * error.astype(np.float32) - (0.5 * error**2).astype(np.float32)
            left = ~(score < least)
            np.put_along_axis(left, near, False, axis=1)
            again = np.flatnonzero(left.any(axis=1))
            if len(again):
                rough = square - 2 * (block[again].astype(np.float64) @ wide.T) + size[again, None]
                room = 8 * (dim + 4) * 2.0**-52 * (square + size[again, None])
                r, c = np.nonzero(left[again] & ~(rough > kth[again, None] + room))
                row, col = np.concatenate((row, again[r])), np.concatenate((col, c))
                exact = np.concatenate((exact, _squared(x[c], block[again[r]])))
        ok = (ids[col] != q_ids[a : a + 256][row]) & np.isfinite(exact)
        row, col, exact = row[ok], col[ok], exact[ok]
        best = _first(row, exact, ids[col], k)
        out.append((q_ids[a : a + 256][row[best]], ids[col[best]], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _searcher(books: np.ndarray, cfg: AnnConfig):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            empty = pa.array([], pa.int64())
            return pa.table({"vec_id": empty, "neighbour_id": empty, "d": pa.array([], pa.float64())})
        get = lambda t, c: t.column(c).combine_chunks()
        codes = np.frombuffer(b"".join(get(right, "codes").to_pylist()), np.uint8 if cfg.words <= 256 else np.uint16).reshape(right.num_rows, -1)
        q, n, d = search_block(get(left, "vec_id").to_numpy(), _matrix(get(left, "v")), get(right, "vec_id").to_numpy(), _matrix(get(right, "v")), codes, get(right, "norm").to_numpy(), books, cfg.k, cfg.shortlist)
        return pa.table({"vec_id": q, "neighbour_id": n, "d": d.astype(np.float64)})

    return run


def _finite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, vectors = b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()
        rows = [(i, v.tobytes()) for i, e in zip(ids, vectors, strict=True) if e and None not in e and np.isfinite(v := np.array(e, np.float32)).all()]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["vec_id", "v"])


def nearest_neighbours(embeddings: DataFrame, cfg: AnnConfig = AnnConfig(), every: int = 1) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): the ``k`` nearest other vectors, by Euclidean distance, of each vector whose id
    ``every`` divides, among all vectors.

    Each vector is the sum of a codeword from every codebook, found by beam search, and keeps the squared norm of that sum. A
    query's inner products with all codewords make a table; a vector's score is the sum of its codewords' entries less half its
    norm. The best ``shortlist`` of each block are reranked by the vectors themselves, with the others that the triangle
    inequality doesn't rule out. Every block is searched for every query; a block of queries with a block of vectors is the unit
    of work.

    Vectors that are null, empty, or hold nulls or numbers that aren't finite, null ids, and vectors of another length than the
    most frequent (of equally frequent ones the least) have no rows and are nobody's neighbours. Rows equal in id and vector are
    one; a vector isn't its own id's neighbour. Equal distances are ranked by id. Fewer than ``k`` others give fewer rows; a
    single vector or an empty table gives none. Extra columns are ignored."""
    spark = embeddings.sparkSession
    rows = plain(embeddings, "vec_id", "embedding").selectExpr("cast(vec_id as bigint) as vec_id", "cast(embedding as array<float>) as embedding").where("vec_id is not null and embedding is not null")
    scratch = Scratch(spark)
    vectors = every_vector = scratch.written(rows.mapInArrow(_finite, "vec_id bigint, v binary").distinct(), "vectors")
    lengths = vectors.groupBy(F.length("v").alias("n")).agg(F.count("*").alias("count"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        scratch.drop(every_vector)
        return spark.createDataFrame([], "vec_id bigint, neighbour_id bigint, rank int, distance double")
    size, n, asked = lengths[0]
    vectors = vectors.where(F.length("v") == size)
    books = train_codebooks(vectors, cfg)
    n_blocks, n_asked = max(1, -(-n // cfg.block)), max(1, -(-asked // cfg.queries))
    part = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    coded = written(vectors.mapInArrow(_coded(books, cfg.beam), "vec_id bigint, v binary, codes binary, norm float"), "coded")
    scratch.drop(every_vector)
    left = coded.where(F.col("vec_id") % every == 0).select(part(n_asked).alias("qb"), "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("db"))
    right = coded.select(part(n_blocks).alias("db"), "vec_id", "v", "codes", "norm", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))).alias("qb"))
    found = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(_searcher(books, cfg), "vec_id bigint, neighbour_id bigint, d double")
    found = found.groupBy("vec_id", "neighbour_id").agg(F.min("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("d", "neighbour_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= cfg.k).select("vec_id", "neighbour_id", "rank", F.sqrt("d").alias("distance"))
