"""Near-duplicate documents: HyperMinHash registers, banding, collision-corrected estimates, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch, join_skewed, numbered, plain, written
from .textkernel import Words, blocks, mix, shingles

EMPTY = np.uint16(0xFFFF)
MANTISSA_BITS = 10


@dataclass(frozen=True)
class NearDupConfig:
    """``threshold`` is the Jaccard similarity of the sets of ``width``-word shingles from which two texts are near copies.
    ``bands * rows`` registers are kept. At 32 bands of 4 a pair at 0.55 shares a band with probability 0.95, at 0.65 with
    0.998. ``sigmas`` widens the estimate's filter: a pair is verified exactly unless the estimate lies that many standard
    errors below the threshold."""

    threshold: float = 0.55
    width: int = 2
    bands: int = 32
    rows: int = 4
    sigmas: float = 4.0

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def compress(low: np.ndarray) -> np.ndarray:
    """16-bit registers of 64-bit minima: 6 bits count the leading zeros, 10 hold the bits after the first one."""
    head = (low >> np.uint64(11)).astype(np.float64)  # 53 bits: exact
    zeros = (53 - np.frexp(head)[1]).astype(np.uint64)
    mantissa = (low << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA_BITS)
    return (zeros << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)


def registers(doc: np.ndarray, hashes: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """(n_docs, k) HyperMinHash registers. The high half of a hash picks the bucket, mixed bits of the whole are ranked in it."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    low = np.full(n_docs * k, np.iinfo(np.uint64).max, np.uint64)
    value = mix(hashes + np.uint64(0x632BE59BD9B4E019))
    np.minimum.at(low, doc.astype(np.int64) * k + bucket.astype(np.int64), value)
    out = compress(low)
    out[low == np.iinfo(np.uint64).max] = EMPTY
    return out.reshape(n_docs, k)


def _donors(k: int, tries: int = 64) -> np.ndarray:
    j, t = np.arange(k, dtype=np.uint64)[:, None], np.arange(tries, dtype=np.uint64)[None, :]
    return (mix(j * np.uint64(0x9E3779B97F4A7C15) + t + np.uint64(1)) % np.uint64(k)).astype(np.int64)


def densified(regs: np.ndarray) -> np.ndarray:
    """Empty registers borrow from a bucket that a hash of (bucket, try) names (optimal densification); a row without any
    register stays empty."""
    out, donors = regs.copy(), _donors(regs.shape[1])
    row, col = np.nonzero((regs == EMPTY) & (regs != EMPTY).any(axis=1)[:, None])
    for t in range(donors.shape[1]):
        if not len(row):
            return out
        found = regs[row, donors[col, t]]
        got = found != EMPTY
        out[row[got], col[got]] = found[got]
        row, col = row[~got], col[~got]
    for r, c in zip(row, col, strict=True):  # next full register, around the circle
        full = np.flatnonzero(regs[r] != EMPTY)
        out[r, c] = regs[r, full[np.searchsorted(full, c) % len(full)]]
    return out


def band_keys(regs: np.ndarray, cfg: NearDupConfig) -> np.ndarray:
    """(n, bands) int64 keys; the band's number is part of its key."""
    dense = densified(regs).reshape(len(regs), cfg.bands, cfg.rows).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, cfg.bands + 1, dtype=np.uint64), dense.shape[:2]).copy()
    for r in range(cfg.rows):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + dense[:, :, r])
    return acc.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, less the expected number of accidental matches (Yu and Weber, 2017), and the
    number of registers in use, which gives the standard error."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    big, small = np.maximum(n_a, n_b).astype(float), np.maximum(np.minimum(n_a, n_b), 1).astype(float)
    phi = 4 * (big / small) / ((1 + big) / small) ** 2
    accidental = 0.169919487159739 * a.shape[1] / 2**MANTISSA_BITS * phi
    return np.clip((same - accidental) / np.maximum(used, 1), 0, 1), used


def _once(texts: list[str], doc_id: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Equal texts of a batch as one: the place of the first of each, its least id and how many there are."""
    at: dict[str, int] = {}
    group = np.fromiter((at.setdefault(t, len(at)) for t in texts), np.int64, len(texts))
    least = np.full(len(at), np.iinfo(np.int64).max)
    np.minimum.at(least, group, np.array(doc_id, np.int64))
    return np.unique(group, return_index=True)[1].tolist(), least, np.bincount(group, minlength=len(at))


def _sketches(cfg: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").to_pylist()
            place, least, copies = _once(texts, batch.column("doc_id").to_pylist())
            texts = [texts[i] for i in place]
            regs, keys, sizes = [], [], []
            for _, encoded in blocks([t.lower() for t in texts]):
                words = Words(encoded)
                doc, h = shingles(words, cfg.width)
                r = registers(doc, h, words.n_docs, cfg.registers)
                regs.append(r)
                keys.append(band_keys(r, cfg))
                # distinct shingles; each (text, hash) once
                order = np.lexsort((h, doc))
                d, s = doc[order], h[order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
                sizes.append(np.bincount(d[new], minlength=words.n_docs))
            regs, keys = np.concatenate(regs), np.concatenate(keys)
            n = len(texts)
            yield pa.record_batch(
                [
                    *(batch.column(c).take(pa.array(place)) for c in ("h", "h2", "len")),
                    pa.array(least),
                    pa.array(copies.astype(np.int64)),
                    pa.array(np.concatenate(sizes).astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 2 * cfg.registers).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(regs))]),
                    pa.ListArray.from_arrays((np.arange(n + 1) * cfg.bands).astype(np.int32), pa.array(keys.ravel())),
                ],
                names=["h", "h2", "len", "doc_id", "copies", "n", "sketch", "bands"],
            )

    return run


def _close_enough(cfg: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.stack([np.frombuffer(x, np.uint16) for x in batch.column(c).to_pylist()]) for c in ("sa", "sb"))
            n_a, n_b = (batch.column(c).to_numpy() for c in ("na", "nb"))
            est, used = estimate(a, b, n_a, n_b)
            error = np.sqrt(cfg.threshold * (1 - cfg.threshold) / np.maximum(np.minimum(used, np.maximum(n_a, n_b)), 1))
            keep = pa.array(est >= cfg.threshold - cfg.sigmas * error)
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(shingles(Words([text.lower().encode("utf-8", "surrogatepass")]), width)[1])


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 0.0


def _verified(cfg: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            kept = []
            for i in range(len(a)):
                if a[i] != last or of_last is None:  # rows that share a come together out of the join
                    last, of_last = a[i], shingle_set(ta[i], cfg.width)
                kept.append(jaccard(of_last, shingle_set(tb[i], cfg.width)) >= cfg.threshold)
            keep = pa.array(kept, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


#: In bands of more texts than this, pairs come from shared rare shingles instead of the band itself.
CROWD = 32


def _shingled(cfg: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, cfg.width).view(np.int64) for t in part.column("text").to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.record_batch([part.column("id"), part.column("label"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], names=["id", "label", "s"])

    return run


def _rare_pairs(texts: DataFrame, cfg: NearDupConfig, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of ``texts`` (id, label, text) of different labels that can reach the threshold, by prefix filtering.

    With the shingles of every text in one order, rare ones first, two sets of sizes m <= n and a similarity of t or more share
    one of the first m - ceil(2t / (1 + t) m) + 1 of the smaller and the first n - ceil(tn) + 1 of the larger, and from the
    first one that they share on, enough are left to share. So no pair is lost, and what many texts have in common, being last
    in the order, brings none together. Only labels that meet at a shingle are crossed, so near copies, which have one label
    already, aren't compared with one another."""
    t, eps = cfg.threshold, 1e-9
    sets = scratch.written(texts.mapInArrow(_shingled(cfg), "id bigint, label bigint, s array<bigint>"), "shingles")
    flat = sets.select("id", F.explode("s").alias("t"))
    often = flat.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    common = flat.join(often, "t").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("common"))
    sized = sets.select("id", "label", F.size("s").alias("n")).join(common, "id")
    probe, index = F.col("n") - F.ceil(F.col("n") * t - eps), F.col("n") - F.ceil(F.col("n") * (2 * t / (1 + t)) - eps)
    # shingles of one text alone come first and match nothing, but take their places
    entries = sized.select("id", "label", "n", probe.alias("probe"), index.alias("index"), (F.col("n") - F.size("common")).alias("alone"), F.posexplode("common").alias("i", "e"))
    entries = entries.withColumn("i", F.col("i") + F.col("alone")).where("i <= probe")
    entries = scratch.written(entries.select(F.col("e.t").alias("t"), "id", "label", "n", "i", (F.col("i") <= F.col("index")).alias("short")), "prefixes")
    met = entries.select("t", "label").distinct()
    several = met.groupBy("t").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("t")
    met = met.join(several, "t")
    crossed = met.withColumnRenamed("label", "la").join(met.withColumnRenamed("label", "lb"), "t").where("la < lb")
    side = lambda c: entries.select("t", *(F.col(x).alias(y + c) for x, y in (("label", "l"), ("id", ""), ("n", "n"), ("i", "i"), ("short", "s"))))
    pairs = crossed.join(side("a"), ["t", "la"]).join(side("b"), ["t", "lb"])
    smaller = F.struct("na", "a") < F.struct("nb", "b")
    left = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    pairs = pairs.where(F.when(smaller, F.col("sa")).otherwise(F.col("sb")) & (F.least("na", "nb") >= t * F.greatest("na", "nb") - eps) & (left >= (F.col("na") + F.col("nb")) * (t / (1 + t)) - eps))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """The needed columns alone, so no extra column can clash; (h, h2, len) tells texts apart."""
    text = F.col("text")
    return plain(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), text, F.xxhash64(text).alias("h"), F.hash(text).alias("h2"), F.length(text).alias("len")).where("text is not null and doc_id is not null")


def _nodes(keyed: DataFrame, cfg: NearDupConfig, scratch: Scratch) -> DataFrame:
    """(id, h, h2, len, doc_id, copies, n, sketch, bands): every distinct text with its least doc_id. ``id`` is h; of different
    texts with the same h all but one get another hash."""
    s = keyed.mapInArrow(_sketches(cfg), "h bigint, h2 int, len int, doc_id bigint, copies bigint, n int, sketch binary, bands array<bigint>")
    s = s.repartition("h").groupBy("h", "h2", "len").agg(F.min("doc_id").alias("doc_id"), F.sum("copies").alias("copies"), *(F.first(c).alias(c) for c in ("n", "sketch", "bands")))
    turn = F.row_number().over(Window.partitionBy("h").orderBy("h2", "len"))
    return scratch.written(s.withColumn("id", F.when(turn == 1, F.col("h")).otherwise(F.xxhash64("h", "h2", "len"))), "nodes")


def _labels(keyed: DataFrame, nodes: DataFrame, cfg: NearDupConfig, scratch: Scratch) -> DataFrame:
    """(id, label): texts that belong to a group of two distinct texts or more, with the group's least id."""
    # every text with every text that shares a band, as a star round the band's least id; counted before rows meet at a band
    flat = nodes.where("n > 0").select("id", "n", F.explode("bands").alias("band"))
    shared = flat.groupBy("band").agg(F.min("id").alias("rep"), F.min_by("n", "id").alias("rep_n"), F.count("*").alias("members")).where("members > 1")
    buckets = scratch.written(flat.join(shared, "band"), "buckets")
    # only pairs whose sizes allow the threshold
    near = F.least("n", "rep_n") >= cfg.threshold * F.greatest("n", "rep_n")
    star = buckets.where(near & (F.col("id") > F.col("rep"))).select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    sketch = nodes.select("id", "n", "sketch")
    wanted = buckets.select("id").distinct().join(nodes.select("id", "h", "h2", "len", "doc_id"), "id")
    key = ["doc_id", "h", "h2", "len"]
    texts = scratch.written(keyed.join(wanted, key).dropDuplicates(key).select("id", "text"), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        s = pairs.join(sketch.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        s = s.join(sketch.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b").select("a", "b", "na", "nb", "sa", "sb")
        s = s.mapInArrow(_close_enough(cfg), "a bigint, b bigint")
        t = s.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        t = t.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
        return t.mapInArrow(_verified(cfg), "a bigint, b bigint")

    linked = scratch.written(verify(star), "linked")
    first = connected_components(linked, scratch)
    # what the stars left apart: pairs of one band whose texts are still in different components
    label = buckets.join(first.select(F.col("node").alias("id"), "label"), "id", "left").select("band", "id", "n", "members", F.coalesce("label", "id").alias("label"))
    apart = label.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
    label = scratch.written(label.join(apart, "band"), "apart")
    few = label.where(F.col("members") <= CROWD).drop("members")
    x, y = few.alias("x"), few.alias("y")
    rest = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label")) & (F.least("x.n", "y.n") >= cfg.threshold * F.greatest("x.n", "y.n")))
    rest = rest.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    crowd = label.where(F.col("members") > CROWD).select("id", "label").distinct()
    if not crowd.isEmpty():
        rest = rest.unionByName(_rare_pairs(texts.join(crowd, "id"), cfg, scratch))
    more = scratch.written(verify(rest.distinct().join(star, ["a", "b"], "left_anti")), "more")
    if more.isEmpty():
        return first.select(F.col("node").alias("id"), "label")
    return connected_components(linked.unionByName(more), scratch).select(F.col("node").alias("id"), "label")


def _grouped(docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(doc_id, h, h2, len, keep): each row of a group of texts with the row that stays for it, the least of the group."""
    keyed = _keyed(docs)
    own = F.struct("doc_id", "h", "h2", "len")
    with Scratch(docs.sparkSession) as scratch:
        nodes = _nodes(keyed, cfg, scratch)
        texts = nodes.select("id", "h", "h2", "len", "copies", own.alias("own")).join(_labels(keyed, nodes, cfg, scratch), "id", "left")
        least = texts.where("label is not null").groupBy("label").agg(F.min("own").alias("least"))
        keep = written(texts.where("copies > 1 or label is not null").join(least, "label", "left").select("h", "h2", "len", "copies", F.coalesce("least", "own").alias("keep")), "keep")
    return join_skewed(keyed.select("doc_id", "h", "h2", "len"), keep, ["h", "h2", "len"], "copies")


def near_duplicates(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """(doc_id, keep_id): one row for each document that goes, with the document that stays for it (the least doc_id of its group).

    Groups are the connected components of the texts whose shingle sets have a Jaccard similarity of ``threshold`` or more,
    among the pairs that share a band. Texts that are equal are one text from the start, however many documents carry it, and a
    band's texts are first held against one of them only; the pairs that this leaves in different components are then compared
    in full in small bands, and by their rare shingles, which loses none, in crowded ones. There is no cap.

    Null texts and null ids are in no group. Empty texts, and texts without a word, go with texts equal to them only. Rows
    with the same doc_id are one document here, named if any of its texts goes: a row repeated whole gives no row of this result (``deduplicated`` keeps one of
    them). Extra columns are ignored. An empty table gives no rows."""
    return _grouped(docs, cfg).select("doc_id", F.col("keep.doc_id").alias("keep_id")).where("doc_id <> keep_id").distinct()


def deduplicated(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """``docs`` with one row of each group of texts: the row with the least doc_id, of several the one with the least key of its
    text. An id may carry texts of different groups; its rows go or stay one by one. Of rows equal in doc_id and text, nulls
    included, one stays. Documents with a null text or id stay otherwise. The columns are those of ``docs``."""
    rows, (doc_id, text) = numbered(docs, "doc_id", "text")
    rows = rows.withColumns({"id": F.col(doc_id).cast("bigint"), "h": F.xxhash64(text), "h2": F.hash(text), "len": F.length(text)})
    key = ["id", "h", "h2", "len"]
    gone = _grouped(docs, cfg).withColumnRenamed("doc_id", "id").where(F.struct(*(F.col(c).alias("doc_id" if c == "id" else c) for c in key)) != F.col("keep")).select(key).distinct()
    # the join has brought rows of one key together: no second exchange
    return rows.join(gone, key, "left_anti").dropDuplicates(key).select(*(c for c in rows.columns if c not in key)).toDF(*docs.columns)
