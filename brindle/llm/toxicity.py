"""Toxicity: boosted trees over dense features of the whole text, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic, fit_boosted, fit_isotonic
from .shared import Scratch, numbered, plain
from .textkernel import WORD, Words, blocks, word_hash

LEXICON = """idiot idiots moron morons stupid stupids trash scum loser losers clown clowns worthless pathetic disgusting dumb dumbass imbecile
imbeciles retard bastard bastards vermin filth filthy garbage jerk jerks creep freak degenerate scumbag parasite subhuman braindead lowlife
asshole assholes bitch crap shit fuck fucking dick whore slut
idioten trottel dummkopf abschaum versager widerlich wertlos erbärmlich ekelhaft dreckig arschloch scheisse scheiße hurensohn missgeburt
imbécile imbéciles ordure ordures minable pathétique dégoûtant dégoûtante racaille connard connasse salaud salope abruti abrutis merde
idiota idiotas estúpido estúpida basura escoria perdedor payaso patético asqueroso imbécil gilipollas cabrón mierda puta inútil""".split()
SECOND_PERSON = "you your yours yourself u ur youre du dich dir dein deine deiner ihr euch euer sie tu toi te ton ta tes vous votre vos usted ustedes tú ti tus vosotros os vuestro".split()
PROXIMITY = 5  # words on either side
FEATURES = (
    "lexicon_density", "lexicon_hits", "lexicon_distinct", "second_person_density", "near_second_person", "capital_rate", "shouted_words", "punctuation_rate",
    "exclamation_rate", "question_rate", "repeated_punctuation", "obfuscation_rate", "mixed_words", "digit_rate", "log_words", "beyond_ascii",
    "learned_density", "learned_hits", "learned_weight",
)

_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
_FOLD = np.arange(256, dtype=np.uint8)
for _a, _b in _LEET.items():
    _FOLD[ord(_a)] = ord(_b)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Letters of two bytes in UTF-8 by their first byte: which second bytes make one, and which a capital.
_TWO = np.zeros((256, 256), bool)
_TWO_UPPER = np.zeros((256, 256), bool)
for _lead in range(0xC3, 0xD4):
    for _b in range(0x80, 0xC0):
        _c = bytes([_lead, _b]).decode()
        _TWO[_lead, _b], _TWO_UPPER[_lead, _b] = _c.isalpha(), _c.isupper()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "@$!|*"]] = True
_JOINT = np.zeros(256, bool)
_JOINT[[ord(c) for c in ".-_"]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


#: Lengths in bytes of the word beginnings that a learned lexicon may hold.
STEMS = (4, 5, 6, 7, 8, 10)


@dataclass
class Lexicon:
    """Hashes of word beginnings and their log odds, learned from labels; in order of hash."""

    stem: np.ndarray
    weight: np.ndarray

    def weigh(self, w: Words) -> np.ndarray:
        """Of each word, the greatest weight among its beginnings, or 0."""
        out = np.zeros(len(w.start))
        if len(self.stem):
            for k in STEMS:
                h, which = w.stems(k)
                at = np.minimum(np.searchsorted(self.stem, h), len(self.stem) - 1)
                out[which] = np.maximum(out[which], np.where(self.stem[at] == h, self.weight[at], 0))
        return out


NO_LEXICON = Lexicon(np.zeros(0, np.uint64), np.zeros(0))


def _collapsed(word: str) -> str:
    return "".join(c for i, c in enumerate(word) if not i or c != word[i - 1])


def _obfuscated_forms(word: str) -> set[str]:
    """How a word reads once doubled letters are one and leet signs are letters, and with vowels starred out."""
    w = _collapsed(word)
    vowels = [i for i, c in enumerate(w) if c in "aeiou"]
    starred = {w[:i] + "*" + w[i + 1 :] for i in vowels} | {"".join("*" if c in "aeiou" else c for c in w)}
    return {w} | {_collapsed(s) for s in starred}


def _hashes(words) -> np.ndarray:
    return np.array(sorted({word_hash(w) for w in words}), np.uint64)


_LEX, _YOU = _hashes(LEXICON), _hashes(SECOND_PERSON)
_OBF = _hashes({f for w in LEXICON if len(w) > 3 for f in _obfuscated_forms(w)})


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _sums(flag: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return (total[start[1:]] - total[start[:-1]]).astype(float)


def _unmasked(buf: np.ndarray, is_end: np.ndarray) -> np.ndarray:
    """Which bytes stay when letters spelled apart (s.t.u) are joined and repeated ones become one."""
    keep = np.ones(len(buf), bool)
    keep[1:] = (buf[1:] != buf[:-1]) | is_end[1:]
    letter = _LETTER[buf] | _DIGIT[buf]
    keep[1:-1] &= ~(_JOINT[buf[1:-1]] & letter[:-2] & letter[2:])
    return keep


def _letters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where letters and capitals end, those of two bytes too, and which bytes belong to a capital."""
    letter, upper = _LETTER[buf], _UPPER[buf]
    shouted = upper.copy()
    second = np.flatnonzero((buf[1:] & 0xC0 == 0x80) & (buf[:-1] >= 0xC3) & (buf[:-1] < 0xD4)) + 1
    letter[second] = _TWO[buf[second - 1], buf[second]]
    upper[second] = _TWO_UPPER[buf[second - 1], buf[second]]
    shouted[second] = shouted[second - 1] = upper[second]
    return letter, upper, shouted


def features(texts: list[str | None], learned: Lexicon = NO_LEXICON) -> np.ndarray:
    """(n, len(FEATURES)) over the whole of each text; all zeros for null and empty texts."""
    out = []
    for at, raw in blocks(texts):
        lower = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts[at : at + len(raw)]]
        w = Words(lower)
        n = w.n_docs
        each = lambda flag, w=w, n=n: np.bincount(w.doc[flag], minlength=n).astype(float)
        lex, you = _among(w.hash, _LEX), _among(w.hash, _YOU)

        # the same text with letters spelled apart joined, doubled ones single, leet signs as letters
        is_end = np.zeros(len(w.buf), bool)
        is_end[w.doc_start[1:] - 1] = True
        keep = _unmasked(w.buf, is_end)
        kept = np.concatenate(([0], np.cumsum(keep)))
        bounds = kept[w.doc_start]
        thin = w.buf[keep]
        parts = [thin[bounds[i] : bounds[i + 1] - 1].tobytes() for i in range(n)]
        plain = WORD[thin]
        inner = np.zeros(len(thin), bool)
        inner[1:-1] = _SYMBOL[thin[1:-1]] & plain[:-2] & plain[2:]
        masked = thin.copy()
        masked[~(plain | inner)] = 32
        parts = [masked[bounds[i] : bounds[i + 1] - 1].tobytes() for i in range(n)]
        table = WORD.copy()
        table[[ord(c) for c in "@$!|*"]] = True
        o = Words(parts, table, _FOLD)
        plain_hits = each(lex)
        hidden = np.bincount(o.doc[_among(o.hash, _OBF)], minlength=n).astype(float)
        obfuscated = np.maximum(hidden - np.bincount(w.doc[lex & _collapsible(w)], minlength=n), 0)

        hits = plain_hits + obfuscated
        words = np.maximum(np.bincount(w.doc, minlength=n), 1).astype(float)
        cum = np.concatenate(([0], np.cumsum(you)))
        idx = np.flatnonzero(lex)
        first = np.searchsorted(w.doc, np.arange(n + 1))
        lo, hi = np.maximum(idx - PROXIMITY, first[w.doc[idx]]), np.minimum(idx + PROXIMITY + 1, first[w.doc[idx] + 1])
        close = np.bincount(w.doc[idx], cum[hi] - cum[lo] > 0, minlength=n)
        pairs = np.unique(np.stack((w.doc[idx].astype(np.uint64), w.hash[idx])), axis=1) if len(idx) else np.zeros((2, 0), np.uint64)

        odds = learned.weigh(w)
        known = np.bincount(w.doc[odds > 0], minlength=n)

        starts = np.concatenate(([0], np.cumsum([len(b) for b in raw])))
        buf = np.frombuffer(b"".join(raw), np.uint8)
        size = np.maximum(np.diff(starts), 1).astype(float)
        digit, punct = _DIGIT[buf], _PUNCT[buf]
        letters, upper, _ = _letters(buf)
        again = np.zeros(len(buf), bool)
        again[1:] = punct[1:] & (buf[1:] == buf[:-1])
        rw = Words(raw)
        ups, lets, digs = (np.concatenate(([0], np.cumsum(t))) for t in (_letters(rw.buf)[2], _LETTER[rw.buf], _DIGIT[rw.buf]))
        long = rw.end - rw.start
        shout = (ups[rw.end] - ups[rw.start] == long) & (long > 2)
        mixed = (lets[rw.end] > lets[rw.start]) & (digs[rw.end] > digs[rw.start])
        out.append(
            np.stack(
                [
                    hits / words,
                    np.log1p(hits),
                    np.bincount(pairs[0].astype(np.int64), minlength=n).astype(float) + (obfuscated > 0),
                    each(you) / words,
                    close / words,
                    _sums(upper, starts) / np.maximum(_sums(letters, starts), 1),
                    np.bincount(rw.doc[shout], minlength=n) / words,
                    _sums(punct, starts) / size,
                    _sums(buf == 33, starts) / size,
                    _sums(buf == 63, starts) / size,
                    _sums(again, starts) / size,
                    obfuscated / words,
                    np.bincount(rw.doc[mixed], minlength=n) / words,
                    _sums(digit, starts) / size,
                    np.log1p(np.bincount(w.doc, minlength=n)),
                    _sums(buf > 127, starts) / size,
                    known / words,
                    np.log1p(known),
                    np.bincount(w.doc, odds, minlength=n) / words,
                ],
                axis=1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


_LONG_LEX = _hashes(w for w in LEXICON if len(w) > 3)


def _collapsible(w: Words) -> np.ndarray:
    return _among(w.hash, _LONG_LEX)


@dataclass
class ToxicityModel:
    trees: Boosted
    calibration: Isotonic
    lexicon: Lexicon

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.calibration(self.trees.margin(features(texts, self.lexicon)))


FOLDS = 4


def _lexicon(stem: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, least: int = 4, ratio: float = 4.0) -> Lexicon:
    """The stems that at least ``least`` toxic documents hold, ``ratio`` times the clean documents' share."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    keep = (toxic >= least) & (odds >= np.log(ratio))
    return Lexicon(stem[keep], odds[keep])


def _stem_counts(only: np.ndarray | None):
    """(stem, fold, n): in how many texts of a fold a stem occurs, summed over each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folds = b.column("fold").to_numpy()
            seen = []
            for at, encoded in blocks([t.lower() for t in b.column("text").to_pylist()]):
                w = Words(encoded)
                for k in STEMS:
                    h, which = w.stems(k)
                    doc = w.doc[which]
                    if only is not None:
                        hit = _among(h, only)
                        h, doc = h[hit], doc[hit]
                    order = np.lexsort((doc, h))
                    h, doc = h[order], doc[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                    seen.append((h[new], folds[at + doc[new]]))
            if not seen:
                continue
            h, f = (np.concatenate(x) for x in zip(*seen, strict=True))
            order = np.lexsort((f, h))
            h, f = h[order], f[order]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (f[1:] != f[:-1]))) if len(h) else np.zeros(0, bool))
            n = np.diff(np.concatenate((first, [len(h)])))
            yield pa.record_batch([pa.array(h[first].view(np.int64)), pa.array(f[first].astype(np.int32)), pa.array(n.astype(np.int64))], names=["stem", "fold", "n"])

    return run


def _counts(rows: DataFrame, only: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(stems, counts by fold), in order of stem, of the stems in at least ``least`` texts."""
    c = rows.select("text", "fold").mapInArrow(_stem_counts(only), "stem bigint, fold int, n bigint").groupBy("stem").agg(*(F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"f{k}") for k in range(FOLDS)))
    t = c.where(" + ".join(f"f{k}" for k in range(FOLDS)) + f" >= {least}").toArrow()
    stem = t.column("stem").to_numpy().view(np.uint64)
    order = np.argsort(stem)
    return stem[order], np.stack([t.column(f"f{k}").to_numpy() for k in range(FOLDS)], axis=1)[order]


def _extract(lexicons: list[Lexicon]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, folds = b.column("text").to_pylist(), b.column("fold").to_numpy()
            x = np.zeros((len(texts), len(FEATURES)))
            for k, lexicon in enumerate(lexicons):
                mine = np.flatnonzero(folds == k)
                x[mine] = features([texts[i] for i in mine], lexicon)
            yield pa.record_batch([b.column("toxic"), b.column("fold"), b.column("key"), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "fold", "key", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> ToxicityModel | None:
    """A model from at most ``max_labelled`` labelled documents, picked by a hash of doc_id, equal texts once. Of several labels
    of one document the highest counts; null labels don't. None if either class is missing.

    The labelled texts also give a lexicon of word beginnings that toxic documents hold more often than clean ones. Trees and
    calibration see each text through a lexicon, and the calibration through trees, that the text had no part in."""
    with Scratch(docs.sparkSession) as scratch:
        return _trained(docs, labels, max_labelled, scratch)


def _trained(docs: DataFrame, labels: DataFrame, max_labelled: int, scratch: Scratch) -> ToxicityModel | None:
    given = plain(labels, "doc_id", "toxic").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    picked = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(max_labelled)
    texts = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    # bounded by max_labelled, so its size is known
    rows = texts.join(F.broadcast(picked), "doc_id").select(F.xxhash64("text").alias("key"), "text", "toxic").groupBy("key").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = scratch.written(rows.select("key", "text", F.least("toxic", F.lit(1)).alias("toxic"), F.pmod("key", F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    sizes = {(r["toxic"], r["fold"]): r["count"] for r in rows.groupBy("toxic", "fold").count().collect()}
    n = np.array([[sizes.get((c, k), 0) for k in range(FOLDS)] for c in (0, 1)], float)
    if not n[0].sum() or not n[1].sum():
        return None
    stem, toxic = _counts(rows.where("toxic = 1"), None, 4)
    other, found = _counts(rows.where("toxic = 0"), stem, 1) if len(stem) else (stem, toxic)
    clean = np.zeros_like(toxic)
    clean[np.searchsorted(stem, other)] = found if len(stem) else 0
    lexicons = [_lexicon(stem, toxic.sum(1) - toxic[:, k], clean.sum(1) - clean[:, k], n[1].sum() - n[1, k], n[0].sum() - n[0, k]) for k in range(FOLDS)]

    t = rows.mapInArrow(_extract(lexicons), "toxic int, fold int, key bigint, x array<double>").toArrow()
    order = np.argsort(t.column("key").to_numpy(), kind="stable")  # whatever order the tasks ended in
    y, fold = t.column("toxic").to_numpy()[order].astype(float), t.column("fold").to_numpy()[order]
    x = np.array(t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(y), len(FEATURES))[order]
    held = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            held[fold == k] = fit_boosted(x[fold != k], y[fold != k]).margin(x[fold == k])
    return ToxicityModel(fit_boosted(x, y), fit_isotonic(held, y), _lexicon(stem, toxic.sum(1), clean.sum(1), n[1].sum(), n[0].sum()))


def _scorer(model: ToxicityModel):
    @F.pandas_udf("double")
    def score(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            p = pd.Series(model.score(s.tolist()) if len(s) else [], dtype="float64")
            yield p.where(s.notna().to_numpy(), None)

    return score


def scored(docs: DataFrame, model: ToxicityModel | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, toxic) of every document: the calibrated probability over the whole text and whether it reaches
    ``threshold``. Null texts, and all texts if there is no model, have a null score and are not toxic; empty texts are scored
    by their all-zero features. Repeated rows give repeated rows, a null doc_id is carried as it is, extra columns are ignored."""
    score = F.lit(None).cast("double") if model is None else _scorer(model)(F.col("text"))
    return plain(docs, "doc_id", "text").select("doc_id", score.alias("score")).withColumn("toxic", F.coalesce(F.col("score") >= threshold, F.lit(False)))


def without_toxic(docs: DataFrame, model: ToxicityModel | None, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that ``scored`` calls toxic; columns as they are."""
    if model is None:
        return docs
    rows, (text,) = numbered(docs, "text")
    return rows.withColumn("score", _scorer(model)(F.col(text))).where(F.coalesce(F.col("score") < threshold, F.lit(True))).drop("score").toDF(*docs.columns)
