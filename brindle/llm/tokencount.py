"""Byte-pair token counts by merging whole batches of pre-tokens at once in ragged numpy arrays."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import plain
from .textkernel import mix

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = np.int64(1 << 40)  # the rank of a pair that doesn't merge
#: A worker forgets its counts of text pieces beyond this many; it costs time only.
REMEMBERED = 400_000
#: Texts are counted in runs of about this many characters, so that what a run has in memory is bounded.
RUN = 1 << 21


class PairRanks:
    """Which two symbols merge into which: symbols are ranks, and a merged pair's symbol is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a = ranks.get(token[:i])
                if a is not None and (b := ranks.get(token[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        # open addressing, at most a third full
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.merged = np.full(1 << self.bits, NONE, np.int64)
        todo, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        values = np.array(merged, np.int64)
        while len(todo):
            self.probes += 1
            free = self.keys[at] == np.iinfo(np.uint64).max
            _, first = np.unique(at, return_index=True)
            takes = np.zeros(len(todo), bool)
            takes[first] = True
            takes &= free
            self.keys[at[takes]], self.merged[at[takes]] = keys[todo[takes]], values[todo[takes]]
            todo, at = todo[~takes], (at[~takes] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merged pairs (a, b); NONE where they don't merge."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = self._slot(keys)
        out = np.full(len(keys), NONE, np.int64)
        open_, which = np.ones(len(keys), bool), np.arange(len(keys))
        for _ in range(self.probes):
            found = self.keys[at[which]]
            hit = found == keys[which]
            out[which[hit]] = self.merged[at[which[hit]]]
            which = which[~hit & (found != np.iinfo(np.uint64).max)]
            if not len(which):
                break
            at[which] = (at[which] + 1) & ((1 << self.bits) - 1)
        return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merged_lengths(pieces: list[bytes], table: PairRanks) -> np.ndarray:
    """The number of symbols that each piece ends with.

    All pieces lie end to end in one array. A round merges in every piece, at the same time, the occurrences of its pair of
    least rank, from the left; a piece without such a pair leaves. Should a merge make a pair of lower rank still (possible
    where a vocabulary has a token that splits in several ways), that piece's later occurrences wait for the next round, so the
    order is that of merging one pair at a time."""
    out = np.fromiter(map(len, pieces), np.int64, len(pieces))
    alive = np.flatnonzero(out > 1)
    if not len(alive):
        return out
    sym = table.of_byte[np.frombuffer(b"".join(pieces[i] for i in alive), np.uint8)]
    size = out[alive]
    seq = np.repeat(np.arange(len(alive)), size)

    def ranks_of(sym, seq):
        rank = np.full(len(sym), NONE, np.int64)
        same = np.flatnonzero(seq[:-1] == seq[1:])
        rank[same] = table.lookup(sym[same], sym[same + 1])
        return rank

    rank = ranks_of(sym, seq)
    while len(sym):
        start = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        low = np.minimum.reduceat(rank, start)
        length = np.diff(np.concatenate((start, [len(sym)])))
        done = low >= NONE
        if done.any():
            out[alive[seq[start[done]]]] = length[done]
            keep = np.repeat(~done, length)
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            if not len(sym):
                break
            low, length = low[~done], length[~done]
        low = np.repeat(low, length)
        hit = np.flatnonzero(rank == low)
        # of occurrences that overlap (aaa) every second one, from the left
        gap = np.concatenate(([True], np.diff(hit) != 1))
        nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(gap, np.arange(len(hit)), 0))
        hit = hit[nth % 2 == 0]
        new, of = low[hit], seq[hit]
        before, after = np.maximum(hit - 1, 0), np.minimum(hit + 2, len(sym) - 1)
        has_before, has_after = (hit > 0) & (seq[before] == of), (hit + 2 < len(sym)) & (seq[after] == of)
        prior = sym[before].copy()
        joined = np.concatenate(([False], hit[1:] == hit[:-1] + 2)) & has_before
        prior[joined] = new[joined]  # the occurrence just before has merged by then
        first = np.where(has_before, table.lookup(prior, new), NONE)
        second = np.where(has_after, table.lookup(new, sym[after]), NONE)
        early = np.minimum(first, second) < new
        if early.any():
            n_bad = np.cumsum(early) - early  # early ones before each occurrence, over all pieces
            head = np.concatenate(([True], of[1:] != of[:-1]))
            base = np.maximum.accumulate(np.where(head, np.arange(len(of)), 0))
            stays = n_bad - n_bad[base] == 0
            hit, new = hit[stays], new[stays]
        sym[hit] = new
        gone = np.zeros(len(sym), bool)
        gone[hit + 1] = True
        fresh = np.zeros(len(sym), bool)
        fresh[hit] = True
        sym, seq, rank, fresh = sym[~gone], seq[~gone], rank[~gone], fresh[~gone]
        touched = fresh.copy()
        touched[:-1] |= fresh[1:]
        at = np.flatnonzero(touched)
        rank[at] = NONE
        at = at[at + 1 < len(sym)]
        at = at[seq[at] == seq[at + 1]]
        rank[at] = table.lookup(sym[at], sym[at + 1])
    return out


class Counter:
    """Counts tokens of texts. Between two characters that aren't white space a lone space always starts a pre-token, so a text
    falls apart at its spaces, and equal pieces are merged once for as long as the worker remembers them."""

    def __init__(self, table: PairRanks):
        import regex

        self.table, self.find = table, regex.compile(PATTERN).findall
        self.known: dict[str, int | None] = {}

    def _of_strings(self, strings: list[str]) -> list[int]:
        counts, owner, hard = np.zeros(len(strings), np.int64), [], []
        easy = self.table.ranks
        for i, s in enumerate(strings):
            for p in self.find(s):
                b = p.encode("utf-8", "surrogatepass")
                if b in easy:
                    counts[i] += 1
                else:
                    owner.append(i)
                    hard.append(b)
        if hard:
            np.add.at(counts, owner, merged_lengths(hard, self.table))
        return counts.tolist()

    def _run(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, split = self.known, [t.split(" ") for t in texts]
        fresh = set()
        for pieces in split:
            fresh |= set(pieces[1:]).difference(known)
        good = [p for p in fresh if p and not p[0].isspace() and not p[-1].isspace()]
        known.update(zip(good, self._of_strings([" " + p for p in good]), strict=True))
        known.update(dict.fromkeys(fresh.difference(good)))
        heads = self._of_strings([p[0] for p in split])
        out, whole = [], []
        for i, pieces in enumerate(split):
            try:
                if len(pieces) > 1 and pieces[0][-1:].isspace() or pieces[0] == "" and len(pieces) > 1:
                    raise TypeError
                out.append(heads[i] + sum(map(known.__getitem__, pieces[1:])))
            except TypeError:  # a space beside other white space: no cutting there
                whole.append(i)
                out.append(0)
        for i, n in zip(whole, self._of_strings([texts[i] for i in whole]), strict=True):
            out[i] = n
        return out

    def counts(self, texts: list[str | None]) -> list[int | None]:
        out: list[int | None] = [None] * len(texts)
        run, size = [], 0
        for i, t in enumerate([*texts, None]):
            if t is not None:
                run.append(i)
                size += len(t)
            if run and (size >= RUN or i == len(texts)):
                for k, n in zip(run, self._run([texts[k] for k in run]), strict=True):
                    out[k] = n
                run, size = [], 0
        return out


def token_counts(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens): the tokens of each whole text under a byte-level BPE vocabulary of ranks at the path ``vocabulary``;
    strings of special tokens are ordinary text. As encoders for such vocabularies do, a pre-token that the vocabulary holds whole
    is one token; any other is merged, least rank first.

    A null text has a null count, an empty one 0. Repeated rows give repeated rows, a null doc_id is carried as it is, extra
    columns are ignored. The table of pairs is broadcast; its size is the vocabulary's, whatever the data."""
    table = docs.sparkSession.sparkContext.broadcast(PairRanks(load_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(table.value)
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array(counter.counts(b.column("text").to_pylist()), pa.int64())], names=["doc_id", "n_tokens"])

    rows = plain(docs, "doc_id", "text").selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint")
