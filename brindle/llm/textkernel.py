"""Word hashing over whole batches of texts with numpy, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P, _P_INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Texts are handled in blocks of about this many bytes; a longer text is a block by itself, never cut.
BLOCK_BYTES = 1 << 19
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _table(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, BLOCK_BYTES), _P if kind == "up" else _P_INV, np.uint64)
        steps[0] = 1
        table = np.cumprod(steps, dtype=np.uint64)
        if n > 8 * BLOCK_BYTES:
            return table
        _powers[kind] = table
    return _powers[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def blocks(texts: list[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) in runs of about ``limit`` bytes. None counts as empty."""
    at, run, size = 0, [], 0
    for i, t in enumerate(texts):
        b = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if run and size + len(b) > limit:
            yield at, run
            at, run, size = i, [], 0
        run.append(b)
        size += len(b)
    if run:
        yield at, run


#: ASCII letters and digits and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Words:
    """The words of a block: maximal runs of bytes for which ``table`` is true, never across texts.

    ``start`` and ``end`` are byte offsets in ``buf``; ``doc`` is the index of the text within the block; ``hash`` is a 64-bit
    hash of the bytes after ``fold`` (a byte-to-byte map) was applied."""

    def __init__(self, encoded: list[bytes], table: np.ndarray = WORD, fold: np.ndarray | None = None):
        self.n_docs = len(encoded)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        #: a separator byte follows every text
        self.doc_start = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.buf = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
        inside = table[self.buf]
        inside[self.doc_start[1:] - 1] = False
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.doc_start, self.start, "right") - 1
        self.hash = self.hashed(fold)

    def hashed(self, fold: np.ndarray | None = None) -> np.ndarray:
        n = len(self.buf)
        folded = self.buf if fold is None else fold[self.buf]
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * _table("up", n)[:n], out=sums[1:])
        self.sums = sums
        return mix((sums[self.end] - sums[self.start]) * _table("down", n)[self.start] + (self.end - self.start).astype(np.uint64))


    def stems(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``k`` bytes of the words that have as many, and which words these are."""
        which = np.flatnonzero(self.end - self.start >= k)
        at = self.start[which]
        return mix((self.sums[at + k] - self.sums[at]) * _table("down", len(self.buf))[at] + np.uint64(k)), which


def word_hash(word: str) -> int:
    """The hash that ``Words`` gives this word, unfolded."""
    return int(Words([word.encode()], np.ones(256, bool)).hash[0])


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each run of ``width`` words; a text of fewer words, but at least one, gives one shingle of them all."""
    h, doc = words.hash, words.doc
    count = np.bincount(doc, minlength=words.n_docs)
    acc = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - width + 1 + k]
    whole = doc[: len(acc)] == doc[width - 1 :] if len(acc) else np.zeros(0, bool)
    out_doc, out = doc[: len(acc)][whole], mix(acc[whole])
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.concatenate(([0], np.cumsum(count)))
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            extra[has] = extra[has] * np.uint64(0xD6E8FEB86659FD93) + h[first[short[has]] + k]
        out_doc, out = np.concatenate((out_doc, short)), np.concatenate((out, mix(extra)))
        order = np.argsort(out_doc, kind="stable")
        out_doc, out = out_doc[order], out[order]
    return out_doc, out
