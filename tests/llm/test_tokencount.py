import os
import random

import numpy as np
import pytest

from brindle.llm import tokencount
from brindle.llm.tokencount import DEFAULT_VOCABULARY, PATTERN, Counter, PairRanks, load_ranks, merged_lengths, token_counts

from .conftest import DOC, LONG, ODD

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def table():
    return PairRanks(load_ranks(DEFAULT_VOCABULARY))


@pytest.fixture(scope="module")
def exact(table):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table.ranks, special_tokens={})
    return lambda t: len(enc.encode_ordinary(t))


def _texts(seed, n):
    rng = random.Random(seed)
    kinds = ["abcde ", "thinger", "ab cdeh\n\té'1! ", "0123456789 ", "日本語テキスト", "aA ", " \n 　x", "é😀 a", "'s'll re"]
    return ["".join(rng.choice(k) for _ in range(rng.randrange(1, 150))) for k in kinds for _ in range(n)]


FIXED = ["", " ", "  a", "a  b \n c", "\n\n x", "a" * 500, "it's  they'll ", "a\tb", " lead", "trail ", "1234567 89", "<|endoftext|>", "x　 y \u0085 z", LONG]


def test_counts_equal_one_at_a_time(table, exact):
    texts = FIXED + _texts(1, 150)
    assert Counter(table).counts(texts) == [exact(t) for t in texts]


def test_counts_with_little_memory(table, exact, monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 5)
    monkeypatch.setattr(tokencount, "RUN", 40)
    texts = _texts(2, 20) + [None]
    assert Counter(table).counts(texts) == [None if t is None else exact(t) for t in texts]


def _sequential(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 40, 0))
        if best[0] == 1 << 40:
            return len(parts)
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_vocabularies_whose_tokens_split_in_several_ways():
    """Random ranks, under which a merge often makes a pair of lower rank."""
    rng = random.Random(4)
    for _ in range(30):
        pool = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(25)}
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(rng.sample(sorted(pool), len(pool)))}
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 40))) for _ in range(60)]
        assert list(merged_lengths(pieces, PairRanks(ranks))) == [_sequential(p, ranks) for p in pieces]


def test_a_very_long_piece(table, exact):
    rng = random.Random(1)
    word = "".join(rng.choice("etaoins") for _ in range(4000))
    assert Counter(table).counts([word]) == [exact(word)]
    assert merged_lengths([b"ab" * 100_000], table)[0] > 0


def test_lookup_is_complete(table):
    pairs = np.flatnonzero(table.keys != np.iinfo(np.uint64).max)
    a, b = (table.keys[pairs] >> np.uint64(32)).astype(np.int64), (table.keys[pairs] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    assert (table.lookup(a, b) == table.merged[pairs]).all()
    assert (table.lookup(a, np.full_like(a, 1 << 20)) == tokencount.NONE).all()


def test_rows(spark, odd, clashing, exact):
    want = sorted(((i or 0, None if t is None else exact(t)) for i, t in ODD), key=repr)
    for df in (odd, clashing):
        assert sorted(((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts(df).collect()), key=repr) == want
    assert token_counts(spark.createDataFrame([], DOC)).count() == 0
