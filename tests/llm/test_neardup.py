import os
import random

import numpy as np
import pytest

from brindle.llm import neardup
from brindle.llm.components import connected_components
from brindle.llm.neardup import EMPTY, NearDupConfig, band_keys, compress, deduplicated, densified, estimate, jaccard, near_duplicates, registers, shingle_set
from brindle.llm.shared import Scratch
from brindle.llm.textkernel import Words, blocks, shingles

from .conftest import DOC, ODD

CFG = NearDupConfig()


def _groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _brute(texts, threshold=CFG.threshold):
    """{id: least id of its group} from every pair."""
    sets = {i: shingle_set(t, CFG.width) for i, t in texts.items()}
    ids = sorted(texts)
    return _groups((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if texts[a] == texts[b] or (len(sets[a]) and jaccard(sets[a], sets[b]) >= threshold))


def _corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        words = [word() for _ in range(rng.choice([6, 30, 120, 400]))]
        if rng.random() < 0.3:
            words += passage
        texts.append(" ".join(words))
        while rng.random() < 0.45:
            words = [word() if rng.random() < 0.06 else w for w in words]
            texts.append(" ".join(words) if rng.random() < 0.7 else texts[-1])
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_those_of_all_pairs(docs, seed):
    texts = _corpus(seed)
    got = _groups((r["doc_id"], r["keep_id"]) for r in near_duplicates(docs(*texts.items())).collect())
    want = _brute(texts)
    lost = [i for i in want if got.get(i) != want[i]]
    assert not set(got) - set(want)
    assert len(lost) <= 0.03 * len(want), lost


def test_hundreds_of_copies_with_an_outlier_in_their_bands(docs):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = {i: " ".join(f"x{rng.randrange(9)}y" if rng.random() < 0.04 else w for w in base) for i in range(300)}
    texts |= {1000 + i: " ".join([*base[:40], *(f"z{i}_{j}" for j in range(160))]) for i in range(50)}
    kept = {r["doc_id"] for r in deduplicated(docs(*texts.items())).collect()}
    assert kept == {0, *range(1000, 1050)}


def test_odd_rows(odd, clashing):
    assert {(r["doc_id"], r["keep_id"]) for r in near_duplicates(odd).collect()} == {(6, 5)}
    for df in (odd, clashing):
        out = deduplicated(df)
        assert out.columns == df.columns
        left = sorted(((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()), key=repr)
        assert left == sorted({x for x in ODD if x[0] != 6}, key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOC)
    assert near_duplicates(empty).count() == 0 and deduplicated(empty).count() == 0


def test_registers_hold_zeros_and_mantissa():
    low = np.array([1 << 63, (1 << 63) | (1 << 62), 1 << 62, 1 << 40, (1 << 40) | (1 << 31)], np.uint64)
    r = compress(low).astype(int)
    assert list(r >> 10) == [0, 0, 1, 23, 23] and list(r & 1023) == [0, 512, 0, 0, 2]


def test_estimates_follow_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        n, shared = 800, int(rng.integers(100, 800))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate((a[:shared], rng.integers(0, 2**63, n - shared, dtype=np.uint64)))
        ra, rb = (registers(np.zeros(n, np.int64), x, 1, 128) for x in (a, b))
        est, _ = estimate(ra, rb, np.array([n]), np.array([n]))
        errors.append(est[0] - shared / (2 * n - shared))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_densification_fills_all_but_empty_rows():
    r = np.full((3, 128), EMPTY, np.uint16)
    r[0, 5], r[1, [3, 77]] = 9, [1, 2]
    d = densified(r)
    assert (d[0] == 9).all() and set(d[1]) == {1, 2} and (d[2] == EMPTY).all()
    assert band_keys(r, CFG).shape == (3, CFG.bands)


def test_shingles_do_not_depend_on_the_block():
    texts = ["alpha beta gamma", "", "one", "x y", "alpha beta gamma", "été déjà vu. Encore!"] * 3
    whole = {}
    for limit in (1, 20, 1 << 20):
        got = []
        for at, enc in blocks(texts, limit):
            w = Words(enc)
            doc, h = shingles(w, 2)
            got += sorted((int(at + d), int(x)) for d, x in zip(doc, h, strict=True))
        whole[limit] = sorted(got)
    assert whole[1] == whole[20] == whole[1 << 20]
    count = np.bincount([d for d, _ in whole[1]], minlength=6)[:6]
    assert list(count) == [2, 0, 1, 1, 2, 3]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = _groups((a, b) for a, b in pairs if a is not None and a != b)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_every_group_leaves_one_row_where_ids_carry_several_texts(docs):
    a, b, c = ("a first text of some words", "another one that shares nothing", "unique words only found here")
    left = lambda *rows: sorted((r["doc_id"], r["text"]) for r in deduplicated(docs(*rows)).collect())
    assert left((1, a), (5, a), (5, b), (9, b)) == [(1, a), (5, b)]
    assert left((1, a), (5, a), (5, c)) == [(1, a), (5, c)]
    near = " ".join(f"w{i}" for i in range(60))
    assert len(left((1, near), (1, near + " more"), (2, near + " less"), (2, c))) == 2


def _crowd(n, seed=9):
    """Short texts with a pair of words in common, and texts with three fifths of a template in common: alike, but no near copies."""
    rng = random.Random(seed)
    texts = [f"subscribe now id{i}" for i in range(n)]
    template = [f"t{j}" for j in range(60)]
    for i in range(n // 4):
        texts.append(" ".join([*template, *(f"v{i}x{j}" for j in range(40))]))
        if i % 9 == 0:
            texts.append(" ".join([*template, *(f"v{i}x{j}" if j > 3 else f"q{i}x{j}" for j in range(40))]))
    texts += [texts[3] + " today", "subscribe now", "now subscribe"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_crowded_bands_lose_no_pair(docs):
    texts = _crowd(160)
    got = _groups((r["doc_id"], r["keep_id"]) for r in near_duplicates(docs(*texts.items())).collect())
    assert got == _brute(texts) and got


def test_pairs_of_a_crowd_grow_no_faster_than_the_texts(spark):
    count = []
    for n in (500, 1000):
        rows = [(i, i, t) for i, t in _crowd(n).items()]
        count.append(neardup._rare_pairs(spark.createDataFrame(rows, "id bigint, label bigint, text string"), CFG, Scratch(spark)).count())
    assert 0 < count[0] < 500 and count[1] < 2.5 * count[0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rare_shingles_find_every_pair(spark, seed):
    rng = random.Random(seed)
    texts = {}
    for i in range(120):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 14))]
        texts[i] = " ".join(words)
    sets = {i: shingle_set(t, CFG.width) for i, t in texts.items()}
    label = {i: i % 50 for i in texts}
    rows = [(i, label[i], t) for i, t in texts.items()]
    got = {(r["a"], r["b"]) for r in neardup._rare_pairs(spark.createDataFrame(rows, "id bigint, label bigint, text string"), CFG, Scratch(spark)).collect()}
    want = {(a, b) for a in texts for b in texts if a < b and label[a] != label[b] and jaccard(sets[a], sets[b]) >= CFG.threshold}
    assert want and want <= got


def test_different_texts_with_one_hash_stay_two(spark):
    rows = [(4, "one text here", 7, 1, 13), (2, "another text", 7, 2, 12), (3, "one text here", 7, 1, 13)]
    keyed = spark.createDataFrame(rows, "doc_id bigint, text string, h bigint, h2 int, len int")
    got = sorted((r["h2"], r["doc_id"], r["copies"]) for r in neardup._nodes(keyed, CFG, Scratch(spark)).collect())
    assert got == [(1, 3, 2), (2, 2, 1)] and neardup._nodes(keyed, CFG, Scratch(spark)).select("id").distinct().count() == 2


def test_tables_on_the_way_are_deleted(docs, spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    assert near_duplicates(docs((1, "a b c d"), (2, "a b c d"), (3, "a b c d e"))).count() == 2
    assert len(set(os.listdir(folder)) - before) == 1
