import numpy as np
import pytest

from brindle.llm.ann import AnnConfig, encode, greedy_residual, nearest_neighbours, search_block

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def _table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)], SCHEMA)


def _exact(x, k):
    d = ((x[:, None].astype(np.float64) - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.sqrt(np.sort(d, axis=1)[:, :k])


def test_recall_on_the_hardest_vectors(spark):
    """Directions without any structure, in several blocks."""
    x = np.random.default_rng(0).normal(size=(1500, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = nearest_neighbours(_table(spark, x), AnnConfig(block=400, shortlist=0.1)).collect()
    near, dist = _exact(x, 10)
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["rank"]] = (r["neighbour_id"], r["distance"])
    assert set(got) == set(range(1500)) and all(sorted(v) == list(range(1, 11)) for v in got.values())
    assert np.mean([len({n for n, _ in got[i].values()} & set(near[i])) / 10 for i in got]) >= 0.9
    for i in range(0, 1500, 50):
        for n, d in got[i].values():
            assert d == pytest.approx(np.linalg.norm(x[i].astype(float) - x[n]), abs=2e-3)


def test_small_and_tied(spark):
    x = np.array([[0, 0], [1, 0], [1, 0], [0, 1], [5, 5]], np.float32)
    rows = nearest_neighbours(_table(spark, x), AnnConfig(k=3)).collect()
    first = {r["vec_id"]: r["neighbour_id"] for r in rows if r["rank"] == 1}
    assert first[1] == 2 and first[2] == 1 and first[0] == 1
    assert {(r["neighbour_id"], r["rank"]) for r in rows if r["vec_id"] == 0} == {(1, 1), (2, 2), (3, 3)}
    assert {r["vec_id"]: None for r in rows}.keys() == {0, 1, 2, 3, 4}


def test_odd_rows(spark):
    rows = [(1, [0.0, 1.0], 1), (1, [0.0, 1.0], 2), (2, [1.0, 1.0], 1), (3, None, 1), (None, [1.0, 2.0], 1), (4, [], 1), (5, [1.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (8, [3.0, 3.0], None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", block string, codes string")
    got = {(r["vec_id"], r["neighbour_id"]) for r in nearest_neighbours(df).collect()}
    assert got == {(a, b) for a in (1, 2, 8) for b in (1, 2, 8) if a != b}
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)
    assert nearest_neighbours(one).count() == 0 and nearest_neighbours(one.limit(0)).count() == 0


def _books(x, m, k):
    rng, books = np.random.default_rng(1), []
    for _ in range(m):
        r = greedy_residual(x, books)
        books.append(r[rng.choice(len(r), k, replace=False)])
    return np.stack(books)


def test_beam_search_beats_greedy_and_a_full_beam_is_exact():
    x = np.random.default_rng(2).normal(size=(60, 8)).astype(np.float32)
    books = _books(x, 3, 5)
    err = lambda beam: ((x - books[np.arange(3), encode(x, books, beam)[0]].sum(1)) ** 2).sum(1)
    sums = (books[0][:, None, None] + books[1][None, :, None] + books[2][None, None]).reshape(-1, 8)
    best = ((x[:, None] - sums[None]) ** 2).sum(-1).min(1)
    assert np.allclose(err(25), best, atol=1e-4) and err(8).sum() <= err(1).sum()
    codes, norms = encode(x, books, 8)
    assert np.allclose(norms, (books[np.arange(3), codes].sum(1) ** 2).sum(1), atol=1e-4)


def test_looked_up_scores_rank_like_distances_to_the_sums():
    x = np.random.default_rng(3).normal(size=(300, 8)).astype(np.float32)
    books = _books(x, 4, 16)
    codes, norms = encode(x, books, 4)
    ids = np.arange(300)
    sums = books[np.arange(4), codes].sum(1)
    # where the vectors are their sums, a short list loses nothing
    q, n, d = search_block(ids, x, ids, sums, codes, norms, books, 3, 0.02)
    true = ((x[:, None] - sums[None]) ** 2).sum(-1)
    np.fill_diagonal(true, np.inf)
    for i in range(300):
        mine = sorted(d[q == i])[:3]
        assert np.allclose(mine, np.sort(true[i])[:3], atol=1e-3)


def test_recall_at_the_defaults_with_a_hot_cluster(spark):
    """Half of the vectors lie closer together than the quantisation tells apart, and there are many more than a shortlist."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    x[:2000] = x[0] + rng.normal(size=(2000, 64)) * 0.02
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    got = {}
    for r in nearest_neighbours(_table(spark, x)).collect():
        got.setdefault(r["vec_id"], set()).add(r["neighbour_id"])
    near = np.concatenate([np.argsort(((x[i : i + 50, None].astype(np.float64) - x[None]) ** 2).sum(-1), axis=1)[:, :11] for i in range(0, 4000, 50)])
    assert np.mean([len(got[i] & (set(near[i]) - {i})) / 10 for i in range(4000)]) >= 0.9


def _searched(x, ids, order, k=10):
    """{query id: its neighbours by (distance, id)} out of one block whose rows come in ``order``."""
    x = x.astype(np.float32)
    books = _books(x, 4, 16)
    codes, norms = encode(x, books, 4)
    q, n, d = search_block(ids, x, ids[order], x[order], codes[order], norms[order], books, k, AnnConfig().shortlist)
    return {i: [int(j) for _, j in sorted(zip(d[q == i], n[q == i], strict=True))] for i in ids}


def test_many_equal_vectors_are_ranked_by_id_in_any_order_of_rows():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 8))
    x[::10] = x[0]
    x[1::10] = np.where(np.arange(200)[:, None] % 2, -1.0, 1.0) * np.eye(8)[np.arange(200) // 2 % 8] + x[0]  # all at distance 1
    ids = np.arange(2000)
    got = _searched(x, ids, ids)
    assert got[0] == list(range(10, 110, 10)) and got[50] == [0, 10, 20, 30, 40, 60, 70, 80, 90, 100] and got[1990] == list(range(0, 100, 10))
    assert got == _searched(x, ids, rng.permutation(2000))


def test_repeated_ids_take_one_place():
    x = np.arange(400, dtype=np.float64)[:, None] * np.ones(4)
    ids = np.concatenate((np.zeros(100, np.int64), np.arange(1, 301)))
    assert sorted(set(_searched(x[::-1].copy(), ids, np.arange(400))[1])) == [0, *range(2, 11)]


def test_vectors_far_from_the_origin_against_their_spread():
    rng = np.random.default_rng(7)
    x = (100 + rng.normal(size=(500, 64)) * 0.05).astype(np.float32)
    got, (near, _) = _searched(x, np.arange(500), np.arange(500)), _exact(x, 10)
    assert all(got[i] and set(got[i]) == set(near[i].tolist()) for i in range(500))


def test_queries_are_the_ids_that_a_number_divides(spark):
    x = np.random.default_rng(8).normal(size=(700, 16)).astype(np.float32)
    x[100:140] = x[0]
    ids = np.arange(-50, 650)
    cfg = AnnConfig(block=90, queries=4, sample=300, codebooks=4, words=16)
    got = {}
    for r in nearest_neighbours(_table(spark, x, ids), cfg, every=50).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = r["neighbour_id"]
    d = ((x[:, None].astype(np.float64) - x[None]) ** 2).sum(-1)
    assert sorted(got) == list(range(-50, 650, 50))
    for i, near in got.items():
        order = [j for j in np.lexsort((ids, d[i + 50])) if ids[j] != i][:10]
        assert [near[k] for k in range(1, 11)] == ids[order].tolist()
