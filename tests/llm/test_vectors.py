import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import vectors
from gleanery.llm.vectors import brute_force, similar_vectors


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k]}


def clusters(rng, n=120, each=9, dim=24, noise=0.25):
    centres = rng.normal(size=(n, dim))
    return (np.repeat(centres, each, 0) + noise * rng.normal(size=(n * each, dim))) * rng.uniform(0.5, 3, (n * each, 1))


def recall(found, want):
    return len({(r["id"], r["neighbour"]) for r in found} & want) / len(want)


def test_recall_against_brute_force(spark):
    x = clusters(np.random.default_rng(1))
    df = table(spark, x)
    near = similar_vectors(df, 5, 24).collect()
    assert len(near) == 5 * len(x) and recall(near, exact(x, 5)) > 0.97
    by = {}
    for r in near:
        by.setdefault(r["id"], []).append((r["rank"], r["similarity"]))
    for rows in by.values():
        rows.sort()
        assert [a for a, _ in rows] == [1, 2, 3, 4, 5] and all(x[1] >= y[1] for x, y in zip(rows, rows[1:]))
    some = df.where("vec_id % 100 = 0")
    assert recall(brute_force(df, some, 5, 24).collect(), {p for p in exact(x, 5) if p[0] % 100 == 0}) == 1


def test_recall_with_many_lists_and_a_small_sample(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SAMPLE", 2048)
    x = clusters(np.random.default_rng(5), 6000, 10).astype(np.float32)
    assert len(x) // 300 == 200  # lists
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    some = np.arange(0, len(x), 60)
    s = u[some] @ u.T
    s[np.arange(len(some)), some] = -2
    want = {(int(i), int(j)) for i, row in zip(some, s) for j in np.argsort(-row)[:5]}
    found = lambda **args: recall(similar_vectors(df, 5, 24, **args).where("id % 60 = 0").collect(), want)
    assert found() >= 0.9 > found(margin=0.0)


def test_hot_list_and_busy_slot_are_split(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SLOT", 64)
    monkeypatch.setattr(vectors, "LEAST", 16)
    monkeypatch.setattr(vectors, "ASKERS", 100)
    rng = np.random.default_rng(2)
    x = np.concatenate([clusters(rng, 40), rng.normal(size=24) + 0.01 * rng.normal(size=(300, 24))])
    assert recall(similar_vectors(table(spark, x), 5, 24).collect(), exact(x, 5)) > 0.95


@pytest.mark.parametrize("most", [1, 2])
def test_nearest_list_is_compared_whole(most):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(4000, 24)), rng.normal(size=24) + 0.01 * rng.normal(size=(9000, 24))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    index = vectors.Index(x[:4200], len(x), 0.08)
    ids = np.arange(len(x)) // most
    slot = vectors.Slot(index, x, ids, 6)
    hot = np.arange(4000, len(x), 30)
    own, near_own = vectors._nearest(x[hot], index.centroids, 0)
    found = vectors.answer(index, slot, x[hot], near_own, 6, 48)
    home, _ = vectors._nearest(x, index.centroids, 0)
    sims = x[hot].astype(float) @ x.T.astype(float)
    sims[own[:, None] != home[None, :]] = -2
    for i in range(len(hot)):
        order = np.argsort(-sims[i])[: 6 * most]
        want = [order[ids[order] == v][0] for v in dict.fromkeys(ids[order].tolist())][:6]
        assert len(set(found.ids[i].tolist())) == 6 and np.abs(found.sims[i] - sims[i][want]).max() < 1e-6


def test_equal_vectors_and_repeated_ids_hold_few_rows(monkeypatch):
    """What a slot holds while it answers does not grow with how many members are equally near."""
    held = []
    real = vectors.Best.add

    def add(self, rows, ids, sims):
        held.append(len(rows))
        real(self, rows, ids, sims)

    monkeypatch.setattr(vectors.Best, "add", add)
    rng = np.random.default_rng(1)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 24)), 100_000, 0), rng.normal(size=(1000, 24)), rng.normal(size=24) + 0.001 * rng.normal(size=(20_000, 24))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = np.arange(len(x))
    ids[100_000:100_500] = 7  # one id with many vectors
    index = vectors.Index(x[rng.choice(len(x), 3000, False)], 30_000, 0.08)
    slot = vectors.Slot(index, x, ids, 6)
    assert len(slot.ids) <= len(x) - 100_000 + 6
    ask = np.array([0, 50_000, 100_700, 105_000, 110_000])
    _, least, _, _ = index.near(x[ask])
    found = vectors.answer(index, slot, x[ask], least, 6, 48)
    assert found.ids[0].tolist() == found.ids[1].tolist() == list(range(6)) and max(held) <= 200_000
    assert sum(held) < 2_000_000 and all(len(set(i.tolist())) == 6 for i in found.ids[3:])


@pytest.mark.parametrize("block", [4096, 7])
def test_copies_and_ids_with_several_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate(clusters(rng, 20, 5))] + [(1000 + i, np.ones(24) * (1 + i)) for i in range(40)] + [(5, -np.ones(24)), (5, np.ones(24)), (6, -np.ones(24) * 2)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<float>").repartition(6)
    by = {}
    for r in similar_vectors(df, 5, 24).collect():
        by.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["similarity"]))
    assert set(by) == {i for i, _ in rows} and all(sorted(a for a, _, _ in v) == [1, 2, 3, 4, 5] for v in by.values())
    # of forty equal vectors and one of id 5, each has the least others
    least = [5, 1000, 1001, 1002, 1003, 1004]
    for i in (1000, 1003, 1039):
        assert [n for _, n, _ in sorted(by[i])] == [x for x in least if x != i][:5]
    # id 5 has three vectors: the best of all of them
    assert {n for _, n, _ in by[5]} == {6, 1000, 1001, 1002, 1003} and all(s > 0.99999 for _, _, s in by[5])
    assert sorted(by[6])[0][1] == 5


def test_lists_grow_with_the_square_root():
    assert vectors.lists_for(10) == 1 and vectors.lists_for(160_000) == 533 and vectors.lists_for(1_228_800) == 4096
    assert vectors.lists_for(4 * 1_228_800) == 8192 and vectors.lists_for(10**12) == vectors.LISTS


def test_dirty_rows(spark):
    good = [1.0, 0.0, 0.0]
    rows = [(1, good), (2, [0.9, 0.1, 0.0]), (3, [0.0, 0.0, 0.0]), (4, [1.0, 2.0]), (5, None), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (None, good), (8, [None, 1.0, 0.0]), (2, [0.9, 0.1, 0.0]), (9, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    near = {(r["id"], r["rank"]): r["neighbour"] for r in similar_vectors(df, 5, 3).collect()}
    assert near == {(1, 1): 2, (1, 2): 9, (2, 1): 1, (2, 2): 9, (9, 1): 2, (9, 2): 1}
    assert similar_vectors(df.limit(0), 5, 3).count() == 0
    assert similar_vectors(df.where("vec_id IN (3, 4, 5)"), 5, 3).count() == 0
    assert similar_vectors(df.where("vec_id = 1"), 5, 3).count() == 0


def test_ties_go_to_the_lesser_id(spark):
    df = table(spark, np.array([[1.0, 0.0], [0.0, 1.0], [0.0, 2.0], [0.0, 3.0]]))
    near = [(r["rank"], r["neighbour"]) for r in similar_vectors(df, 2, 2).where("id = 3").orderBy("rank").collect()]
    assert near == [(1, 1), (2, 2)]


def test_estimates_stay_within_their_error():
    rng = np.random.default_rng(3)
    x = clusters(rng, 300, 6, 48)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    index = vectors.Index(x, len(x), 0.1)
    own, _ = vectors._nearest(x, index.centroids, 0)
    codes = index.encode(x, own)
    for l in np.unique(own)[:3]:
        m = np.flatnonzero(own == l)
        estimate, true = index.estimate(codes[m], int(l), x[m]), x[m] @ x[m].T
        assert np.mean(true - estimate <= index.slack) > 0.99


@pytest.mark.parametrize("rows", [1, 2, 5])
def test_few_rows(spark, rows):
    x = np.eye(5)[:rows] + 0.1
    assert similar_vectors(table(spark, x), 5, 5).count() == rows * (rows - 1)


def test_decoded_members_give_the_sums_over_the_tables():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3_000, 96)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.Index(x[:2_000], len(x), 0.08)
    slot = vectors.Slot(index, x, np.arange(len(x)), 6)
    codes = index.encode(slot.x, slot.own)
    q = x[:50]
    summed = index.centroids[slot.own] @ q.T
    for p in range(index.parts):
        summed += (index.books[p] @ q[:, p * index.width : (p + 1) * index.width].T)[codes[:, p]]
    assert np.abs(slot.decoded @ q.T - summed).max() < 1e-5
    mask = rng.random((40, 7)) < 0.3
    assert np.array_equal(vectors._where(mask), np.nonzero(mask))
