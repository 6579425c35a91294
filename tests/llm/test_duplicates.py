import itertools
import random

import numpy as np
import pytest

from gleanery.llm import duplicates
from gleanery.llm.duplicates import Shingles, components, member_pairs, near_duplicates, search, words


def similarity(a, b, n=3, m=6):
    make = Shingles(n, m)
    x, y = set(make.of(*words(a)).tolist()), set(make.of(*words(b)).tolist())
    return len(x & y) / len(x | y)


def corpus(seed=4, bases=25, edits=4):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(900)]
    rows = []
    for b in range(bases):
        base = [rng.choice(vocabulary) for _ in range(140)]
        for e in range(edits):
            t = list(base)
            for _ in range(e * 3):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((f"{b:02d}-{e}", " ".join(t)))
    rows += [("copy-1", rows[0][1].upper() + "!"), ("copy-2", rows[0][1]), ("short", "too short"), ("null", None), (None, rows[0][1]), ("empty", "")]
    return rows


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(corpus(), "chunk_id string, text string")
    return near_duplicates(df.union(df.limit(5)), 0.6, 3, 6, 200)


def test_pairs_against_brute_force(found):
    rows = [(i, t) for i, t in corpus() if i and t and sum(map(str.isalnum, t)) >= 200]
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(rows), 2) if similarity(x, y) >= 0.6}
    assert len(want) > 30
    assert {(r["id_a"], r["id_b"]) for r in member_pairs(*found).collect()} == want


def test_groups(found):
    members, links = found
    groups = {r["id"]: r["group_id"] for r in components(members, links).collect()}
    assert groups["copy-1"] == groups["copy-2"] == groups["00-0"] and groups["01-0"] != groups["00-0"]
    assert {r["class_id"] for r in members.where("id LIKE 'copy%'").collect()} == {"00-0"}
    assert "short" not in groups and "null" not in groups


def test_long_chain_is_one_group(spark):
    members = spark.createDataFrame([(f"{i:03d}", f"{i:03d}") for i in range(40)], "id string, class_id string")
    links = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}", 0.9) for i in range(30)], "class_a string, class_b string, similarity double")
    groups = {r["id"]: r["group_id"] for r in components(members, links).collect()}
    assert {groups[f"{i:03d}"] for i in range(31)} == {"000"} and groups["035"] == "035"


def test_empty_table(spark):
    members, links = near_duplicates(spark.createDataFrame([], "chunk_id string, text string"))
    assert members.count() == links.count() == member_pairs(members, links).count() == components(members, links).count() == 0


def test_hot_pattern_is_split_without_loss(spark, monkeypatch):
    """One pattern shared by more classes than a block holds."""
    monkeypatch.setattr(duplicates, "BLOCK", 8)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(40):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((f"{i:02d}", " ".join(t)))
    links = near_duplicates(spark.createDataFrame(rows, "chunk_id string, text string"), 0.6, 3)[1]
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if similarity(x, y) >= 0.6}
    assert {(r["class_a"], r["class_b"]) for r in links.collect()} == want and len(want) > 500


@pytest.mark.parametrize("groups", [(64, 8), (4, 2), (1, 1)])
def test_search_against_all_pairs(monkeypatch, groups):
    monkeypatch.setattr(duplicates, "GROUPS", groups)
    monkeypatch.setattr(duplicates, "PAIRS", 3_000)  # several lots
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 1 << 63, (400, 2), np.uint64)
    bits[50:180] = bits[50] ^ (np.uint64(1) << rng.integers(0, 40, (130, 2)).astype(np.uint64))
    starts, ends = np.array([0, 2, 40, 200, 201]), np.array([2, 40, 200, 201, 390])
    near = {(a, b) for s, e in zip(starts, ends) for a in range(s, e) for b in range(a + 1, e) if np.bitwise_count(bits[a] ^ bits[b]).sum() <= 20}
    assert {(int(i), int(j)) for i, j in zip(*search(bits, starts, ends, 20))} == near and len(near) > 1000
    left = np.arange(400) % 3 == 0
    want = {(a, b) for a, b in near if left[a] != left[b]}
    assert {(int(i), int(j)) for i, j in zip(*search(bits, starts, ends, 20, left))} == want
    assert len(search(bits, starts[:0], ends[:0], 20)[0]) == 0


def test_pruning_spares_pairs():
    """Groups that lie far apart are never opened."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 62, (8, 2), np.uint64)
    bits = np.repeat(centres, 64, axis=0) ^ (np.uint64(1) << rng.integers(0, 60, (512, 2)).astype(np.uint64))
    opened = []
    real = duplicates._crossed

    def count(first, n, p, q):
        opened.append(int((n[p] * n[q]).sum()))
        return real(first, n, p, q)

    duplicates._crossed = count
    try:
        i, _ = search(bits, np.array([0]), np.array([512]), 8)
    finally:
        duplicates._crossed = real
    assert len(i) == 8 * 64 * 63 // 2 and opened[-1] < 512 * 512 / 6


def test_ranks_sort_like_reflected_code():
    k = np.arange(64, dtype=np.uint64)
    assert (duplicates.ranks(k ^ (k >> np.uint64(1))) == k).all()
    # two words of a string: the second is reversed where the first is odd
    codes = [(a, b) for a in range(8) for b in range(8)]
    whole = [int(duplicates.ranks(np.array([a << 3 | b], np.uint64))[0]) for a, b in codes]
    a, b = np.array(codes, np.uint64).T
    r1 = duplicates.ranks(a)
    r2 = duplicates.ranks(b, r1 & np.uint64(1) > 0, 3)
    assert [int(x) for x in r1 * np.uint64(8) + r2] == whole


def test_nodes_are_masks_of_the_fingerprint():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 1 << 12, (5, duplicates.HASHES), np.uint16)
    v[1] = v[0]
    v[2, 4:8] = v[0, 4:8]
    n = duplicates.nodes_of(v)
    assert (n[0] == n[1]).all() and n[2, 1] == n[0, 1] and n[2, 0] != n[0, 0] and len(np.unique(n[0])) == duplicates.MASKS
    found = duplicates.sketches(v)
    half = duplicates.HASHES // 2
    assert found[0, 1] == sum(int(x & 1) << (half - 1 - k) for k, x in enumerate(v[0, half:])) and found[3, 2] == sum(int(x >> 1 & 1) << (half - 1 - k) for k, x in enumerate(v[3, :half]))
    import pyarrow as pa

    assert (duplicates.values_of(pa.array(duplicates.packed(v), pa.binary())) == v).all()


def test_runs_and_fingerprints_of_a_batch_are_those_of_each_text(monkeypatch):
    monkeypatch.setattr(duplicates, "RUNS", 50)
    rng = random.Random(2)
    texts = [[f"w{rng.randrange(500)}" for _ in range(n)] for n in (1, 2, 3, 900, 7, 40, 5, 260, 6)]
    parsed = [(t, k % 3 == 0) for k, t in enumerate(texts)]
    make = Shingles(3, 6)
    runs, first = make.all(parsed)
    prints = duplicates.fingerprints(runs, first)
    for k, (t, single) in enumerate(parsed):
        alone = Shingles(3, 6).of(t, single)
        assert set(alone.tolist()) == set(runs[first[k] : first[k + 1]].tolist())
        assert (duplicates.fingerprints(alone, np.array([0, len(alone)]))[0] == prints[k]).all()
    same = np.mean(duplicates.fingerprints(*make.all([(texts[3], False), (texts[3][100:], False)]))[0] == duplicates.fingerprints(*make.all([(texts[3][100:], False)]))[0])
    assert abs(same - 800 / 900) < 0.1


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    """A filter far too small lets texts through that are no candidates; the pairs are the same."""
    df = spark.createDataFrame(corpus(), "chunk_id string, text string")
    whole = sorted(map(tuple, near_duplicates(df, 0.6, 3)[1].collect()))
    monkeypatch.setattr(duplicates, "FILTER_BITS", (64, 64))
    assert sorted(map(tuple, near_duplicates(df, 0.6, 3)[1].collect())) == whole


def test_hot_class_of_copies(spark, monkeypatch):
    """More copies than a block holds, of two texts that are linked."""
    monkeypatch.setattr(duplicates, "BLOCK", 4)
    members = spark.createDataFrame([(f"a{i}", "a0") for i in range(10)] + [(f"b{i}", "b0") for i in range(9)] + [("c", "c")], "id string, class_id string")
    links = spark.createDataFrame([("a0", "b0", 0.7)], "class_a string, class_b string, similarity double")
    ids = [f"{x}{i}" for x, n in (("a", 10), ("b", 9)) for i in range(n)]
    got = [(r["id_a"], r["id_b"]) for r in member_pairs(members, links).collect()]
    assert sorted(got) == sorted(itertools.combinations(sorted(ids), 2))


def test_release_deletes_what_a_round_wrote(spark):
    import os

    from gleanery.session import cut, release

    df = cut(spark.range(10))
    folder = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(folder)
    release(df)
    assert not os.path.exists(folder)
    release(spark.range(3))


def test_words_of_scripts():
    assert words("Ärger im Haus") == (["ärger", "im", "haus"], False)
    assert words("净销售额2030年") == (["净", "销", "售", "额", "2030", "年"], True)
    assert words("की मांग") == (["की", "मांग"], False)
