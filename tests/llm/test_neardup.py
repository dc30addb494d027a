import random

import numpy as np
import pytest

from granthika.llm import neardup as N


def corpus(seed: int, n: int = 150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.6:
            w = rng.choice(docs)[1].split()
            for _ in range(rng.randint(0, max(1, len(w) // 6))):
                j, r = rng.randrange(len(w)), rng.random()
                if r < 0.4:
                    w[j] = rng.choice(vocab)
                elif r < 0.7:
                    w.insert(j, rng.choice(vocab))
                elif len(w) > 2:
                    w.pop(j)
        else:
            w = [rng.choice(vocab[: rng.choice([3, 60])]) for _ in range(rng.choice([3, 6, 12, 25, 60, 130, 300, 700]))]
        docs.append((i, " ".join(w)))
    return docs


def brute(docs, k, t, least):
    sets = {}
    for i, x in docs:
        w = x.lower().split() if x else []
        if len(w) >= max(k, least):
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize(("k", "t", "least", "heavy"), [(3, 0.6, 0, None), (3, 0.6, 20, 30), (5, 0.8, 0, 60), (1, 0.6, 0, None), (2, 0.5, 0, 100)])
def test_equals_brute_force(spark, k, t, least, heavy):
    docs = corpus(k * 7 + (heavy or 0))
    df = spark.createDataFrame(docs, "id bigint, text string").repartition(3)
    got = [tuple(r) for r in N.near_duplicates(df, "id", "text", k, t, least, heavy=heavy).pairs().collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, k, t, least)


def test_groups_nulls_copies_and_extra_columns(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, long, "x"), (2, long, None), (3, long.upper(), "x"), (4, None, "x"), (5, "", "x"), (6, "other words that are all quite new here", "x"), (7, long + " eleven", "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, key string")
    got = {r.id: (r.group_id, r.copies, r.links) for r in N.near_duplicates(df, "id", "text", 3, 0.8).groups().collect()}
    assert got == {1: (1, 3, 1), 2: (1, 3, 1), 3: (1, 3, 1), 6: (6, 1, 0), 7: (1, 1, 1)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    assert N.near_duplicates(df, "id", "text").pairs().count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "key_a bigint, key_b bigint")
    got = {r.key: r.root for r in N.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_boundary_follows_cost():
    sizes = {100: 100_000, 5000: 3}
    assert N.choose_boundary(sizes, 0.6, 500.0) > 100
    assert N.choose_boundary(sizes, 0.6, 1.0) <= 100
    assert N.choose_boundary({100: 1000}, 0.6, 10_000.0) > 100
    assert N.list_length(np.array([1, 1, 1 + N.OCTAVE, 1 + 2 * N.OCTAVE], np.uint8), 1.0) == (1 + 1 + 4 + 16) / (1 + 1 + 2 + 4)


@pytest.mark.parametrize("heavy", [None, 1])
def test_hot_subsets_are_divided(spark, monkeypatch, heavy):
    """Every run stands in very many of 20,000 texts; lists are compared in pairs of blocks and lose no pair."""
    rng = np.random.default_rng(8)
    n, vocab = 20_000, 60
    sets = np.argsort(rng.random((n, vocab)), axis=1)[:, :8]
    held = np.zeros((n, vocab), np.float32)
    np.put_along_axis(held, sets, 1, axis=1)
    want = set()
    for lo in range(0, n, 4000):
        a, b = np.nonzero(held[lo : lo + 4000] @ held.T >= 7)
        want |= {(int(x) + lo, int(y)) for x, y in zip(a, b, strict=True) if x + lo < y}
    monkeypatch.setattr(N, "HOT", 700)
    df = spark.createDataFrame([(i, " ".join(f"w{x}" for x in s)) for i, s in enumerate(sets.tolist())], "id bigint, text string").repartition(4)
    got = [tuple(r) for r in N.near_duplicates(df, "id", "text", 1, 0.7, heavy=heavy).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_blocks_of_a_hot_list():
    keys = np.arange(1000, dtype=np.int64) * 7919
    sig, doc = N._spread(np.full(1000, 5, np.uint64), np.arange(1000), np.full(1000, 3.2 * N.HOT), keys)
    lists = {s: set(doc[sig == s]) for s in set(sig.tolist())}
    assert len(lists) == 10 and max(map(len, lists.values())) < 600
    together = np.zeros((1000, 1000), bool)
    for x in lists.values():
        together[np.ix_(list(x), list(x))] = True
    assert together.all()


def test_bitmaps_fold():
    h = N._mix(np.arange(1, 400, dtype=np.uint64))
    small = N._bitmaps(np.zeros(399, int), h, np.array([4]))
    large = N._bitmaps(np.zeros(399, int), h, np.array([16]))
    assert [int(N._folded(large, np.array([0]), np.array([16]), k, 4)[0]) for k in range(4)] == small.tolist()
