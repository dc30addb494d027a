import os
import random

import numpy as np
import pytest

from granthika.operators import blocks, search
from granthika.plans import catalogue
from test_core import python_tfidf

WORDS = [f"word{i}" for i in range(40)]


def texts(n, most, seed):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [" ".join(rng.choices(WORDS, weights, k=rng.randint(1, most))) for _ in range(n)]


@pytest.mark.parametrize("k", [1, 3])
def test_blocks_keep_every_best(spark, monkeypatch, k):
    """Blocks of other sizes and lists left unread change nothing; rows of one id are one item, an item without an id only counts."""
    monkeypatch.setattr(blocks.counted, "__defaults__", (13,))
    items, asking = texts(60, 12, 1), texts(25, 6, 2)
    rows = [(i, t) for i, t in enumerate(items)]
    cut = [(i, half) for i, t in rows for half in ((t[: t.rfind(" ")], t[t.rfind(" ") + 1 :]) if i == 7 and " " in t else (t,))]
    got = search.sparse_topk(spark.createDataFrame(rows, "chunk_id bigint, text string").repartition(2), spark.createDataFrame(list(enumerate(asking)), "request_id int, text string"), k)
    want = [(q, r + 1, j, s[j]) for q, s in enumerate(python_tfidf(items, asking)) for r, j in enumerate(sorted((j for j in range(60) if s[j] > 0), key=lambda j: (-s[j], j))[:k])]
    assert sorted(map(tuple, got.collect())) == want
    assert len(cut) == 61
    merged = blocks.merged(spark.createDataFrame(cut, "chunk_id bigint, text string"), "chunk_id", "text")
    assert merged.count() == 60 and sorted(merged.where("chunk_id = 7").first().text.split()) == sorted(items[7].split())
    unkeyed = spark.createDataFrame([(None, "common rare"), (1, "common"), (2, "other"), (3, "third")], "chunk_id bigint, text string")
    found = search.sparse_topk(unkeyed, spark.createDataFrame([(1, "common"), (2, "rare"), (None, "other")], "request_id int, text string"), k)
    assert [(x.request_id, x.chunk_id, x.score) for x in found.collect()] == [(1, 1, 1.0)]


def test_lists_that_cannot_win_are_left_unread():
    rng = np.random.default_rng(3)
    n, length = 4000, 12
    codes = np.concatenate([np.sort(rng.choice(50, length, replace=False, p=(p := 1 / np.arange(1, 51)) / p.sum())) for _ in range(n)])
    df = np.bincount(codes, minlength=50)
    lists = blocks.Lists(np.arange(n), np.arange(0, n * length + 1, length), codes, np.ones(len(codes), np.int64), np.log((n + 1) / (df + 1)) + 1, np.arange(50))
    full = np.zeros((n, 50))
    for t, (a, b, _) in lists.lists.items():
        full[lists.rows[a:b], t] = lists.weights[a:b]
    total = 0
    for _ in range(50):
        terms = rng.choice(50, 3, replace=False)
        w = np.log((n + 1) / (df[terms] + 1)) + 1
        w /= np.sqrt((w * w).sum())
        s = np.round(full[:, terms] @ w, 6)
        want = sorted(range(n), key=lambda i: (-s[i], i))[:3]
        keys, scores = lists.top(terms.tolist(), w.tolist(), 3)
        assert keys.tolist() == want and np.allclose(scores, s[want], atol=1.1e-6)
        total += df[terms].sum()
    assert lists.read < 0.9 * total and not lists.sums.any()


def test_sweep_stores_no_index(spark, tmp_path):
    """At 1 GB the stored index, with every term of every chunk, and all requests against all chunks took the time and the disk."""
    spark.createDataFrame([(i, t) for i, t in enumerate(texts(30, 9, 4))], "chunk_id bigint, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    asking = [*texts(9, 4, 5), "zebra", None, " "]
    spark.createDataFrame([(i, (t,)) for i, t in enumerate(asking)], "id bigint, query struct<text: string>").write.parquet(str(tmp_path / "interactions.parquet"))
    known = dict(catalogue._INDEXES)
    got = {r.threshold: (r.requests, r.answered) for r in catalogue.threshold_sweep(spark, str(tmp_path)).collect()}
    distinct = list(dict.fromkeys(t for t in asking if t and t.strip()))
    best = [max(s) for s in python_tfidf(texts(30, 9, 4), distinct)]
    assert got == {t: (len(distinct), sum(b >= t for b in best)) for t in catalogue.THRESHOLDS}
    assert catalogue._INDEXES == known and os.listdir(tmp_path)
