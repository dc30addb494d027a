import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granthika.llm import mixing as M
from granthika.llm import packing as P


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(50, 90), st.integers(1, 8))
def test_packer_never_overfills(sizes, capacity, open_bins):
    packer = P.Packer(capacity, open_bins)
    fill = {}
    for s in sizes:
        b = packer.add(s)
        fill[b] = fill.get(b, 0) + s
        assert packer.open == len(packer.left_open()) <= open_bins
    assert all(f <= capacity for f in fill.values())
    assert all(fill[b] == f for b, f in packer.left_open().items())


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, bin string")


def test_pack_whole(spark):
    rows = [(i, "x" * (i % 37), "a", "clash") for i in range(500)] + [(900, "y" * 250, "a", None), (901, None, None, None), (3, "zz", "a", None)]
    cont = spark.createDataFrame([("s", 40), ("l", 100), ("bad", 0)], "container string, capacity_tokens int")
    for per_task in (100_000, 60):
        got = P.packed_documents(docs(spark, rows), cont, per_task).persist()
        assert got.groupBy("container", "bin").agg(F.sum("tokens").alias("t")).join(cont, "container").where("t > capacity_tokens").count() == 0
        total = sum(len(t or "") + 1 for _, t, _, _ in rows)
        assert {r.container: r.t for r in got.groupBy("container").agg(F.sum("tokens").alias("t")).collect()} == {"s": total, "l": total}
        assert {(r.container, r.doc_id) for r in got.where("pieces > 1").collect()} == {("s", 900), ("l", 900)}
        assert min(r.filled for r in P.use_of_space(got, cont).collect()) > 0.8
    assert P.packed_documents(docs(spark, []), cont).count() == 0


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 1025):
        for key in (1, 7):
            assert sorted(M.permuted(np.arange(n), n, key)) == list(range(n))


def test_allot():
    assert np.allclose(M.allot([0.5, 0.5], [100, 10], 60), [50, 10])
    assert np.allclose(M.allot([0.2, 0.8], [5, 5], 60), [5, 5])
    assert M.allot([0.0, 1.0], [5, 50], 20) == [0.0, 20.0]


def test_mixture(spark):
    rows = [(i, "x" * 99, " Big", None) for i in range(300)] + [(1000 + i, "y" * 49, "SMALL ", None) for i in range(20)] + [(2000, None, None, None), (2001, "z" * 500, "unwanted", None)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("missing", 0.2, 9)], "source string, target_weight double, max_repeats int")
    mixed, plan = M.mixture(docs(spark, rows), targets, block_tokens=64, shard_blocks=50)
    used = mixed.groupBy("source", "block").agg(F.countDistinct("shard", "slot").alias("n"), F.countDistinct("repeat").alias("r")).collect()
    assert all(r.n == r.r for r in used) and max(r.n for r in used if r.source == "small") <= 3 and max(r.n for r in used if r.source == "big") == 1
    per_slot = mixed.groupBy("shard", "slot").agg(F.countDistinct("source").alias("s"), F.sum(F.col("to_token") - F.col("from_token")).alias("t")).collect()
    assert all(r.s == 1 and r.t <= 64 for r in per_slot)
    got = {r.source: r for r in M.report(docs(spark, rows), targets, block_tokens=64, shard_blocks=50).collect()}
    assert {s for s, r in got.items() if r.short} == {"small", "missing"}
    assert got["missing"].mixed_tokens == 0 and 2700 <= got["small"].mixed_tokens <= 3000
    assert sorted(r.source for r in M.found(docs(spark, []), targets).collect()) == []


def test_blocks_cover_texts(spark):
    rows = [(i, "x" * (i * 7 % 83), "a", None) for i in range(60)]
    got = M.blocks(docs(spark, rows), spark.createDataFrame([("a",)], "source string"), 64).groupBy("doc_id").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("t"), F.min("from_token").alias("f"), F.max("to_token").alias("e")).collect()
    assert {r.doc_id: (r.t, r.f, r.e) for r in got} == {i: (len(t) + 1, 0, len(t) + 1) for i, t, _, _ in rows}


def test_flags_come_from_the_draw(spark, monkeypatch):
    """Without drawn slots no source runs out of blocks, so none is found."""
    rows = [(i, "x" * 99, "big", None) for i in range(300)] + [(1000 + i, "y" * 49, "small", None) for i in range(20)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3)], "source string, target_weight double, max_repeats int")
    assert [r.source for r in M.found(docs(spark, rows), targets).collect()] == ["small"]
    draws = M._draws
    monkeypatch.setattr(M, "_draws", lambda *a: draws(*a).withColumn("n", F.lit(0).cast("bigint")))
    monkeypatch.setattr(M, "MARGIN", 0.0)
    assert M.found(docs(spark, rows), targets).count() == 0


def test_slots_beyond_the_supply_are_drawn_again(spark):
    """Both sources are allotted almost all they have: no slot is lost while one has blocks left."""
    rows = pd.DataFrame({"source": ["a", "b", "c"], "blocks": [100, 100, 5000], "max_repeats": [2, 1, 1], "tokens": [6400, 6400, 320_000], "allotted": [12_800.0, 6400.0, 100_000.0]})
    got = M.slots(spark, rows, 64, 100).groupBy("source").count().collect()
    have = {r.source: r["count"] for r in got}
    assert sum(have.values()) == round(119_200 / 64) and have["a"] <= 200 and have["b"] <= 100
