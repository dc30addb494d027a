"""Filling fixed-capacity containers with items (problem 7).

Bounded-space online best fit: a task holds at most ``OPEN_BINS`` open bins. Their free spaces are a
bitset (bit f is set while some open bin has f tokens free), so the tightest bin that takes an item
is the lowest set bit from the item's size on. Where none takes it, a bin opens; if too many are
open, the fullest closes first. Items above the capacity are cut into full containers and a rest.

Scale: items are spread by a hash of their id, each task packs its share as a stream and keeps only
the open bins in memory. What is still open at the end of a task (at most ``OPEN_BINS`` bins) is
merged with the like of other tasks in a second, much smaller round, again by best fit.

Edge cases: a null or empty text has one token, the end mark; equal ids are packed in order of size;
capacities must be positive (others are ignored); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthika.session import settle

OPEN_BINS = 64
ITEMS_PER_TASK = 250_000
MERGE_TASKS = 32


class Packer:
    """Online best fit over a bounded number of open bins; ``add`` gives the bin of an item."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bits = 0
        self.by_free: dict[int, list[int]] = {}
        self.open = 0
        self.made = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        b = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        return b

    def _put(self, b: int, free: int) -> None:
        self.by_free.setdefault(free, []).append(b)
        self.bits |= 1 << free

    def add(self, size: int) -> int:
        fits = self.bits >> size
        if fits:
            free = (fits & -fits).bit_length() - 1 + size
            b = self._take(free)
            free -= size
        else:
            b = self.made
            self.made += 1
            free = self.capacity - size
            if free and self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            if free:
                self.open += 1
        if free:
            self._put(b, free)
        elif fits:
            self.open -= 1
        return b

    def left_open(self) -> dict[int, int]:
        """Fill of the bins that are still open."""
        return {b: self.capacity - f for f, bs in self.by_free.items() for b in bs}


def sized_documents(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``tokens``: the UTF-8 bytes of the text and one end mark."""
    return documents.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("tokens"))


def pack(items: DataFrame, capacities: list[tuple[str, int]], id_col: str = "doc_id", size: str = "tokens", items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """Every item in every kind of container.

    Columns: ``container``, ``bin``, ``id_col``, ``piece``, ``pieces``, ``start``, ``tokens``. A bin is
    named by its task and number; only items above the capacity have several pieces.
    """
    capacities = [(str(c), int(k)) for c, k in capacities if c is not None and k is not None and k > 0]
    items = items.where(F.col(id_col).isNotNull() & F.col(size).isNotNull()).select(id_col, size)
    tasks = max(1, -(-items.count() // items_per_task))
    kind = dict(items.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        packers = [Packer(k) for _, k in capacities]
        for pdf in batches:
            sizes = pdf[size].tolist()
            if not sizes:
                continue
            for (name, cap), packer in zip(capacities, packers, strict=True):
                at, bins, piece, count, start, tokens = [], [], [], [], [], []
                for i, s in enumerate(sizes):
                    if s <= cap:
                        at.append(i), bins.append(packer.add(s)), piece.append(0), count.append(1), start.append(0), tokens.append(s)
                    else:
                        n = -(-s // cap)
                        for p in range(n):
                            part = min(cap, s - p * cap)
                            at.append(i), bins.append(packer.add(part)), piece.append(p), count.append(n), start.append(p * cap), tokens.append(part)
                yield pd.DataFrame({"container": name, "bin": [f"{task}-{b}" for b in bins], id_col: pdf[id_col].to_numpy()[at], "piece": piece, "pieces": count, "start": start, "tokens": tokens, "open": False})
        for (name, _), packer in zip(capacities, packers, strict=True):
            left = packer.left_open()
            if left:
                yield pd.DataFrame({"container": name, "bin": [f"{task}-{b}" for b in left], id_col: pd.array([0] * len(left)) if kind != "string" else "", "piece": -1, "pieces": 0, "start": 0, "tokens": list(left.values()), "open": True})

    rows = (
        items.repartition(tasks, F.xxhash64(id_col)).sortWithinPartitions(F.xxhash64(id_col), id_col, size)
        .mapInPandas(run, f"container string, bin string, `{id_col}` {kind}, piece int, pieces int, start bigint, tokens bigint, open boolean")
    )
    if tasks == 1:
        return rows.where("not open").drop("open")
    rows = settle(rows)
    room = dict(capacities)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        packers = {c: Packer(k, 10 * OPEN_BINS) for c, k in room.items()}
        for pdf in batches:
            if not len(pdf):
                continue
            into = [packers[c].add(int(t)) for c, t in zip(pdf["container"], pdf["tokens"], strict=True)]
            yield pd.DataFrame({"container": pdf["container"], "bin": pdf["bin"], "merged": [f"m{task}-{b}" for b in into]})

    merged = (
        rows.where("open").repartition(max(1, tasks // MERGE_TASKS), F.xxhash64("bin")).sortWithinPartitions(F.desc("tokens"), "bin", "container")
        .mapInPandas(merge, "container string, bin string, merged string")
    )
    return rows.where("not open").join(merged, ["container", "bin"], "left").withColumn("bin", F.coalesce("merged", "bin")).drop("merged", "open")


def capacities_of(containers: DataFrame) -> list[tuple[str, int]]:
    """The kinds of container: a fixed table of a few rows."""
    return [(r.container, r.capacity_tokens) for r in containers.select("container", "capacity_tokens").orderBy("container").collect()]


def packed_documents(documents: DataFrame, containers: DataFrame, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    return pack(sized_documents(documents), capacities_of(containers), items_per_task=items_per_task)


def use_of_space(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Bins, tokens and the share of room filled, of each container."""
    bins = packed.groupBy("container", "bin").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    return bins.groupBy("container").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.sum("items").alias("items"), F.max("tokens").alias("fullest")).join(F.broadcast(containers.select("container", "capacity_tokens")), "container").withColumn("filled", F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")))


def found(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """Documents that had to be split, for each container."""
    return packed_documents(documents, containers).where("pieces > 1 and piece = 0").select("container", "doc_id")
