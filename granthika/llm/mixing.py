"""Mixing sources to target weights (problem 8).

The texts of a source are laid end to end and packed into blocks of a fixed number of tokens. The
mixture is a sequence of slots in output shards: each shard draws its source counts from a
multinomial, the n-th slot of a source takes block perm(n), where perm is a pseudorandom permutation
of the source's block numbers (another one for each pass over the source), and slots and blocks are
joined by block number. A source gives each block at most ``max_repeats`` times.

Scale: positions are running sums by (group, bucket), bucket totals first, so that no source, however
large, meets in one task. The permutation is computed, not stored. The join key (source, block) has
at most ``max_repeats`` slots and the few documents of one block on either side.

Edge cases: a null ``source`` belongs to no target but counts among all tokens; null texts have one
token; a source without documents or with a null or zero weight has no slots; sources that cannot
reach their share give all they may and the others share the rest in proportion; if none can give
more, the mixture is smaller than asked, and the report says so. Shares are drawn, so a source of share p
among n slots ends within a few times sqrt(n p (1 - p)) slots of its part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granthika.session import settle

BLOCK_TOKENS = 1024
SHARD_BLOCKS = 4096
BUCKET_ROWS = 100_000
SEED = 20240229


def source_name(source: Column) -> Column:
    """Names of sources vary in case and blanks."""
    return F.lower(F.regexp_replace(source, r"^[\s\x{a0}]+|[\s\x{a0}]+$", ""))


def _with_starts(df: DataFrame, group: str, bucket: str, order: str, size: str, start: str) -> DataFrame:
    """``start``: the sum of ``size`` over all earlier rows of the group, in order of (bucket, order)."""
    totals = df.groupBy(group, bucket).agg(F.sum(size).alias("total_"))
    ahead = totals.withColumn("ahead_", F.sum("total_").over(Window.partitionBy(group).orderBy(bucket)) - F.col("total_")).drop("total_")
    inside = F.sum(size).over(Window.partitionBy(group, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.join(ahead, [group, bucket]).withColumn(start, (F.col("ahead_") + F.coalesce(inside, F.lit(0))).cast("bigint")).drop("ahead_")


def permuted(n: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(size): a balanced Feistel network, walked until inside the range."""
    if size <= 1:
        return np.zeros_like(n)
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            h = (right + np.uint64((key * 4 + r) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            left, right = right, left ^ (h & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        x = once(n.astype(np.uint64))
        while (out := x >= np.uint64(size)).any():
            x[out] = once(x[out])
    return x.astype(np.int64)


def allot(weights: list[float], most: list[float], total: float) -> list[float]:
    """Shares of ``total`` in proportion to weights, none above its limit; what is cut goes to the others."""
    given = [0.0] * len(weights)
    free = [i for i, w in enumerate(weights) if w > 0]
    left = total
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if most[i] <= weights[i] * unit]
        if not full:
            for i in free:
                given[i] = weights[i] * unit
            break
        for i in full:
            given[i] = most[i]
            left -= most[i]
        free = [i for i in free if i not in full]
        if left <= 0:
            break
    return given


def blocks(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of documents in blocks: ``source``, ``block``, ``doc_id``, ``from_token``, ``to_token``."""
    docs = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text")
    sized = docs.withColumn("tokens", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")).drop("text")
    wanted = sized.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    buckets = max(1, -(-documents.count() // BUCKET_ROWS))
    placed = _with_starts(wanted.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))), "source", "bucket", "doc_id", "tokens", "start").drop("bucket")
    size = F.lit(block_tokens)
    last = F.col("start") + F.col("tokens")
    return (
        placed.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block_tokens}"), F.expr(f"(start + tokens - 1) div {block_tokens}"))))
        .select(
            "source", "block", "doc_id",
            F.greatest(F.lit(0), F.col("block") * size - F.col("start")).alias("from_token"),
            (F.least(last, (F.col("block") + 1) * size) - F.col("start")).alias("to_token"),
        )
    )


def plan(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS) -> pd.DataFrame:
    """A row per target (a fixed, small table): what the source has, may give, and is allotted.

    Names that differ only in case or blanks are one source: weights add up, the larger repeat count holds.
    """
    sized = documents.select(source_name(F.col("source")).alias("source"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("tokens"))
    want = targets.where("source is not null").select(source_name(F.col("source")).alias("source"), "target_weight", "max_repeats").groupBy("source").agg(F.sum(F.coalesce("target_weight", F.lit(0.0))).alias("target_weight"), F.max(F.coalesce("max_repeats", F.lit(0))).cast("bigint").alias("max_repeats"))
    held = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    tagged = held.join(F.broadcast(want.select("source", F.lit(True).alias("wanted"))), "source", "left")
    sums = tagged.groupBy(F.when(F.col("wanted"), F.col("source")).alias("source")).agg(F.sum("tokens").alias("tokens")).collect()
    has = {r.source: r.tokens for r in sums}
    rows = want.orderBy("source").toPandas()
    rows["tokens"] = [int(has.get(s, 0)) for s in rows["source"]]
    rows["all_tokens"] = int(sum(has.values()))
    total = rows["all_tokens"].iloc[0] if total_tokens is None and len(rows) else (total_tokens or 0)
    rows["blocks"] = [-(-t // block_tokens) for t in rows["tokens"]]
    rows["most"] = rows["tokens"] * rows["max_repeats"]
    rows["allotted"] = allot(list(rows["target_weight"]), [float(x) for x in rows["most"]], float(total))
    return rows


def _draws(spark, names: list[str], p: np.ndarray, total: int, shard_blocks: int, seed: int, first: int = 0) -> DataFrame:
    """Multinomial counts of each shard from number ``first`` on: ``shard``, ``bucket``, ``source``, ``n``."""
    shards = max(1, -(-total // shard_blocks))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf["id"]:
                n = min(shard_blocks, total - int(s) * shard_blocks)
                if len(p):
                    counts = np.random.default_rng([seed, first + int(s)]).multinomial(n, p)
                    yield pd.DataFrame({"shard": first + int(s), "bucket": (first + int(s)) // 4096, "source": names, "n": counts})

    return spark.range(0, shards, 1, min(shards, max(1, shards // 64))).mapInPandas(draw, "shard bigint, bucket bigint, source string, n bigint")


def _sum_of(draws: DataFrame) -> dict[str, int]:
    """Slots drawn by source, a row for each of the few targets."""
    return {r.source: r.n for r in draws.groupBy("source").agg(F.sum("n").alias("n")).collect()}


def slots(spark, rows: pd.DataFrame, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """The mixture as slots: ``shard``, ``slot``, ``source``, ``repeat``, ``block``.

    Slots that a draw gives to a source beyond its last repeat are drawn again, in shards that follow,
    among the sources that have blocks left.
    """
    rows = rows[(rows["allotted"] > 0) & (rows["blocks"] > 0)]
    names, n_blocks, repeats = list(rows["source"]), [int(x) for x in rows["blocks"]], [int(x) for x in rows["max_repeats"]]
    # Blocks are full but for a source's last one; a source is allotted in blocks of its own mean size.
    share = np.array([a / max(1.0, t / b) for a, t, b in zip(rows["allotted"], rows["tokens"], n_blocks, strict=True)], float)
    most = np.array([b * r for b, r in zip(n_blocks, repeats, strict=True)], float)
    left = int(round(share.sum()))
    counts, first, held = None, 0, np.zeros(len(names))
    while counts is None or (left > 0 and (held < most).any()):
        free = share * (held < most)
        part = _draws(spark, names, free / free.sum() if free.sum() else np.zeros(0), left, shard_blocks, seed, first)
        counts = part if counts is None else counts.unionByName(part)
        first += max(1, -(-left // shard_blocks))
        got = _sum_of(part)
        drawn = held + np.array([got.get(x, 0) for x in names], float)
        left = int(np.maximum(drawn - most, 0).sum())
        held = np.minimum(drawn, most)
    runs = _with_starts(counts, "source", "bucket", "shard", "n", "start")
    order = {s: i for i, s in enumerate(names)}

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                i = order[r.source]
                n = np.arange(r.start, min(r.start + r.n, n_blocks[i] * repeats[i]), dtype=np.int64)
                if not len(n):
                    continue
                passes = n // n_blocks[i]
                block = np.empty_like(n)
                for e in np.unique(passes):
                    at = passes == e
                    block[at] = permuted(n[at] % n_blocks[i], n_blocks[i], seed + 1009 * i + 100_003 * int(e))
                # The place in the shard is drawn too, so that sources alternate; ties go by source and number.
                place = np.random.default_rng([seed, int(r.shard), i]).random(len(n))
                yield pd.DataFrame({"shard": r.shard, "place": place, "source": r.source, "repeat": passes, "block": block})

    filled = runs.where("n > 0").mapInPandas(fill, "shard bigint, place double, source string, repeat bigint, block bigint")
    return filled.withColumn("slot", F.row_number().over(Window.partitionBy("shard").orderBy("place", "source", "repeat", "block")) - 1).drop("place")


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> tuple[DataFrame, pd.DataFrame]:
    """Slots joined with the pieces of documents that fill them, and the plan behind them."""
    rows = plan(documents, targets, total_tokens, block_tokens)
    wanted = targets.sparkSession.createDataFrame([(s,) for s in rows["source"]], "source string")
    placed = slots(documents.sparkSession, rows, block_tokens, shard_blocks, seed)
    # Both sides grow with the corpus, so neither may be broadcast.
    return placed.hint("merge").join(blocks(documents, wanted, block_tokens), ["source", "block"]), rows


#: So many standard errors of the draw a source's slots may fall short and still be looked at exactly.
MARGIN = 8.0


def report(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """Target and reached share of each source, and whether its repeats suffice for the target.

    ``wanted_slots`` is drawn at the target weights alone, ``supply_tokens`` is what the blocks of the mixture
    hold times the repeats, ``unfilled_slots`` what the draw wants beyond them. Where the drawn slots, with
    ``MARGIN`` times the draw's own error of sqrt(n p (1 - p)) slots, reach the supply, an exact comparison
    of tokens decides ``short``; no other source can be short.
    """
    mixed, rows = mixture(documents, targets, total_tokens, block_tokens, shard_blocks, seed)
    spark = documents.sparkSession
    reached = mixed.groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("mixed_tokens"), F.max("repeat").alias("last_repeat"))
    held = blocks(documents, spark.createDataFrame([(s,) for s in rows["source"]], "source string"), block_tokens).groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("held_tokens"), F.countDistinct("block").alias("held_blocks"))
    weights = rows["target_weight"].to_numpy(float)
    total = int(rows["all_tokens"].iloc[0]) if total_tokens is None and len(rows) else (total_tokens or 0)
    n = max(1, -(-total // block_tokens))
    p = weights / weights.sum() if weights.sum() else np.zeros(0)
    wanted = _draws(spark, list(rows["source"]), p, n, shard_blocks, seed + 1).groupBy("source").agg(F.sum("n").alias("wanted_slots"))
    fixed = spark.createDataFrame([tuple(x) for x in rows[["source", "target_weight", "max_repeats", "tokens", "all_tokens", "allotted"]].itertuples(index=False)], "source string, target_weight double, max_repeats bigint, tokens bigint, all_tokens bigint, allotted double")
    joined = fixed.join(settle(reached), "source", "left").join(settle(held), "source", "left").join(wanted, "source", "left").na.fill(0, ["mixed_tokens", "held_tokens", "held_blocks", "wanted_slots"])
    supply = (F.col("held_tokens") * F.col("max_repeats")).alias("supply_tokens")
    shown = joined.withColumn("supply_tokens", supply).withColumn("unfilled_slots", F.greatest(F.col("wanted_slots") - F.col("held_blocks") * F.col("max_repeats"), F.lit(0)))
    # Slots are of a full block's size; the weights may sum to another number than 1.
    error = F.sqrt(F.lit(float(n)) * F.col("target_weight")) * MARGIN + 1
    reaches = (F.col("wanted_slots") * F.lit(float(weights.sum()) or 1.0) + error) * block_tokens >= F.col("supply_tokens")
    exactly = F.col("tokens") * F.col("max_repeats") < F.col("target_weight") * F.col("all_tokens")
    return (
        shown.withColumn("short", reaches & exactly)
        .withColumn("reached_share", F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1))), F.lit(0)))
        .withColumn("repeats_used", F.coalesce(F.col("last_repeat") + 1, F.lit(0))).drop("last_repeat", "held_tokens", "held_blocks")
    )


def found(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources whose every permitted repeat is less than their target in a mixture as large as the corpus.

    Their slots, drawn at the target weights, run out of blocks; the exact comparison follows.
    """
    return report(documents, targets).where("short").select("source")
