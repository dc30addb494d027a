"""Lines repeated across one site's documents (problem 6).

Each document is a sequence of line identifiers. Per site these sequences are laid end to end, with
marks that never repeat between them, and a suffix array with the common prefixes of neighbours is
built over them by doubling. A run of neighbours that share d lines is a block of d lines; it is
furniture when it stands under enough distinct content ids of the site. Only maximal blocks are kept:
a block whose every occurrence follows the same line, or is followed by the same line, is part of a
longer one with the same occurrences. Blocks are deleted where they stand, whatever their depth, so a
line inside a longer block goes by that block alone. Since each line of a block stands under at least
as many content ids as the block, no line goes that the threshold would not take alone.

Scale: a site's documents are divided into chunks of about ``CHUNK_LINES`` lines by content id, a hot
content id over all chunks of its site, so neither a hot site, a hot line nor a hot content id meets
in one task. A block that qualifies in the site reaches the site's share in at least one chunk, so the
chunks' own blocks are candidates that miss nothing; where a site has several chunks, the candidates
are counted again over all of them, each block with its distinct content ids. There all of a block's
parts are candidates, half the square of its lines.

Edge cases: columns of the input named ``own_text`` or as in ``_OWN`` are replaced, others are kept;
rows with null ``source`` or null ``text`` have no lines; a null ``content_id`` is not
counted; lines with fewer than ``MIN_LETTERS`` letters never qualify; null and repeated ids are rows
like any other; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthika.session import settle

MIN_LETTERS = 15
MIN_CONTENTS = 5
MIN_SHARE = 0.05
CHUNK_LINES = 500_000
#: Up to so many blocks (16 bytes each) go to every executor; beyond, the rows go to the blocks.
BROADCAST_BLOCKS = 500_000
#: Columns made on the way; a table's own columns of these names give way.
_OWN = ("site_line_nos", "site_key_", "line_keys_", "row_")
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def site_of(source: Column) -> Column:
    """Lower-cased host of a URL; text before the first slash where there is no scheme."""
    return F.lower(F.regexp_extract(F.trim(source), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _letters(line: Column) -> Column:
    return F.lower(F.regexp_replace(line, r"\P{L}+", ""))


def _line_keys(text: Column) -> Column:
    """One identifier per line; 0 for a line too short to count."""
    return F.transform(
        F.transform(F.split(text, "\n", -1), _letters),
        lambda x: F.when(F.length(x) >= MIN_LETTERS, F.xxhash64(x)).otherwise(F.lit(0).cast("bigint")),
    )


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Sequence:
    """Line identifiers of many documents laid end to end; ``line`` is 0 where no block may reach."""

    def __init__(self, site: np.ndarray, keys: list[np.ndarray]):
        n = np.array([len(k) for k in keys], np.int64)
        self.doc = np.repeat(np.arange(len(keys)), n + 1)
        self.starts = np.concatenate([[0], np.cumsum(n + 1)[:-1]]) if len(keys) else np.zeros(0, np.int64)
        flat = np.zeros(len(self.doc), np.uint64)
        at = np.ones(len(flat), bool)
        at[self.starts + n] = False
        flat[at] = np.concatenate([np.asarray(k, np.int64) for k in keys]).view(np.uint64) if len(keys) else []
        # Equal lines of two sites are two identifiers.
        self.line = np.where(flat != 0, _mix(flat ^ site.view(np.uint64)[self.doc]) | np.uint64(1), np.uint64(0))
        # Sums of line / base^position, so that a window's hash is a difference times base^start.
        self.powers = _powers(_BASE, len(flat))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(self.line) * _powers(_INVERSE, len(flat)), dtype=np.uint64)])
        ends = np.flatnonzero(self.line == 0)
        self.room = ends[np.searchsorted(ends, np.arange(len(flat)))] - np.arange(len(flat)) if len(flat) else np.zeros(0, np.int64)

    def hashes(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Hash of the block of ``depth`` lines at each position, the same wherever it stands."""
        return _mix((self.sums[at + depth] - self.sums[at]) * self.powers[at] + np.uint64(depth))

    def before(self, at: np.ndarray) -> np.ndarray:
        """Identifier of the line before; 0 at a text's start or after a line that doesn't count."""
        return np.where(at > 0, self.line[at - 1], np.uint64(0))


def suffix_array(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the suffixes that begin with a line that counts, in order, and the lines each shares with the one before it.

    A line that doesn't count (0) never equals another, so common prefixes end there.
    """
    n = len(line)
    at = np.flatnonzero(line)
    if not len(at):
        return at, at
    _, first = np.unique(line[at], return_inverse=True)
    rank = np.zeros(n, np.int64)
    rank[at] = first + 1
    blank = np.flatnonzero(line == 0)
    rank[blank] = len(at) + 1 + np.arange(len(blank))
    levels = [rank]
    h = 1
    while True:
        key = levels[-1] * np.int64(2 * n + 2)
        key[: max(0, n - h)] += levels[-1][h:]
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]])) + 1
        levels.append(new)
        h *= 2
        if h >= n or len(order) == new.max():
            break
    sa = order[line[order] != 0]
    shared = np.zeros(len(sa), np.int64)
    a, b = sa[1:].copy(), sa[:-1].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = same * (1 << k)
        a, b = a + step, b + step
    shared[1:] = a - sa[1:]
    return sa, shared


def blocks_of(seq: Sequence, content: np.ndarray, least: np.ndarray, every: np.ndarray) -> pd.DataFrame:
    """Blocks with at least ``least`` (by document) distinct content ids: ``doc`` (one that shows it), ``depth``, ``block``, ``contents``.

    Only maximal blocks, but all of them for the documents that ``every`` marks.
    """
    sa, shared = suffix_array(seq.line)
    out = []
    before, of = seq.before(sa), content[seq.doc[sa]]
    depth = 1
    live = np.arange(len(sa))
    while len(live):
        # Runs of neighbours that share ``depth`` lines; a place that left the search begins a new one.
        live = live[seq.room[sa[live]] >= depth]
        new = np.ones(len(live), bool)
        new[1:] = (shared[live][1:] < depth) | (np.diff(live) != 1)
        if not len(live):
            break
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(live)))
        o = np.lexsort((of[live], run))
        other = np.ones(len(live), bool)
        other[1:] = (run[o][1:] != run[o][:-1]) | (of[live][o][1:] != of[live][o][:-1])
        contents = np.bincount(run[o][other], minlength=len(starts))
        doc = seq.doc[sa[live[starts]]]
        good = contents >= least[doc]
        # Maximal: not always after the same line, and not always before the same line.
        left = np.minimum.reduceat(before[live], starts)
        goes_left = (left == np.maximum.reduceat(before[live], starts)) & (left != 0)
        after = np.zeros(len(live), np.uint64)
        reach = seq.room[sa[live]] > depth
        after[reach] = seq.line[sa[live[reach]] + depth]
        right = np.minimum.reduceat(after, starts)
        goes_right = (right == np.maximum.reduceat(after, starts)) & (right != 0)
        take = np.flatnonzero(good & (every[doc] | ~(goes_left | goes_right)))
        if len(take):
            out.append(pd.DataFrame({"doc": doc[take], "depth": depth, "block": seq.hashes(sa[live[starts[take]]], depth).view(np.int64), "contents": contents[take], "shown": size[take]}))
        live = live[np.repeat(good, size)]
        depth += 1
    return pd.concat(out) if out else pd.DataFrame({"doc": np.zeros(0, int), "depth": 0, "block": 0, "contents": 0, "shown": 0})


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole (site, chunk) groups of sorted rows, small ones together."""
    held: list[pa.RecordBatch] = []
    lines = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        site, chunk = batch.column("site").to_numpy(), batch.column("chunk").to_numpy()
        cuts = np.flatnonzero((site[1:] != site[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        if held:
            last = held[-1]
            if last.column("site")[-1].as_py() != site[0] or last.column("chunk")[-1].as_py() != chunk[0]:
                cuts = np.concatenate([[0], cuts])
        sizes = np.cumsum(batch.column("keys").value_lengths().to_numpy(zero_copy_only=False))
        done = 0
        for c in cuts:
            if lines + (sizes[c - 1] if c else 0) - (sizes[done - 1] if done else 0) >= CHUNK_LINES:
                if c > done:
                    held.append(batch.slice(done, c - done))
                yield pa.Table.from_batches(held)
                held, lines, done = [], 0, c
        if done < batch.num_rows:
            held.append(batch.slice(done))
            lines += sizes[-1] - (sizes[done - 1] if done else 0)
    if held:
        yield pa.Table.from_batches(held)


def _sequence(t: pa.Table) -> Sequence:
    t = t.combine_chunks()
    return Sequence(t.column("site").to_numpy(), _lists(t.column("keys").combine_chunks()))


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Blocks that reach the site's share in a chunk."""
    for t in _groups(batches):
        site, chunk, content = (t.column(c).to_numpy() for c in ("site", "chunk", "content"))
        # The share of all (chunk, content id) pairs of the site that a block needs, of this chunk's content ids.
        names = pd.DataFrame({"site": site, "chunk": chunk, "content": content})
        here = names.groupby(["site", "chunk"])["content"].transform("nunique").to_numpy()
        least = np.ceil(t.column("rate").to_numpy() * here - 1e-9).clip(1)
        got = blocks_of(_sequence(t), content, least, t.column("chunks").to_numpy() > 1)
        if len(got):
            yield pd.DataFrame({"site": site[got["doc"]], "depth": got["depth"].astype("int32"), "block": got["block"], "contents": got["contents"], "several": t.column("chunks").to_numpy()[got["doc"]] > 1})


def _as_arrow(fn, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in fn(batches):
            yield pa.RecordBatch.from_pandas(pdf, schema=schema, preserve_index=False)

    return run


def with_line_keys(chapters: DataFrame) -> DataFrame:
    """``chapters`` with ``site_key_`` (null without source or text), ``line_keys_`` and ``row_``, its own number; written once."""
    known = F.col("source").isNotNull() & F.col("text").isNotNull()
    keyed = chapters.drop("own_text", *_OWN).withColumn("site_key_", F.when(known, F.xxhash64(site_of(F.col("source"))))).withColumn("line_keys_", F.when(known, _line_keys(F.col("text"))))
    return settle(keyed.withColumn("row_", F.monotonically_increasing_id()))


def repeated_blocks(keyed: DataFrame) -> DataFrame:
    """Maximal blocks that qualify, of any depth: ``site_key``, ``depth``, ``block`` (hash), ``contents``; ``keyed`` as ``with_line_keys`` gives it.

    In sites of several chunks the parts of a block qualify as blocks of their own.
    """
    docs = keyed.where("site_key_ is not null and content_id is not null").select(F.col("site_key_").alias("site"), F.xxhash64("content_id").alias("content"), F.col("line_keys_").alias("keys"), "row_")
    held = settle(docs.groupBy("site", "content").agg(F.sum(F.size("keys") + 1).alias("lines")))
    site = held.groupBy("site").agg(F.count("*").alias("site_contents"), F.sum("lines").alias("lines"), F.count_if(F.col("lines") > CHUNK_LINES).alias("hot"))
    # A hot content id counts once in each chunk of its site.
    rated = settle(site.withColumn("chunks", F.ceil(F.col("lines") / CHUNK_LINES).cast("bigint")).withColumn("least", F.greatest(F.lit(float(MIN_CONTENTS)), F.lit(MIN_SHARE) * F.col("site_contents"))).withColumn("rate", F.col("least") / (F.col("site_contents") + F.col("hot") * (F.col("chunks") - 1))))
    hot = held.where(F.col("lines") > CHUNK_LINES).select("site", "content", F.lit(True).alias("is_hot"))
    placed = docs.where(F.exists("keys", lambda k: k != 0)).join(rated.select("site", "chunks", "rate"), "site").join(hot, ["site", "content"], "left")
    placed = placed.withColumn("chunk", F.pmod(F.when(F.col("is_hot"), F.xxhash64("row_")).otherwise(F.col("content")), F.col("chunks"))).drop("is_hot", "row_")
    fields = pa.schema([("site", pa.int64()), ("depth", pa.int32()), ("block", pa.int64()), ("contents", pa.int64()), ("several", pa.bool_())])
    found = settle(placed.repartition("site", "chunk").sortWithinPartitions("site", "chunk").mapInArrow(_as_arrow(_candidates, fields), "site bigint, depth int, block bigint, contents bigint, several boolean"))
    once = found.where("not several").select("site", "depth", "block", "contents")
    again = _recounted(placed.where("chunks > 1"), found.where("several").select("site", "depth", "block").distinct())
    return once.unionByName(again).join(rated.select("site", "least"), "site").where("contents >= least").select(F.col("site").alias("site_key"), "depth", "block", "contents")


def _recounted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Distinct content ids of each wanted block over all chunks of its site."""
    chunks = docs.select("site", "chunk").distinct().toDF("site", "chunk")
    there = wanted.join(chunks, "site").toDF("site", "depth", "block", "chunk")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            seq = Sequence(left["site"].to_numpy(), list(left["keys"]))
            for depth, part in right.groupby("depth"):
                at = np.flatnonzero(seq.room >= depth)
                h = seq.hashes(at, int(depth)).view(np.int64)
                hit = np.isin(h, part["block"].to_numpy())
                pairs = pd.DataFrame({"depth": depth, "block": h[hit], "content": left["content"].to_numpy()[seq.doc[at[hit]]]}).drop_duplicates()
                out.append(pairs)
        rows = pd.concat(out) if out else pd.DataFrame({"depth": [], "block": [], "content": []})
        rows.insert(0, "site", key[0])
        return rows.astype({"depth": "int32", "block": "int64", "content": "int64"})

    pairs = docs.select("site", "chunk", "content", "keys").groupBy("site", "chunk").cogroup(there.groupBy("site", "chunk")).applyInPandas(run, "site bigint, depth int, block bigint, content bigint")
    return pairs.distinct().groupBy("site", "depth", "block").agg(F.count("*").alias("contents"))


def covered(seq: Sequence, hits: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Positions that blocks of (depth, starts) cover."""
    edge = np.zeros(len(seq.line) + 1, np.int64)
    for depth, at in hits:
        np.add.at(edge, at, 1)
        np.add.at(edge, at + depth, -1)
    return np.cumsum(edge)[:-1] > 0


def _marked(site: np.ndarray, keys: list[np.ndarray], blocks: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Line numbers (from 1) that the blocks cover in each text; ``blocks``: depth to sorted hashes."""
    seq = Sequence(site, keys)
    hits = []
    for depth, known in blocks.items():
        at = np.flatnonzero(seq.room >= depth)
        h = seq.hashes(at, depth).view(np.int64)
        i = np.searchsorted(known, h)
        i[i == len(known)] = 0
        hits.append((depth, at[known[i] == h]))
    gone = np.flatnonzero(covered(seq, hits))
    doc = seq.doc[gone]
    return np.split((gone - seq.starts[doc] + 1).astype(np.int32), np.searchsorted(doc, np.arange(1, len(keys))))


def site_line_numbers(keyed: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """``keyed`` with ``site_line_nos``, the numbers from 1 of the lines that blocks cover."""
    blocks = settle(repeated_blocks(keyed) if blocks is None else blocks)
    none = F.array().cast("array<int>")
    if blocks.count() <= BROADCAST_BLOCKS:
        rows = blocks.select("depth", "block").distinct().toPandas()
        shared = keyed.sparkSession.sparkContext.broadcast({int(d): np.sort(p["block"].to_numpy()) for d, p in rows.groupby("depth")})

        @F.arrow_udf("array<int>")
        def mark(site: pa.Array, keys: pa.Array) -> pa.Array:
            got = _marked(site.fill_null(0).to_numpy(zero_copy_only=False), _lists(keys.fill_null([])), shared.value)
            return pa.array(got, pa.list_(pa.int32()))

        return keyed.withColumn("site_line_nos", mark("site_key_", "line_keys_") if len(rows) else none)
    parts = keyed.where("site_key_ is not null").select("row_", F.col("site_key_").alias("site"), F.col("line_keys_").alias("keys")).withColumn("part", F.pmod(F.xxhash64("row_"), F.lit(max(1, keyed.count() * 8 // CHUNK_LINES))))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = {int(d): np.sort(p["block"].to_numpy()) for d, p in right.groupby("depth")}
        got = _marked(left["site"].to_numpy(), list(left["keys"]), known) if len(left) and known else []
        rows = [(r, x) for r, x in zip(left["row_"], got, strict=False) if len(x)]
        return pd.DataFrame(rows, columns=["row_", "nos_"])

    there = parts.select("site", "part").distinct().join(blocks.withColumnRenamed("site_key", "site"), "site").select("site", "part", "depth", "block").toDF("site", "part", "depth", "block")
    nos = parts.groupBy("site", "part").cogroup(there.groupBy("site", "part")).applyInPandas(run, "row_ bigint, nos_ array<int>")
    return keyed.join(nos, "row_", "left").withColumn("site_line_nos", F.coalesce("nos_", none)).drop("nos_")


def mark_site_lines(chapters: DataFrame, keyed: DataFrame | None = None) -> DataFrame:
    """``chapters`` with ``site_line_nos`` (from 1) and ``own_text``, the text without these lines.

    Rows without source, text or such lines have an empty list and their whole text.
    """
    found = site_line_numbers(with_line_keys(chapters) if keyed is None else keyed).drop("site_key_", "line_keys_", "row_")
    rest = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(~F.array_contains("site_line_nos", i + 1), x)), lambda x: x.isNotNull())
    return found.withColumn("own_text", F.when(F.size("site_line_nos") > 0, F.array_join(rest, "\n")).otherwise(F.col("text")))


def found(chapters: DataFrame) -> DataFrame:
    """Every line to take out: ``chapter_id``, ``line_no``. The texts themselves are read once."""
    known = F.col("source").isNotNull() & F.col("text").isNotNull()
    keyed = settle(chapters.where(known).select("chapter_id", "content_id", F.xxhash64(site_of(F.col("source"))).alias("site_key_"), _line_keys(F.col("text")).alias("line_keys_"), F.monotonically_increasing_id().alias("row_")))
    marked = site_line_numbers(keyed)
    return marked.select("chapter_id", F.explode("site_line_nos").alias("line_no")).select("chapter_id", F.col("line_no").cast("bigint").alias("line_no"))
