"""Splitting oversized items at natural boundaries (problem 3).

Sizes are words: runs of characters between Unicode white space. An item within its limit stays one
piece and never leaves the JVM. A larger one is cut by agglomerative merging: it begins as atomic
segments, adjacent segments stand in a heap ordered by the strength of the boundary between them,
and the weakest boundary goes first, as long as both sides together with the overlap fit.

Edge cases: a null limit, a null or blank text is never split (blank texts give one piece, null ones
none); an overlap of the limit or more is taken as limit - 1; a segment longer than a piece may hold
is cut between words. Every piece but the first repeats the last ``overlap`` words before it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space as Python's ``str.split`` knows it, in a form that Java and RE2 share.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TOKEN = re.compile(r"\S+")
_WORD, _CLAUSE, _SENTENCE, _LINE, _PARAGRAPH = range(5)
_CLOSERS = "\"'”’)]»"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for blank ones."""
    marks = F.regexp_replace(F.regexp_replace(text, f"[^{SPACE}]+", "x"), f"[{SPACE}]+", "")
    return F.length(marks)


def _strength(word: str, gap: str, line_ends_count: bool) -> int:
    """How natural it is to cut between ``word`` and what follows the white space ``gap``."""
    if gap.count("\n") >= 2:
        return _PARAGRAPH
    bare = word.rstrip(_CLOSERS)
    end = bare[-1:] or word[-1:]
    if end in ".!?।॥…":
        return _LINE if "\n" in gap else _SENTENCE
    if "\n" in gap and line_ends_count:
        return _SENTENCE
    return _CLAUSE if end in ",;:—–" else _WORD


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces as (first own word, first word with overlap, end word)."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    n = len(spans)
    limit = max(1, limit)
    if n <= limit:
        return [(0, 0, n)]
    overlap = max(0, min(overlap, limit - 1))
    room = limit - overlap
    lines = text.split("\n")
    # Short lines are entries or verse, whose ends are natural; long ones are wrapped prose.
    line_ends_count = len(lines) > 2 and sum(map(len, lines)) / len(lines) < 45
    level = [_strength(text[a:b], text[b : spans[i + 1][0]], line_ends_count) for i, (a, b) in enumerate(spans[:-1])]
    # Atomic segments: sentences; clauses or words where a segment is larger than a piece's room.
    starts = [0]
    for least in (_SENTENCE, _CLAUSE, _WORD):
        bounds = [*starts, n]
        starts = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            starts.append(a)
            if b - a > room or least == _SENTENCE:
                starts += [i + 1 for i in range(a, b - 1) if level[i] >= least]
    # The first piece has no overlap before it, but must hold what the second repeats.
    if overlap:
        kept = [s for s in starts[1:] if s >= overlap]
        if not kept or kept[0] > limit:
            kept = [overlap, *kept]
        starts = [0, *kept]
    m = len(starts)
    end = [*starts[1:], n]
    after = list(range(1, m + 1))
    before = list(range(-1, m - 1))
    alive = [True] * m

    def entry(i: int) -> tuple[int, int, int, int, int]:
        j = after[i]
        return level[starts[j] - 1], end[j] - starts[i], i, j, end[j]

    heap = [entry(i) for i in range(m - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j, stop = heapq.heappop(heap)
        if not alive[i] or after[i] != j or end[j] != stop or size != end[j] - starts[i] or j >= m or not alive[j]:
            continue
        if size + (overlap if starts[i] else 0) > limit:
            continue
        alive[j] = False
        end[i] = end[j]
        after[i] = after[j]
        if after[i] < m:
            before[after[i]] = i
            heapq.heappush(heap, entry(i))
        if before[i] >= 0:
            heapq.heappush(heap, entry(before[i]))
    return [(starts[i], max(0, starts[i] - overlap) if starts[i] else 0, end[i]) for i in range(m) if alive[i]]


def split_oversized(df: DataFrame, text: str, limit: str, overlap: str, piece: str = "chunk_index") -> DataFrame:
    """``df`` with one row per piece: ``text`` is the piece, ``piece`` its number from 0, ``piece_words`` its size.

    The columns ``limit`` and ``overlap`` hold each row's figures. A column named ``piece`` is replaced.
    """
    base = df.drop(piece, "piece_words")
    sized = base.withColumn("piece_words", word_count(F.col(text)).cast("int"))
    over = F.coalesce((F.col("piece_words") > F.col(limit)), F.lit(False))
    small = sized.where(~over & F.col(text).isNotNull()).withColumn(piece, F.lit(0))
    names = [*sized.columns, piece]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            take, parts, sizes, numbers = [], [], [], []
            for k, (t, lim, ov) in enumerate(zip(pdf[text], pdf[limit], pdf[overlap], strict=True)):
                spans = [m.span() for m in _TOKEN.finditer(t)]
                for no, (_, a, b) in enumerate(cut(t, int(lim), 0 if pd.isna(ov) else int(ov))):
                    take.append(k)
                    parts.append(t[spans[a][0] : spans[b - 1][1]])
                    sizes.append(b - a)
                    numbers.append(no)
            if not take:
                continue
            out = pdf.iloc[take].copy()
            out[text], out["piece_words"], out[piece] = parts, sizes, numbers
            yield out[names]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema)
    return small.select(names).unionByName(sized.where(over).mapInPandas(run, schema))


def limits(manifest: DataFrame) -> DataFrame:
    """Limit and overlap of each corpus; builds of a corpus agree on both."""
    return manifest.where("corpus is not null").groupBy("corpus").agg(F.max("chunk_max_words").alias("chunk_max_words"), F.max("chunk_overlap").alias("chunk_overlap"))


def pieces(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """All chunks within the limits of their corpus; ``chunk_index`` numbers the pieces of a chunk."""
    sized = chunks.drop("chunk_max_words", "chunk_overlap").join(F.broadcast(limits(manifest)), "corpus", "left")
    return split_oversized(sized, "text", "chunk_max_words", "chunk_overlap")


def found(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks that had to be split."""
    cut_up = pieces(chunks.select("chunk_id", "corpus", "text"), manifest)
    return cut_up.where("chunk_index = 1").select("chunk_id")
