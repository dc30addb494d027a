"""Overlapping word windows over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthika.functions import text as T

MAX_WORDS = 120
OVERLAP = 25


def chunk(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """One row per window: ``keep``, ``chunk_index`` from 0, ``chunk_text``. Empty texts have none.

    The last window begins where the one before does not reach the end, so there is no tiny tail. A text
    is cut into words once; its windows are rows before they are put together again.
    """
    step = max(1, max_words - overlap)
    n = F.size("words_")
    last = F.when(n <= max_words, F.lit(0)).otherwise(F.ceil((n - max_words) / F.lit(float(step))).cast("int"))
    starts = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    cut = documents.select(*keep, T.words(F.col(text)).alias("words_"))
    rows = cut.select(*keep, "words_", F.explode(starts).alias("chunk_index"))
    return rows.select(*keep, "chunk_index", F.array_join(F.slice("words_", F.col("chunk_index") * step + 1, F.lit(max_words)), " ").alias("chunk_text"))


def with_defaults(chunks: DataFrame, source: str) -> DataFrame:
    """The fields of a chunk, filled where they are missing."""
    d = {"content_id": "unknown", "chapter": "", "section": "", "page": 0, "source": source}
    return chunks.select("chunk_id", "text", *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in d.items()), "license", "chunk_index")
