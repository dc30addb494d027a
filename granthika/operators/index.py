"""An index that is built once, stored, and searched many times.

Layout of a folder: ``chunks`` and ``manifest`` as JSON lines, ``vocabulary`` (``term``, ``term_id``,
``df``, ``idf``) and ``vectors`` (``chunk_id``, ``terms``, ``weights``, of unit length) as Parquet. It is
written beside its place and renamed, so a reader sees the old index or the new one, never a part.
Vectors and chunks are joined by ``chunk_id``, never by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.operators import search, tfidf
from granthika.session import replace_folder
from granthika.sources import files

PARTS = ("chunks", "vocabulary", "vectors", "manifest")


def build(chunks: DataFrame, path: str, corpus: str, min_score: float | None, max_words: int = 120, overlap: int = 25) -> None:
    """Fit and store the index of chunks with ``chunk_id`` and ``text``; no chunks raise."""
    spark = chunks.sparkSession
    with replace_folder(spark, path) as part:
        counts = tfidf.term_counts(chunks, "chunk_id", "text")
        tfidf.with_ids(tfidf.vocabulary(counts, chunks)).write.parquet(f"{part}/vocabulary")
        vocabulary = spark.read.parquet(f"{part}/vocabulary")
        tfidf.vectors(counts, vocabulary, "chunk_id").write.parquet(f"{part}/vectors")
        chunks.write.json(f"{part}/chunks")
        dimension = vocabulary.count()
        files.build_manifest(chunks, "tfidf", "tfidf", dimension, max_words, overlap, corpus, min_score).coalesce(1).write.json(f"{part}/manifest")


class Index:
    """A stored index; one that lacks a part, or whose counts contradict its manifest, raises when it is opened."""

    def __init__(self, spark: SparkSession, path: str):
        missing = [p for p in PARTS if not files.exists(spark, f"{path}/{p}")]
        if missing:
            raise FileNotFoundError(f"{path} has no {', '.join(missing)}")
        self.spark, self.path = spark, path
        self.vocabulary, self.vectors = (spark.read.parquet(f"{path}/{p}") for p in ("vocabulary", "vectors"))
        self.chunks = files.read_chunks(spark, f"{path}/chunks", keyed=True)
        self.manifest = files.read_manifest(spark, f"{path}/manifest")
        built = self.manifest.first()
        terms = self.vocabulary.count()
        if built.dim != terms:
            raise ValueError(f"the manifest tells of {built.dim} terms, the vocabulary has {terms}")
        self.min_score = built.recommended_min_score

    def search(self, requests: DataFrame, k: int = search.TOP_K) -> DataFrame:
        """``request_id``, ``rn``, ``chunk_id``, ``score``."""
        return search.search_vectors(self.vectors, self.vocabulary, requests, k)

    def passages(self, found: DataFrame, default_source: str = "") -> DataFrame:
        """What was found with its text and where it is from; a missing source is the manifest's corpus, else the default."""
        c, corpus = F.col, self.manifest.first().corpus
        text = self.chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("content_id", F.lit("unknown")).alias("content_id"), F.coalesce("chapter", F.lit("")).alias("chapter"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce(c("page").cast("int"), F.lit(0)).alias("page"), F.coalesce("source", F.lit(corpus), F.lit(default_source)).alias("source"))
        return found.join(text, "chunk_id").select("request_id", "rn", "chunk_id", "score", "text", "content_id", "chapter", "section", "page", "source")
