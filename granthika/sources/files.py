"""Readers and writers: corpus JSON, chunks, manifest, vocabulary, vectors, WAV, interaction log, pages."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granthika.session import file_system, replace_folder

CHUNK = "text STRING, content_id STRING, chapter STRING, section STRING, page INT, source STRING, license STRING, chunk_index INT"
CORPUS = (
    "collection STRUCT<name STRING, board STRING, medium STRING, gradeLevel STRING, subject STRING, license STRING, source STRING, harvested_at STRING, note STRING>, "
    "documents ARRAY<STRUCT<content_id STRING, chapter STRING, section STRING, page INT, text STRING, source STRING, license STRING, board STRING, grade STRING, subject STRING, medium STRING>>"
)
MANIFEST = "embedder STRING, embedder_backend STRING, dim INT, num_chunks BIGINT, num_documents BIGINT, chunk_max_words INT, chunk_overlap INT, recommended_min_score DOUBLE, built_at STRING, corpus STRING"
INTERACTION = "id BIGINT, query STRUCT<text STRING>, response STRING, timestamps STRUCT<audio_start DOUBLE, audio_stop DOUBLE, asr_start DOUBLE, asr_stop DOUBLE, nmt_a_stop DOUBLE, llm_start DOUBLE, llm_end DOUBLE, nmt_b_stop DOUBLE, app_end DOUBLE>"


_CLIP = T.StructType([T.StructField("pcm", T.BinaryType()), *(T.StructField(c, T.IntegerType()) for c in ("sample_rate", "sample_width", "channels")), T.StructField("error", T.StringType())])


def read_corpus(spark: SparkSession, path: str, default_source: str = "") -> DataFrame:
    """Documents of a corpus file, with the collection's fields where their own are missing."""
    raw = spark.read.schema(CORPUS).option("multiLine", True).json(path).select("collection", F.explode("documents").alias("d"))
    fall = {"board": "collection.board", "grade": "collection.gradeLevel", "subject": "collection.subject", "license": "collection.license"}
    return raw.select(
        "d.content_id", "d.chapter", "d.section", "d.page", "d.text", *(F.coalesce(f"d.{c}", h).alias(c) for c, h in fall.items()), F.coalesce("d.source", "collection.source", F.lit(default_source)).alias("source"), F.coalesce("d.medium", "collection.medium").alias("medium")
    )


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def read_chunks(spark: SparkSession, path: str, keyed: bool = False) -> DataFrame:
    """Chunks as JSON lines, with their ``chunk_id`` if ``keyed``; a malformed line raises, blank lines are passed over."""
    return spark.read.schema(f"chunk_id BIGINT, {CHUNK}" if keyed else CHUNK).option("mode", "FAILFAST").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's row, no row where there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def read_vocabulary(spark: SparkSession, text: DataFrame, column: str = "value") -> DataFrame:
    """``term``, ``term_id`` from a JSON object of terms."""
    return text.select(F.explode(F.from_json(column, "map<string,int>")).alias("term", "term_id"))


def read_settings(text: DataFrame, column: str = "value") -> DataFrame:
    """Settings of a JSON object; anything else raises."""
    parsed = F.from_json(column, "map<string,string>", {"mode": "FAILFAST"})
    return text.select(parsed.alias("settings"))


def build_manifest(chunks: DataFrame, embedder: str, backend: str, dim: int, max_words: int, overlap: int, corpus: str, min_score: float | None) -> DataFrame:
    """The one row that describes an index; an empty one raises."""
    row = chunks.agg(F.count("*").alias("num_chunks"), F.countDistinct("content_id").alias("num_documents"))
    checked = F.when(F.col("num_chunks") > 0, F.col("num_chunks")).otherwise(F.raise_error(F.lit("No chunks produced")).cast("bigint"))
    return row.select(
        F.lit(embedder).alias("embedder"), F.lit(backend).alias("embedder_backend"), F.lit(dim).alias("dim"), checked.alias("num_chunks"), "num_documents", F.lit(max_words).alias("chunk_max_words"), F.lit(overlap).alias("chunk_overlap"),
        F.lit(min_score).cast("double").alias("recommended_min_score"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("built_at"), F.lit(corpus).alias("corpus"),
    )


def write_index(path: str, chunks: DataFrame, vocabulary: DataFrame, vectors: DataFrame, manifest: DataFrame) -> None:
    """Chunks and manifest as JSON, vocabulary and vectors as Parquet; all of them take the old ones' place at once."""
    with replace_folder(chunks.sparkSession, path) as part:
        chunks.write.json(f"{part}/chunks")
        vocabulary.write.parquet(f"{part}/vocabulary")
        vectors.write.parquet(f"{part}/vectors")
        manifest.coalesce(1).write.json(f"{part}/manifest")


def append_log(rows: DataFrame, path: str) -> None:
    """Append interactions as JSON lines."""
    rows.write.mode("append").json(path)


def _decoded(data: bytes | None) -> tuple | None:
    if data is None:
        return None
    try:
        with wave.open(io.BytesIO(data)) as w:
            return w.readframes(w.getnframes()), w.getframerate(), w.getsampwidth(), w.getnchannels(), None
    except (wave.Error, EOFError) as e:
        return None, None, None, None, str(e) or "no WAV file"


@F.pandas_udf(_CLIP)
def _wav_read(data: pd.Series) -> pd.DataFrame:
    rows = [_decoded(None if x is None else bytes(x)) or (None,) * 5 for x in data]
    out = pd.DataFrame(rows, columns=[f.name for f in _CLIP.fields])
    return out.astype({c: "Int32" for c in ("sample_rate", "sample_width", "channels")})


def wav_decoded(data: Column | str) -> Column:
    """Frames and header of a WAV file; what is none gives an error instead of failing the job, null stays null."""
    c = F.col(data) if isinstance(data, str) else data
    return F.when(c.isNotNull(), _wav_read(c))


def _encoded(pcm: bytes, rate: int, width: int, channels: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(pcm)
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def wav_encoded(pcm: pd.Series, rate: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else _encoded(bytes(p), int(r), int(w), int(c)) for p, r, w, c in zip(pcm, rate, width, channels, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.ShortType()))
def pcm_samples(pcm: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else np.frombuffer(bytes(p)[: len(p) // 2 * 2], "<i2") for p in pcm], dtype=object)


def recorded(clips: DataFrame) -> DataFrame:
    """Decoded clips that a recorder accepts: mono and 16 bits, else the row raises."""
    ok = (F.col("clip.channels") == 1) & (F.col("clip.sample_width") == 2)
    return clips.withColumn("pcm", F.when(ok, F.col("clip.pcm")).otherwise(F.raise_error(F.lit("the recorder takes mono clips of 16 bits")).cast("binary")))


def html_pages(rows: DataFrame, html: str, ocr=None) -> DataFrame:
    """Text of HTML pages; ``ocr`` (a column function) fills in where the text layer is empty."""
    text = F.regexp_replace(F.col(html), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"\s+", " "))
    filled = F.nullif(text, F.lit(""))
    return rows.withColumn("text", F.coalesce(filled, ocr(F.col(html))) if ocr else filled)
