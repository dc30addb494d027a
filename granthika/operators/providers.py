"""Models that a deployment plugs in: generation, translation, speech, embedding.

A provider is a plain function; it runs in Arrow batches, keeps its state per worker, and a failing row
gives an error instead of failing the job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthika.functions import text as T

_REGISTRY: dict[tuple[str, str], Callable] = {}


def provider(kind: str, name: str) -> Callable[[Callable], Callable]:
    """Register a factory under its kind (``generate``, ``translate``, ``speak``, ``embed``) and name."""

    def wrap(factory: Callable) -> Callable:
        _REGISTRY[kind, name] = factory
        return factory

    return wrap


def make(kind: str, name: str, **options) -> Callable:
    """The provider of a name; an unknown one raises."""
    if (kind, name) not in _REGISTRY:
        raise ValueError(f"no provider {name!r} to {kind}; there are {sorted(n for k, n in _REGISTRY if k == kind)}")
    return _REGISTRY[kind, name](**options)


@provider("translate", "none")
def _same() -> Callable[[str, str, str], str]:
    return lambda text, source, target: text


def isolated(df: DataFrame, function: Callable, inputs: list[str], output: str, kind: str = "string") -> DataFrame:
    """``df`` with ``output`` (null where the function fails or gives none) and ``output_error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values, errors = [], []
            for row in pdf[inputs].itertuples(index=False):
                try:
                    values.append(function(*row))
                    errors.append(None)
                except Exception as e:  # A failing row must not end the job.
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            if values:
                yield pdf.assign(**{output: values, f"{output}_error": errors})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.drop(output, f"{output}_error").mapInPandas(run, f"{schema}, `{output}` {kind}, `{output}_error` string")


def streamed(prompted: DataFrame, function: Callable[[str, str], Iterator[str]], request: str = "request_id") -> DataFrame:
    """Pieces of answers as a generator brings them: ``stream_id``, ``seq``, ``chunk``, ``eos``, ``error``.

    ``prompted`` has ``system_prompt`` and ``user_prompt``. Every stream ends with an end row; one that fails
    ends there, with the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, system, user in pdf[[request, "system_prompt", "user_prompt"]].itertuples(index=False):
                rows, error = [], None
                try:
                    for chunk in function(system, user):
                        rows.append((str(key), len(rows), chunk, False, None))
                except Exception as e:  # A failing answer must not end the job.
                    error = f"{type(e).__name__}: {e}"
                rows.append((str(key), len(rows), "", True, error))
                yield pd.DataFrame(rows, columns=["stream_id", "seq", "chunk", "eos", "error"])

    return prompted.select(request, "system_prompt", "user_prompt").mapInPandas(run, "stream_id string, seq int, chunk string, eos boolean, error string")


def spoken_audio(function: Callable[[str, str], bytes], language: str, column: str = "answer_localized") -> Callable[[DataFrame], DataFrame]:
    """A speaker of answers: adds ``audio``, null where the function fails."""
    return lambda df: isolated(df, lambda text: function(text, language) if text else None, [column], "audio", "binary").drop("audio_error")


#: Embedders in the order in which they are tried.
EMBEDDERS = ("onnx", "sentence-transformers", "tfidf")
#: Texts that an embedder takes at once, and tokens of a text that it reads.
EMBED_BATCH = 32
EMBED_TOKENS = 512


def choose_embedder(prefer: str | None = None, **options) -> tuple[str, Callable]:
    """The first embedder that can be made; one asked for by name raises where it can't."""
    if prefer is not None:
        return prefer, make("embed", prefer, **options)
    for name in EMBEDDERS:
        try:
            return name, make("embed", name, **options)
        except Exception as e:
            last = e
    raise RuntimeError("no embedder can be made") from last


def embedded(rows: DataFrame, function: Callable[[list[str], int], tuple], text: str = "text", output: str = "embedding", kind: str = "passage", backend: str = "onnx", batch: int = EMBED_BATCH) -> DataFrame:
    """``rows`` with unit vectors: ``function`` gives (texts x tokens x width) values and their mask for some texts.

    Token vectors are averaged where the mask counts; a text whose mask counts nothing has a zero vector, a null one none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors: list = []
            for at in range(0, len(pdf), batch):
                texts = list(pdf["text_"][at : at + batch])
                known = [t for t in texts if isinstance(t, str)]
                if known:
                    tokens, mask = (np.asarray(x, float) for x in function(known, EMBED_TOKENS))
                    mean = (tokens * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1), 1e-9)[:, None]
                    length = np.linalg.norm(mean, axis=1, keepdims=True)
                    unit = iter((mean / np.where(length > 0, length, 1)).astype(np.float32))
                vectors += [next(unit) if isinstance(t, str) else None for t in texts]
            if len(pdf):
                yield pdf.drop(columns="text_").assign(**{output: vectors})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(output).schema)
    return rows.drop(output).withColumn("text_", T.passage_prefix(F.col(text), kind, backend)).mapInPandas(run, f"{schema}, `{output}` array<float>")


def until_ready(check: Callable[[], tuple[bool, str]], deadline_s: float = 60.0, step_s: float = 0.25) -> str:
    """Ask a model whether it is ready until it says so; its last message is raised at the deadline."""
    end = time.monotonic() + deadline_s
    while True:
        ok, message = check()
        if ok:
            return message
        if time.monotonic() >= end:
            raise TimeoutError(message)
        time.sleep(step_s)


def translated(function: Callable[[str, str, str], str], source: str, target: str, column: str = "answer_en", output: str = "localized") -> Callable[[DataFrame], DataFrame]:
    """A translator of whole answers, sentence by sentence; a sentence that fails stays as it is."""

    def whole(text: str | None) -> str | None:
        if text is None or source.lower() == target.lower():
            return text
        out = []
        for s in _units(text):
            try:
                out.append(function(s, source, target))
            except Exception:
                out.append(s)
        return " ".join(out) if out else text

    return lambda df: isolated(df, whole, [column], output).drop(f"{output}_error")


def _units(text: str) -> list[str]:
    import re

    return [s.strip() for s in re.split(r"(?<=[.!?।])\s+", text.strip()) if s.strip()]


def needs_translation(target: Column) -> Column:
    return target.isNotNull() & (target != "") & (F.lower(target) != "en")


def masked_mean(rows: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """Mean vector of the rows whose mask counts, as ``key``, ``dim``, ``value``; 0 where none does."""
    long = rows.select(key, F.col(mask).cast("double").alias("m"), F.posexplode(vector).alias("dim", "x"))
    return long.groupBy(key, "dim").agg((F.sum(F.col("x").cast("double") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("value"))


def console(answers: DataFrame) -> DataFrame:
    """A line for each answer: what was said, or why not, and its sources."""
    said = F.when(F.col("refused"), F.concat(F.lit("[refused] "), "answer_en")).otherwise(F.concat(F.lit("[" ), "intent", F.lit("] "), T.spoken(F.col("answer_localized"), F.col("answer_en"))))
    return answers.select("request_id", F.concat_ws("\n", said, F.transform("citations", lambda c: F.concat(F.lit("  - "), c))).alias("line"))
