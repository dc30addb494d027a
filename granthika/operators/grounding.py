"""From ranked passages to a grounded answer: gate, prompts, citations, answer or refusal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthika.functions import text as T

#: Least score by embedding backend, and where neither the caller nor the manifest names one.
MIN_SCORES = {"sentence-transformers": 0.84, "onnx": 0.84, "tfidf": 0.10}
DEFAULT_MIN_SCORE = 0.30
REFUSAL_TEXT = "This question is not covered by the approved material on this device."
SENTINEL = "NO_ANSWER_IN_SOURCE"
INSTRUCTIONS = {
    "explain": "Give a clear explanation for a pupil in three to five short sentences, from the sources alone.",
    "simplify": "Use very easy words that a young child knows, three to five short sentences, from the sources alone.",
    "answer": "Give a direct answer in one to three short sentences, from the sources alone.",
}
SYSTEM_PROMPT = "Answer a teacher's request from the numbered sources below and from nothing else. Add no facts, numbers or examples of your own. Be brief, use plain English and write to be read aloud.\n\nSources:\n"


def threshold(given: float | None, recommended: Column | None = None) -> Column:
    """The caller's threshold, else the manifest's, else the default."""
    options = [F.lit(given).cast("double")] + ([recommended] if recommended is not None else []) + [F.lit(DEFAULT_MIN_SCORE)]
    return F.coalesce(*options)


def gate(requests: DataFrame, ranked: DataFrame, min_score: Column, request: str = "request_id") -> DataFrame:
    """``request``, ``best_score``, ``refused``: refused where no passage reaches the threshold."""
    best = ranked.groupBy(request).agg(F.max("score").alias("best"))
    found = requests.select(request).join(best, request, "left")
    return found.select(request, F.coalesce("best", F.lit(0.0)).alias("best_score"), (F.col("best").isNull() | (F.col("best") < min_score)).alias("refused"))


def relevant(ranked: DataFrame, min_score: Column, request: str = "request_id") -> DataFrame:
    """Passages that reach the threshold, numbered from 1. As ranks fall with the score, their ranks are the numbers."""
    return ranked.where(F.col("score") >= min_score).withColumnRenamed("rn", "source_no")


def cited(passages: DataFrame, chunks: DataFrame, prefix: str = "SOURCE", item: str = "chunk_id") -> DataFrame:
    """Passages with text and citation."""
    d = chunks.select(item, "text", T.citation(F.col("content_id"), F.col("chapter"), F.col("section"), F.col("page"), prefix).alias("citation"))
    return passages.join(d, item)


def sources(passages: DataFrame, request: str = "request_id") -> DataFrame:
    """``sources_block``, ``citations`` and the first passage of each request, in order of rank."""
    listed = F.array_sort(F.collect_list(F.struct("source_no", "citation", "text")))
    rows = passages.groupBy(request).agg(listed.alias("p"))
    block = F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), x["source_no"].cast("string"), F.lit("] ("), x["citation"], F.lit(")\n"), x["text"])), "\n\n")
    return rows.select(request, block.alias("sources_block"), F.transform("p", lambda x: x["citation"]).alias("citations"), F.element_at("p", 1)["text"].alias("first_text"))


def instruction(intent: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in INSTRUCTIONS.items() for x in kv]), intent)


def prompts(requests: DataFrame, grouped: DataFrame, request: str = "request_id", text: str = "text") -> DataFrame:
    """``intent``, ``system_prompt``, ``user_prompt`` of the requests that are answered."""
    return requests.join(grouped, request).select(
        request, T.intent(F.col(text)).alias("intent"), F.concat(F.lit(SYSTEM_PROMPT), "sources_block").alias("system_prompt"), F.concat(F.lit("Request: "), F.col(text), F.lit("\n\n"), instruction(T.intent(F.col(text)))).alias("user_prompt"), "citations", "first_text"
    )


Provider = Callable[[DataFrame], DataFrame]


def extract(prompted: DataFrame) -> DataFrame:
    """The built-in answerer: the first source's text."""
    return prompted.withColumn("generated", F.col("first_text"))


def answers(requests: DataFrame, ranked: DataFrame, chunks: DataFrame, min_score: Column, generate: Provider = extract, translate: Provider | None = None, target: str = "en", prefix: str = "SOURCE") -> DataFrame:
    """One row per request: ``refused``, ``intent``, ``answer_en``, ``answer_localized``, ``spoken``, ``citations``.

    ``generate`` adds ``generated`` to the prompted rows and sees only requests that passed the gate;
    ``translate`` adds ``localized`` (null where it fails) for another target than English.
    """
    decided = gate(requests, ranked, min_score)
    grouped = sources(cited(relevant(ranked, min_score), chunks, prefix))
    prompted = prompts(requests, grouped).join(decided.where(~F.col("refused")).select("request_id"), "request_id", "left_semi")
    made = generate(prompted).withColumn("refused_", T.is_refusal(F.col("generated")))
    none = F.array().cast("array<string>")
    good = made.select("request_id", F.col("refused_").alias("refused"), "intent", F.when(F.col("refused_"), F.lit(REFUSAL_TEXT)).otherwise(T.clean_answer(F.col("generated"))).alias("answer_en"), F.when(F.col("refused_"), none).otherwise(F.col("citations")).alias("citations"))
    bad = requests.join(decided.where("refused"), "request_id").select("request_id", F.lit(True).alias("refused"), T.intent(F.col("text")).alias("intent"), F.lit(REFUSAL_TEXT).alias("answer_en"), none.alias("citations"))
    out = good.unionByName(bad)
    if translate is not None and target and target.lower() != "en":
        out = translate(out)
    else:
        out = out.withColumn("localized", F.lit(None).cast("string"))
    return out.select("request_id", "refused", "intent", "answer_en", F.coalesce("localized", "answer_en").alias("answer_localized"), T.spoken(F.col("localized"), F.col("answer_en")).alias("spoken"), "citations")


def sweep(best: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Answered requests at each threshold, from the best score of each request."""
    grid = best.select("best_score", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return grid.groupBy("threshold").agg(F.count("*").alias("requests"), F.count_if(F.col("best_score") >= F.col("threshold")).alias("answered"))
