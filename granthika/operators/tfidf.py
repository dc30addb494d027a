"""TF-IDF as tables: vocabulary, postings of unit length.

Scale: all counts are two-phase aggregates by (item, term) and by term. The vocabulary is joined, not
collected; the number of items is the only scalar, taken as a one-row aggregate and joined to the
vocabulary's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granthika.functions import text as T

MAX_DF_RATIO = 0.6


def term_counts(items: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``term``, ``tf``; null texts have no terms."""
    rows = items.select(key, F.explode(T.all_tokens(F.col(text))).alias("term"))
    # A filter on rows is compiled, one on array elements is not.
    return rows.where((F.length("term") > 2) & ~F.col("term").isin(*T.STOPWORDS)).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, items: DataFrame, max_ratio: float = MAX_DF_RATIO) -> DataFrame:
    """``term``, ``df``, ``idf`` of the terms in at most ``max_ratio`` of all items."""
    return weighed(counts.groupBy("term").agg(F.count("*").alias("df")), items, max_ratio)


def weighed(df: DataFrame, items: DataFrame, max_ratio: float = MAX_DF_RATIO) -> DataFrame:
    """As ``vocabulary``, from the terms with the number of items that have them."""
    n = items.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(n)).where(F.col("df") <= max_ratio * F.col("n")).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def with_ids(vocab: DataFrame) -> DataFrame:
    """Dense ids from 0 in order of the terms' code points.

    Ranks are taken inside ranges of first characters and moved by the ranges' sizes, so the vocabulary does not pass through one task.
    """
    ranged = vocab.withColumn("head_", F.substring("term", 1, 2))
    sizes = ranged.groupBy("head_").agg(F.count("*").alias("n_"))
    ahead = sizes.withColumn("ahead_", F.sum("n_").over(Window.orderBy("head_")) - F.col("n_")).select("head_", "ahead_")
    inside = F.row_number().over(Window.partitionBy("head_").orderBy("term"))
    return ranged.withColumn("in_", inside).join(ahead, "head_").select("term", (F.col("ahead_") + F.col("in_") - 1).cast("bigint").alias("term_id"), "df", "idf")


def postings(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """``key``, ``term``, ``weight``: sublinear tf times idf, each item at unit length."""
    raw = counts.join(vocab.select("term", "idf"), "term").select(key, "term", ((F.log("tf") + 1) * F.col("idf")).alias("raw"))
    # An item's terms are few: they travel as one row, so the length needs no second join.
    items = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), F.collect_list(F.struct("term", "raw")).alias("terms_"))
    return items.select(key, "norm", F.inline("terms_")).select(key, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def vectors(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """``key``, ``terms`` (ids), ``weights``: as ``postings``, one row for each item; ``vocab`` has ``term_id``."""
    raw = counts.join(vocab.select("term", "term_id", "idf"), "term").select(key, "term_id", ((F.log("tf") + 1) * F.col("idf")).alias("raw"))
    items = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), F.collect_list(F.struct("term_id", "raw")).alias("t_"))
    return items.select(key, F.transform("t_", lambda t: t["term_id"].cast("int")).alias("terms"), F.transform("t_", lambda t: t["raw"] / F.col("norm")).alias("weights"))


def norms(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """Length of each item's raw vector; items without a vocabulary term have none."""
    return counts.join(vocab.select("term", "idf"), "term").groupBy(key).agg(F.sqrt(F.sum(F.pow((F.log("tf") + 1) * F.col("idf"), 2))).alias("norm"))
