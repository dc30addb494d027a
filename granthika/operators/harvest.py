"""Harvest of catalogue items into pages: filters, dedup, limits, defaults, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granthika.functions import text as T

MIN_CHARS = 120


def predicates(items: DataFrame, grade: str | None = None, medium: str | None = None, subject: str | None = None, board: str | None = None, mime: str | None = None) -> DataFrame:
    """The items that have all of the values asked for; those not asked for don't matter."""
    asked = [F.array_contains(c, F.lit(v)) for c, v in (("grade_level", grade), ("medium", medium), ("subject", subject), ("board", board)) if v]
    if mime:
        asked.append(F.col("mime_type") == mime)
    return items.where(reduce(lambda a, b: a & b, asked)) if asked else items


def first_wins(items: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the first in order, ties going by the other columns; rows without a key are dropped.

    An aggregate keeps the least row of each key, so that a key's rows need not meet in one task.
    """
    rows = items.where(F.col(key).isNotNull() & (F.col(key) != ""))
    least = F.min(F.struct(*dict.fromkeys([*order, *items.columns]))).alias("least_")
    return rows.groupBy(F.col(key).alias("key_")).agg(least).select(*(F.col(f"least_.`{c}`").alias(c) for c in items.columns))


def harvest(items: DataFrame, pages: DataFrame, suffix: str = ".pdf", min_chars: int = MIN_CHARS, limit: int | None = None) -> DataFrame:
    """Pages of the items whose URL has the suffix, with the item's fields as defaults.

    ``limit`` takes the first items by identifier, before the suffix is looked at. A page counts with
    ``min_chars`` characters or more.
    """
    once = first_wins(items, "identifier", "identifier", "artifact_url", "name")
    if limit is not None:
        once = once.orderBy("identifier").limit(limit)
    wanted = once.where(F.lower(F.col("artifact_url")).endswith(suffix))
    text = pages.where(F.length("text") >= min_chars)
    one = lambda c: T.first_of(F.col(c), F.lit(None).cast("string"))
    fields = wanted.select(F.col("identifier").alias("content_id"), T.trimmed(F.coalesce(F.nullif("name", F.lit("")), "identifier")).alias("item_name"), F.col("artifact_url").alias("item_url"), one("board").alias("item_board"), one("grade_level").alias("item_grade"), one("subject").alias("item_subject"), one("medium").alias("item_medium"))
    return text.join(fields, "content_id").select(
        "chapter_id", "content_id", F.col("item_name").alias("chapter"), F.concat(F.lit("page "), F.col("page").cast("string")).alias("section"), "page", F.col("item_url").alias("source"), "license",
        F.coalesce("item_board", "board").alias("board"), F.coalesce("item_grade", "grade").alias("grade"), F.coalesce("item_subject", "subject").alias("subject"), F.coalesce("item_medium", "medium").alias("medium"),
    )


def counters(items: DataFrame, pages: DataFrame, suffix: str = ".pdf", min_chars: int = MIN_CHARS) -> DataFrame:
    """Items seen, with another suffix, with pages of text and without, and pages in all."""
    once = first_wins(items, "identifier", "identifier", "artifact_url", "name").select("identifier", F.coalesce(F.lower(F.col("artifact_url")).endswith(suffix), F.lit(False)).alias("wanted"))
    per = pages.where(F.length("text") >= min_chars).groupBy(F.col("content_id").alias("identifier")).agg(F.count("*").alias("pages"))
    row = once.join(per, "identifier", "left")
    return row.agg(
        F.count("*").alias("items"), F.count_if(~F.col("wanted")).alias("other_type"), F.count_if(F.col("wanted") & F.col("pages").isNotNull()).alias("with_text"),
        F.count_if(F.col("wanted") & F.col("pages").isNull()).alias("without_text"), F.coalesce(F.sum(F.when(F.col("wanted"), F.col("pages"))), F.lit(0)).alias("pages"),
    )


def page_of(items: DataFrame, offset: int, size: int, order: str = "identifier") -> DataFrame:
    """One page of a listing."""
    return items.orderBy(order).offset(offset).limit(size)


def capped(rows: DataFrame, group: str, order: tuple[str, ...], most: int) -> DataFrame:
    """At most ``most`` rows of each group, the first in order."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rn_", rn).where(F.col("rn_") <= most).drop("rn_")


def anti_refresh(new: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not there yet."""
    return new.join(have.select(key).distinct(), key, "left_anti")
