"""Chapters without their site's own lines, written once for the operators that read them several times."""

from __future__ import annotations

from pyspark.sql import DataFrame

from granthika.llm.quality import text_types
from granthika.llm.sitelines import mark_site_lines
from granthika.session import settle


def without_site_lines(chapters: DataFrame) -> DataFrame:
    """``chapter_id``, ``chapter``, ``medium`` and ``own_text`` of all chapters."""
    read = chapters.select("chapter_id", "content_id", "chapter", "medium", "source", "text")
    return settle(mark_site_lines(read).select("chapter_id", "chapter", "medium", "own_text"))


def types_of(pages: DataFrame, common_words: DataFrame) -> DataFrame:
    """``chapter_id`` and ``kind`` of the pages, as problem 5 finds them."""
    return text_types(pages, common_words, stats=()).select("chapter_id", "kind")
