"""Queries over the corpus operators, pN_ for problem N."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.llm import languages, levels, mixing, neardup, packing, pages, quality, scans, sitelines, splitting
from granthika.registry import Registry
from granthika.session import table

REGISTRY = Registry()

P6_SQL = r"""
WITH lines AS (
  SELECT chapter_id, content_id, lower(regexp_extract(trim(source), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS site,
         string_split(text, chr(10)) AS parts
  FROM chapters WHERE source IS NOT NULL AND text IS NOT NULL
), keyed AS (
  SELECT chapter_id, content_id, site, i AS line_no, lower(regexp_replace(parts[i], '\P{L}+', '', 'g')) AS k
  FROM lines, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
), sized AS (SELECT site, count(DISTINCT content_id) AS n FROM lines GROUP BY site),
cases AS (
  SELECT a.site, a.k FROM keyed a JOIN sized s ON s.site = a.site WHERE length(a.k) >= 15
  GROUP BY a.site, a.k, s.n HAVING count(DISTINCT a.content_id) >= 5 AND count(DISTINCT a.content_id) >= 0.05 * s.n
)
SELECT chapter_id, CAST(line_no AS BIGINT) AS line_no FROM keyed JOIN cases USING (site, k)
"""


@REGISTRY.add("p6_found", P6_SQL)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.found(table(spark, sf_dir, "chapters"))


@REGISTRY.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.found(table(spark, sf_dir, "chapters"), table(spark, sf_dir, "common_words"))


@REGISTRY.add("p5_text_statistics")
def p5_text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, type and confidence of every chapter."""
    return quality.chapter_types(table(spark, sf_dir, "chapters"), table(spark, sf_dir, "common_words")).drop("pattern")


P3_SQL = r"""
WITH lim AS (SELECT corpus, max(chunk_max_words) AS m FROM manifest WHERE corpus IS NOT NULL GROUP BY corpus)
SELECT chunk_id FROM chunks JOIN lim USING (corpus)
WHERE len(regexp_extract_all(text, '[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) > m
"""


@REGISTRY.add("p3_found", P3_SQL)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.found(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "manifest"))


@REGISTRY.add("p3_pieces")
def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, the oversized ones as numbered pieces."""
    return splitting.pieces(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "manifest"))


P7_SQL = """
SELECT container, doc_id FROM documents, containers
WHERE coalesce(octet_length(encode(text)), 0) + 1 > capacity_tokens
"""


@REGISTRY.add("p7_found", P7_SQL)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


@REGISTRY.add("p7_use_of_space")
def p7_use_of_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins and filled share of each container."""
    containers = table(spark, sf_dir, "containers")
    return packing.use_of_space(packing.packed_documents(table(spark, sf_dir, "documents"), containers), containers)


P8_SQL = r"""
WITH sized AS (SELECT lower(regexp_replace(source, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS source, coalesce(octet_length(encode(text)), 0) + 1 AS tokens FROM documents),
every AS (SELECT sum(tokens) AS n FROM sized),
held AS (SELECT source, sum(tokens) AS tokens FROM sized GROUP BY source)
SELECT t.source FROM mix_targets t CROSS JOIN every LEFT JOIN held h ON h.source = t.source
WHERE coalesce(h.tokens, 0) * t.max_repeats < t.target_weight * every.n
"""


@REGISTRY.add("p8_found", P8_SQL)
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@REGISTRY.add("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source in a mixture as large as the corpus."""
    return mixing.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@REGISTRY.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_samples"), table(spark, sf_dir, "lang_samples"))


P1_SQL = r"""
WITH words AS (SELECT chapter_id, list_filter(regexp_split_to_array(lower(text), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS w FROM chapters WHERE text IS NOT NULL),
runs AS (SELECT DISTINCT chapter_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM words, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i) WHERE len(w) >= 20),
sized AS (SELECT chapter_id, count(*) AS n FROM runs GROUP BY chapter_id),
shared AS (SELECT a.chapter_id AS x, b.chapter_id AS y, count(*) AS c FROM runs a JOIN runs b ON a.s = b.s AND a.chapter_id < b.chapter_id GROUP BY a.chapter_id, b.chapter_id)
SELECT x AS chapter_id_a, y AS chapter_id_b FROM shared JOIN sized a ON a.chapter_id = x JOIN sized b ON b.chapter_id = y
WHERE 5 * c >= 3 * (a.n + b.n - c)
"""


@REGISTRY.add("p1_found", P1_SQL)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.found(table(spark, sf_dir, "chapters"))


P1_GROUPS_SQL = r"""
WITH RECURSIVE words AS (SELECT chapter_id, list_filter(regexp_split_to_array(lower(text), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS w FROM chapters WHERE text IS NOT NULL),
members AS (SELECT chapter_id AS id, md5(array_to_string(w, ' ')) AS k, w FROM words WHERE len(w) >= 5),
once AS (SELECT k, min(id) AS first, count(*) AS copies, any_value(w) AS w FROM members GROUP BY k),
runs AS (SELECT DISTINCT k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s FROM once, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
sized AS (SELECT k, count(*) AS n FROM runs GROUP BY k),
shared AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM runs a JOIN runs b ON a.s = b.s AND a.k <> b.k GROUP BY a.k, b.k),
links AS (SELECT x, y FROM shared JOIN sized a ON a.k = x JOIN sized b ON b.k = y WHERE 5 * c >= 4 * (a.n + b.n - c)),
reach AS (SELECT k AS x, k AS y FROM once UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
named AS (SELECT r.x AS k, min(o.first) AS group_id FROM reach r JOIN once o ON o.k = r.y GROUP BY r.x),
degree AS (SELECT x AS k, count(*) AS links FROM links GROUP BY x)
SELECT id, group_id, copies, coalesce(links, 0) AS links FROM members JOIN once USING (k) JOIN named USING (k) LEFT JOIN degree USING (k)
"""


@REGISTRY.add("p1_groups", P1_GROUPS_SQL)
def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter of five words or more with its group of near-duplicates, at five words and 0.8."""
    return neardup.near_duplicates(table(spark, sf_dir, "chapters"), "chapter_id", "text").groups()


@REGISTRY.add("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pages.without_site_lines(table(spark, sf_dir, "chapters"))
    return scans.found(own, pages.types_of(own, table(spark, sf_dir, "common_words")))


@REGISTRY.add("p4_repaired")
def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter as continuous paragraphs."""
    return scans.repaired(pages.without_site_lines(table(spark, sf_dir, "chapters"))).drop("noise")


@REGISTRY.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pages.without_site_lines(table(spark, sf_dir, "chapters"))
    return languages.found(own, pages.types_of(own, table(spark, sf_dir, "common_words")), table(spark, sf_dir, "lang_samples"), table(spark, sf_dir, "level_samples"))


@REGISTRY.add("p2_passages")
def p2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every passage of every chapter."""
    own = pages.without_site_lines(table(spark, sf_dir, "chapters"))
    return languages.document_languages(own, languages.fit(table(spark, sf_dir, "lang_samples"), table(spark, sf_dir, "level_samples")), by_passage=True)
