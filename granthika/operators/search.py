"""Top passages by cosine similarity, sparse and dense.

Scale: both sides travel as packed blocks of rows, made where the rows lie, without a shuffle. A stated
query set meets all vectors block by block in one scan; a block of queries and one of vectors give a
matrix of scores of bounded size, of which only the best ``k`` of each query go on. Queries are sent to
all executors while their number is at most ``BROADCAST_QUERIES``; beyond, Spark pairs partitions of
blocks. Nothing passes through the driver. The sparse search reads vectors by item, not postings by
term, so no term, however frequent, is a key that rows meet under.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granthika.operators import blocks, tfidf

TOP_K = 3
#: Rows of a block: queries and vectors.
QUERY_BLOCK = 1024
VECTOR_BLOCK = 2048
BROADCAST_QUERIES = 20_000


def _packed(rows: DataFrame, key: str, columns: tuple[str, ...], size: int, prefix: str) -> DataFrame:
    """Blocks of at most ``size`` rows as bytes: keys, offsets, and the flat values of each list column."""
    kinds = (np.int64, np.int64, *(np.int32 if c == "terms" else np.float64 for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"{prefix}{c}" for c in ("keys", "offsets", *columns)]
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                lists = [b.column(i + 1) for i in range(len(columns))]
                offsets = lists[0].offsets.to_numpy()
                flat = [x.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] for x in lists]
                parts = [b.column(0).to_numpy(), offsets - offsets[0], *flat]
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in zip(parts, kinds, strict=True)], names=names)

    known = rows.where(F.col(key).isNotNull() & F.col(columns[0]).isNotNull()).select(F.col(key).cast("bigint"), *columns)
    return known.mapInArrow(run, ", ".join(f"{prefix}{c} binary" for c in ("keys", "offsets", *columns)))


def _sparse_scores(q: tuple[np.ndarray, ...], v: tuple[np.ndarray, ...]) -> np.ndarray:
    """Queries x vectors: sums over common terms."""
    (q_at, q_terms, q_weights), (v_at, v_terms, v_weights) = q, v
    n, m = len(q_at) - 1, len(v_at) - 1
    row = np.repeat(np.arange(n), np.diff(q_at))
    o = np.argsort(q_terms, kind="stable")
    terms, row, weights = q_terms[o], row[o], q_weights[o]
    lo, hi = np.searchsorted(terms, v_terms, "left"), np.searchsorted(terms, v_terms, "right")
    many = hi - lo
    column = np.repeat(np.repeat(np.arange(m), np.diff(v_at)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    return np.bincount(row[at] * m + column, weights[at] * np.repeat(v_weights, many), n * m).reshape(n, m)


def _dense_scores(q: tuple[np.ndarray, ...], v: tuple[np.ndarray, ...]) -> np.ndarray:
    lengths = np.concatenate([np.diff(q[0]), np.diff(v[0])])
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors and queries differ in length")
    return q[1].reshape(len(q[0]) - 1, -1) @ v[1].reshape(len(v[0]) - 1, -1).T


def _best(vectors: DataFrame, queries: DataFrame, columns: tuple[str, ...], k: int, key: str, query: str, positive: bool, block: int | None = None) -> DataFrame:
    """``query``, ``rn``, ``key``, ``score`` of the ``k`` best; scores are rounded to six digits, ties go to the lesser key."""
    v = _packed(vectors, key, columns, VECTOR_BLOCK, "v_")
    q = _packed(queries, query, columns, block or QUERY_BLOCK, "q_")
    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    kinds = (np.int32, np.float64) if len(columns) == 2 else (np.float64,)
    scored = _sparse_scores if len(columns) == 2 else _dense_scores
    schema = pa.schema([("q_", pa.int64()), ("v_", pa.int64()), ("score", pa.float64())])

    def side(b: pa.RecordBatch, i: int, prefix: str) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        names = ["keys", "offsets", *columns]
        got = [np.frombuffer(b.column(b.schema.get_field_index(prefix + c))[i].as_buffer(), d) for c, d in zip(names, (np.int64, np.int64, *kinds), strict=True)]
        return got[0], tuple(got[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (q_keys, x), (v_keys, y) = side(b, i, "q_"), side(b, i, "v_")
                s = np.round(scored(x, y), 6)
                # In order of the keys, so that the first of equal scores has the least.
                o = np.argsort(v_keys, kind="stable")
                s, v_keys = s[:, o], v_keys[o]
                rows = np.arange(len(q_keys))
                for _ in range(min(k, s.shape[1])):
                    top = s.argmax(1)
                    value = s[rows, top]
                    good = value > (0 if positive else -np.inf)
                    if not good.any():
                        break
                    yield pa.RecordBatch.from_arrays([pa.array(q_keys[good]), pa.array(v_keys[top[good]]), pa.array(value[good])], schema=schema)
                    s[rows, top] = -np.inf

    found = v.crossJoin(F.broadcast(q) if few else q).mapInArrow(run, "q_ bigint, v_ bigint, score double")
    kind, qkind = dict(vectors.dtypes)[key], dict(queries.dtypes)[query]
    named = found.select(F.col("q_").cast(qkind).alias(query), F.col("v_").cast(kind).alias(key), "score")
    rn = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.asc(key)))
    return named.withColumn("rn", rn).where(F.col("rn") <= k).select(query, "rn", key, "score")


def search_vectors(vectors: DataFrame, vocabulary: DataFrame, requests: DataFrame, k: int = TOP_K, item: str = "chunk_id", request: str = "request_id", text: str = "text") -> DataFrame:
    """``request``, ``rn``, ``item``, ``score`` of the best items of an index; requests without a common term have no row.

    ``vectors``: ``item``, ``terms``, ``weights``; ``vocabulary``: ``term``, ``term_id``, ``idf``.
    """
    return _best(vectors, tfidf.vectors(tfidf.term_counts(requests, request, text), vocabulary, request), ("terms", "weights"), k, item, request, True)


def sparse_topk(items: DataFrame, requests: DataFrame, k: int = TOP_K, item: str = "chunk_id", request: str = "request_id", text: str = "text") -> DataFrame:
    """As ``search_vectors``, fitting the items at hand; no index is stored."""
    return blocks.topk(items, requests, k, item, request, text)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 4, key: str = "vec_id", query: str = "query_id", column: str = "embedding", block: int | None = None) -> DataFrame:
    """``query``, ``rn``, ``key``, ``score``: dot products of the stated queries with all vectors.

    A vector of another length than the queries raises; null vectors are left out.
    """
    return _best(vectors, queries, (column,), k, key, query, False, block)


def dot(a, b):
    """Dot product of two array columns in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def checked_dimension(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """The vectors; one of another length raises when it is read."""
    bad = F.size(column) != dimension
    return vectors.withColumn(column, F.when(bad, F.raise_error(F.concat(F.lit("vector of length "), F.size(column).cast("string"), F.lit(f", expected {dimension}"))).cast(vectors.schema[column].dataType)).otherwise(F.col(column)))


def centroids(vectors: DataFrame, label: str = "label", column: str = "embedding") -> DataFrame:
    """Unit mean vector of each label: ``label``, ``dim``, ``value``."""
    long = vectors.select(label, F.posexplode(column).alias("dim", "x"))
    mean = long.groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = mean.groupBy(label).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.join(norm, label).select(label, "dim", F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(F.col("m")).alias("value"))
