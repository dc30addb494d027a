"""TF-IDF search that fits the items at hand, in blocks of items.

Scale: an item is one row, so its terms are counted where it lies, and a block of items carries a dictionary
of its own. Only the dictionaries meet: a term travels once for each block, not once for each item that has
it. The rest of a block (codes and counts) is stored once and read once. A block meets the queries as lists
by term, of the asked terms alone. A query reads its lists from the one that may add most, and stops where
the lists left cannot lift an unseen item to its best so far; the items it has seen are completed by lookups.
That bound holds for every item, so nothing is lost. Queries of equal terms are scored once. Nothing is
collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granthika.functions import text as T
from granthika.operators import tfidf
from granthika.session import settle

#: Most items of a block.
BLOCK = 131_072
#: Scores are rounded to six digits, so what lies closer than that to the best may tie with it.
ROUNDING = 1e-6


def merged(items: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``text``, one row for each key: rows that share a key are one item, as in counts by key and term."""
    rows = items.select(key, text)
    if rows.groupBy(key).count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy(key).agg(F.concat_ws("\n", F.collect_list(text)).alias(text))


def counted(items: DataFrame, key: str, text: str, size: int = BLOCK) -> DataFrame:
    """Blocks of at most ``size`` items: keys, offsets, codes and counts as bytes; ``terms`` and their ``dfs`` in order of the codes.

    An item without a key counts in ``dfs`` only.
    """
    stop = pa.array(T.STOPWORDS, pa.string())
    schema = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("keys", "offsets", "codes", "tfs")), ("terms", pa.list_(pa.string())), ("dfs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, parts, rows, dfs = TaskContext.get().partitionId() << 33, {}, [], 0, []

        def block() -> pa.RecordBatch:
            keys, lengths, codes, tfs = (np.concatenate(x) for x in zip(*parts, strict=True))
            df = np.bincount(np.concatenate(dfs), minlength=len(known))
            flat = [x.astype(t).tobytes() for x, t in ((keys, np.int64), (np.r_[0, np.cumsum(lengths)], np.int64), (codes, np.int32), (tfs, np.int32))]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *(pa.array([x], pa.binary()) for x in flat), pa.array([list(known)], pa.list_(pa.string())), pa.array([df], pa.list_(pa.int64()))], schema=schema)

        for whole in batches:
            for start in range(0, whole.num_rows, size):
                b = whole.slice(start, size)
                if rows + b.num_rows > size:
                    yield block()
                    at, known, parts, rows, dfs = at + 1, {}, [], 0, []
                lists = b.column(1)
                words = lists.flatten().dictionary_encode()
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                good = pc.and_(pc.greater(pc.utf8_length(words.dictionary), 2), pc.invert(pc.is_in(words.dictionary, stop)))
                code = np.array([known.setdefault(t, len(known)) if ok else -1 for t, ok in zip(words.dictionary.to_pylist(), good.to_pylist(), strict=True)], np.int64)
                codes = code[words.indices.to_numpy()] if len(code) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(b.num_rows), lengths)[codes >= 0]
                pairs, tfs = np.unique(row << 32 | codes[codes >= 0], return_counts=True)
                row, codes = pairs >> 32, pairs & 0xFFFFFFFF
                dfs.append(codes)
                keyed = pc.is_valid(b.column(0)).to_numpy(zero_copy_only=False)
                mine = keyed[row]
                parts.append((pc.fill_null(b.column(0), 0).to_numpy()[keyed], np.bincount(row, minlength=b.num_rows)[keyed], codes[mine], tfs[mine]))
                rows += b.num_rows
        if rows:
            yield block()

    tokens = items.select(F.col(key).cast("bigint"), T.all_tokens(F.col(text)))
    return tokens.mapInArrow(run, "block bigint, keys binary, offsets binary, codes binary, tfs binary, terms array<string>, dfs array<bigint>")


class Lists:
    """The items of a block by term: for each asked term the items that have it, in order of their keys, and their weights."""

    def __init__(self, keys: np.ndarray, offsets: np.ndarray, codes: np.ndarray, tfs: np.ndarray, idf: np.ndarray, ids: np.ndarray):
        """``idf`` and ``ids`` by code: 0 where a term is none of the vocabulary, -1 where it is not asked for."""
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        row = np.repeat(place, np.diff(offsets))
        raw = (np.log(tfs) + 1) * idf[codes]
        norm = np.sqrt(np.bincount(row, raw * raw, len(keys)))
        asked = (ids[codes] >= 0) & (raw > 0)
        row, term, weight = row[asked], ids[codes[asked]], raw[asked] / norm[row[asked]]
        o = np.argsort(term * len(keys) + row)
        self.rows, self.weights, term = row[o], weight[o], term[o]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        most = np.maximum.reduceat(self.weights, first) if len(first) else self.weights
        last = np.append(first, len(term))[1:]
        self.lists = {t: (a, b, m) for t, a, b, m in zip(*(x.tolist() for x in (term[first], first, last, most)), strict=True)}
        self.sums = np.zeros(len(keys))
        self.read = 0

    def top(self, terms: list[int], weights: list[float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and scores of the ``k`` best: rounded to six digits, above 0, ties in order of the keys."""
        found = sorted(((w * x[2], w, x[0], x[1]) for t, w in zip(terms, weights, strict=True) if (x := self.lists.get(t))), reverse=True)
        if not found:
            return self.keys[:0], self.sums[:0]
        # What the lists from each on may add: by their largest weights, and by their length, as an item has length 1.
        rest, plain, square = [0.0], 0.0, 0.0
        for bound, w, _, _ in reversed(found):
            plain, square = plain + bound, square + w * w
            rest.append(min(plain, square**0.5))
        rest.reverse()
        sums, least, seen = self.sums, 0.0, []
        for j, (_, w, a, b) in enumerate(found, 1):
            x = self.rows[a:b]
            s = sums[x] + w * self.weights[a:b]
            sums[x] = s
            seen.append(x)
            if b - a >= k:
                least = max(least, float(s.max() if k == 1 else np.partition(s, -k)[-k]))
            if rest[j] < least - ROUNDING:
                break
        self.read += sum(map(len, seen))
        floor = least - rest[j] - ROUNDING
        near = np.concatenate([x[sums[x] >= floor] for x in seen])
        near = np.unique(near) if len(seen) > 1 else near
        s = sums[near]
        for x in seen:
            sums[x] = 0
        for _, w, a, b in found[j:]:
            x = self.rows[a:b]
            at = np.minimum(np.searchsorted(x, near), b - a - 1)
            s += np.where(x[at] == near, w * self.weights[a:b][at], 0)
        s = np.round(s, 6)
        o = np.lexsort((near, -s))[:k]
        o = o[s[o] > 0]
        return self.keys[near[o]], s[o]


def _queries(requests: DataFrame, vocab: DataFrame, request: str, text: str) -> DataFrame:
    """``request``, ``query_`` (the least request of the same terms), ``bag_``: ids, counts and idf of its terms."""
    counts = tfidf.term_counts(requests.where(F.col(request).isNotNull()), request, text)
    bags = counts.join(vocab, "term").groupBy(request).agg(F.array_sort(F.collect_list(F.struct("term_id", "tf", "idf"))).alias("bag_"))
    return bags.withColumn("query_", F.min(request).over(Window.partitionBy("bag_")))


def _packed(queries: DataFrame, request: str) -> DataFrame:
    """The distinct queries as packs of bytes: keys, offsets, term ids and weights of unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags, flat = b.column(1), b.column(1).flatten()
            lengths = pc.list_value_length(bags).to_numpy()
            ids, tfs, idf = (flat.field(i).to_numpy() for i in range(3))
            raw = (np.log(tfs) + 1) * idf
            row = np.repeat(np.arange(len(lengths)), lengths)
            weights = raw / np.sqrt(np.bincount(row, raw * raw, len(lengths)))[row]
            parts = (b.column(0).to_numpy(), np.r_[0, np.cumsum(lengths)], ids, weights)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(parts, (np.int64, np.int64, np.int64, np.float64), strict=True)], names=["q_keys", "q_offsets", "q_terms", "q_weights"])

    own = queries.where(F.col(request) == F.col("query_")).select(F.col("query_").cast("bigint"), "bag_")
    return own.mapInArrow(run, "q_keys binary, q_offsets binary, q_terms binary, q_weights binary")


def topk(items: DataFrame, requests: DataFrame, k: int, item: str, request: str, text: str) -> DataFrame:
    """``request``, ``rn``, ``item``, ``score`` of the ``k`` best items; requests without a common term have no row."""
    blocks = settle(counted(merged(items, item, text), item, text))
    terms = blocks.select("block", F.posexplode(F.arrays_zip("terms", "dfs")).alias("code", "t_")).select("block", "code", "t_.terms", "t_.dfs").withColumnRenamed("terms", "term")
    vocab = tfidf.weighed(terms.groupBy("term").agg(F.sum("dfs").alias("df")), items)
    words = tfidf.term_counts(requests, request, text).select("term").distinct()
    asked = settle(tfidf.with_ids(vocab.join(words, "term", "left_semi")))
    queries = settle(_queries(requests, asked.select("term", "term_id", "idf"), request, text))

    weighed = terms.join(vocab.select("term", "idf"), "term").join(asked.select("term", "term_id"), "term", "left")
    dictionary = weighed.groupBy("block").agg(F.collect_list(F.struct("code", "idf", F.coalesce("term_id", F.lit(-1)).alias("term_id"))).alias("dictionary"))
    left = blocks.select("block", "keys", "offsets", "codes", "tfs", F.size("terms").alias("n")).join(dictionary, "block")
    right = _packed(queries, request).crossJoin(F.broadcast(blocks.select(F.col("block").alias("to_"))))
    schema = pa.schema([("q_", pa.int64()), ("v_", pa.int64()), ("score", pa.float64())])

    def run(block: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for b in block.combine_chunks().to_batches():
            keys, offsets, codes, tfs = (np.frombuffer(b.column(c)[0].as_buffer(), t) for c, t in (("keys", np.int64), ("offsets", np.int64), ("codes", np.int32), ("tfs", np.int32)))
            flat = b.column("dictionary").flatten()
            code = flat.field(0).to_numpy()
            idf, ids = np.zeros(b.column("n")[0].as_py()), np.full(b.column("n")[0].as_py(), -1, np.int64)
            idf[code], ids[code] = flat.field(1).to_numpy(), flat.field(2).to_numpy()
            lists = Lists(keys, offsets, codes, tfs, idf, ids)
            for p in asking.to_batches():
                for i in range(p.num_rows):
                    q, at, t, w = (np.frombuffer(p.column(f"q_{c}")[i].as_buffer(), d).tolist() for c, d in (("keys", np.int64), ("offsets", np.int64), ("terms", np.int64), ("weights", np.float64)))
                    out += [(x, *lists.top(t[a:e], w[a:e], k)) for x, a, e in zip(q, at, at[1:])]  # noqa: B905
        if not out:
            return schema.empty_table()
        got = np.repeat(np.array([x for x, _, _ in out], np.int64), [len(x) for _, x, _ in out])
        return pa.table([got, np.concatenate([x for _, x, _ in out]), np.concatenate([x for _, _, x in out])], schema=schema)

    found = left.groupBy("block").cogroup(right.groupBy("to_")).applyInArrow(run, "q_ bigint, v_ bigint, score double")
    kind, qkind = dict(items.dtypes)[item], dict(requests.dtypes)[request]
    named = found.select(F.col("q_").cast(qkind).alias("query_"), F.col("v_").cast(kind).alias(item), "score")
    rn = F.row_number().over(Window.partitionBy("query_").orderBy(F.desc("score"), F.asc(item)))
    best = named.withColumn("rn", rn).where(F.col("rn") <= k)
    return queries.select(request, "query_").join(best, "query_").select(request, "rn", item, "score")
