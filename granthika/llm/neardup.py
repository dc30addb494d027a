"""Near-duplicate records by exact set similarity (problem 1).

A record is the set of its runs of ``shingle`` words; two records are linked when the Jaccard
similarity of their sets reaches the threshold. The join is size-aware:

* Light sets enumerate fixed-size subsets. Runs have one global order, rare ones first. Two linked
  sets share at least k runs among their first n - t + k, t being the least overlap the threshold
  asks for. With these runs hashed into m = k - 1 parts, some part holds two shared runs, so equal
  2-subsets within a part find every pair. m depends on a class of sizes; a set also takes part in
  the next class when a partner there is possible.
* Heavy sets, from a size on that a cost model chooses from the size distribution, would enumerate
  too many subsets; they scan the inverted lists of their first n - t + 1 runs instead.

A candidate must pass the size filter and a parity bitmap, whose differing bits never exceed the
symmetric difference of the sets; both filters lose nothing. What remains is verified exactly.

Scale: the global order comes from counts in a table of fixed size (``SLOTS`` bytes when it is
broadcast), which only steers efficiency: any order gives the same links. Tasks' counts are summed by
groups of tasks first. Subsets travel as packed arrays, bucketed by hash, a task for each bucket and the
number of buckets following the data. A subset that more than ``HOT`` records may share, as the counts
tell, is divided: its records fall into blocks, and every pair of blocks is a list of its own. Records with the same words are
one class from the start, so groups of exact copies cost nothing but their membership rows, and no
link, component or fingerprint of all records ever reaches the driver.

Edge cases: null and short texts (fewer than ``min_words`` words) have no links; ties and repeated
rows are links like any other, also under equal ids (a pair then has equal ids and is left out);
an empty table gives no rows; very long texts are read whole.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthika.session import settle

SLOTS = 1 << 22
SLICES = 32
#: Lower bounds of the classes of sizes.
CLASSES = (1, 4, 15, 60, 240, 960, 3840, 15360, 61440, 245760)
FLUSH_RUNS = 2_000_000
BUCKET_RUNS = 4_000_000
#: Records of a list that are compared in one place; longer lists are divided into pairs of such blocks.
HOT = 8192
#: Steps an octave in the table of counts.
OCTAVE = 8
#: Tasks whose counts are summed before those sums are.
GROUP_TASKS = 64
#: So many ids at most (8 bytes each) are broadcast to fetch the texts of candidates; beyond, they are joined.
BROADCAST_IDS = 500_000
_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Runs of words as 64-bit hashes; a table keeps the hash of each distinct word."""

    def __init__(self, width: int, min_words: int, most: int = 1_000_000):
        self.width, self.least, self.most = width, max(width, min_words), most
        self.known: dict[str, int] = {}

    def words(self, text: str) -> list[int] | None:
        """Hashes of the lower-cased words, or None for a text that is too short."""
        ws = text.lower().split()
        if len(ws) < self.least:
            return None
        known = self.known
        try:
            return [known[w] for w in ws]
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in ws:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            return [known[w] for w in ws]

    def runs(self, docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(record, hash) of every run of the records, repeats included."""
        n = np.array([len(d) for d in docs])
        w = np.fromiter((x for d in docs for x in d), np.uint64, int(n.sum()))
        doc = np.repeat(np.arange(len(docs)), n)
        h = w.copy()
        last = len(w) - self.width + 1
        h = h[:last]
        for i in range(1, self.width):
            h = h * _P + _mix(w[i : last + i])
        keep = doc[:last] == doc[self.width - 1 :]
        return doc[:last][keep], _mix(h[keep])


def _key(words: list[int]) -> int:
    return xxhash.xxh64_intdigest(np.array(words, np.uint64).tobytes()) - (1 << 63)


def _documents(batches: Iterator[pa.RecordBatch], shingler: Shingler) -> Iterator[tuple[list[int], list[list[int]]]]:
    """Ids and word hashes of the records, in groups of about ``FLUSH_RUNS`` words."""
    ids: list[int] = []
    docs: list[list[int]] = []
    held = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = shingler.words(t) if t is not None and i is not None else None
            if w is not None:
                ids.append(i)
                docs.append(w)
                held += len(w)
                if held >= FLUSH_RUNS or len(docs) == 65_535:
                    yield ids, docs
                    ids, docs, held = [], [], 0
    if docs:
        yield ids, docs


def _first_pass(width: int, min_words: int):
    """Membership rows (slice -1) and, per task, counts of the runs by slot in slices, with the task's group ``part``."""
    names = ["slice", "part", "counts", "id", "key", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        any_docs = False
        for ids, docs in _documents(batches, Shingler(width, min_words)):
            any_docs = True
            _, h = Shingler(width, min_words).runs(docs)
            counts += np.bincount((h & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
            n = len(docs)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), pa.array(np.full(n, -1, np.int32)), pa.array([None] * n, pa.binary()), pa.array(ids, pa.int64()), pa.array([_key(d) for d in docs], pa.int64()), pa.array([len(d) for d in docs], pa.int32())], names=names)
        if any_docs:
            group = TaskContext.get().partitionId() // GROUP_TASKS
            for s, part in enumerate(np.split(counts, SLICES)):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([group], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int32())], names=names)

    return run


def _sum_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the slices' counts, by group of tasks where one is given."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for pdf in batches:
        for s, part, blob in zip(pdf["slice"], pdf["part"], pdf["counts"], strict=True):
            counts = np.frombuffer(zlib.decompress(blob), np.int64)
            sums[s, part] = sums[s, part] + counts if (s, part) in sums else counts
    for (s, _), total in sums.items():
        yield pd.DataFrame({"slice": [s], "part": [-1], "counts": [zlib.compress(total.tobytes(), 1)]})


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Codes of the summed counts: 0 none, 1 exactly one, then ``OCTAVE`` steps an octave."""
    for pdf in _sum_slices(batches):
        total = np.frombuffer(zlib.decompress(pdf["counts"][0]), np.int64)
        code = np.minimum(255, np.floor(OCTAVE * np.log2(np.maximum(total, 1))) + 1).astype(np.uint8)
        code[total == 0] = 0
        yield pd.DataFrame({"slice": pdf["slice"], "codes": [zlib.compress(code.tobytes(), 1)]})


def most_of(codes: np.ndarray) -> np.ndarray:
    """The greatest count that a code stands for."""
    return np.exp2(codes.astype(float) / OCTAVE)


def _least(size: np.ndarray, threshold: float) -> np.ndarray:
    """Least overlap of a set of this size with one that is not larger and similar enough."""
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


def parts_of(bound: int, threshold: float) -> int:
    """Parts of a class of sizes from ``bound`` on; 0: single runs are the subsets."""
    return max(0, min(int(0.4 * bound), int(np.ceil(threshold * bound - 1e-9)) - 1))


def subsets_of(size: float, bound: int, threshold: float) -> float:
    """Subsets that a set of this size enumerates in the class, as expected."""
    m = parts_of(bound, threshold)
    p = max(0.0, size - threshold * max(size, bound)) + m + 1
    p = min(p, size)
    return p * max(p - 1, 0) / (2 * m) if m else p


def list_length(codes: np.ndarray, share: float) -> float:
    """Mean length of the lists that the rarest ``share`` of all postings stand in, as the slots' counts tell."""
    per_code = np.bincount(codes, minlength=256)[1:]
    count = 2 ** (np.arange(255) / OCTAVE)
    held = np.cumsum(per_code * count)
    rare = held <= max(share * held[-1], held[np.argmax(held > 0)])
    postings = (per_code * count)[rare].sum()
    return float((per_code * count * count)[rare].sum() / postings) if postings else 1.0


def choose_boundary(sizes: dict[int, int], threshold: float, list_length: float) -> int:
    """Size from which sets scan inverted lists: the cheapest over all, by expected rows and comparisons.

    A subset costs 1; a posting 1.2, also of the sets that a heavy one may be similar to; a comparison
    with a member of a list 0.3, and lists hold only the sets that are large enough.
    """

    def light(n: int, x: float) -> float:
        return sum(subsets_of(n, b, threshold) for c, b in enumerate(CLASSES) if b < x and b * threshold <= n and (c + 1 == len(CLASSES) or n < CLASSES[c + 1]))

    best, chosen = None, 1 << 60
    every = max(1, sum(n * k for n, k in sizes.items()))
    for x in [*sorted({*CLASSES[2:], *(s for s in sizes if s >= 60)}), 1 << 60]:
        cost = 0.0
        length = list_length * sum(n * k for n, k in sizes.items() if n >= threshold * x) / every
        for n, k in sizes.items():
            if n < x:
                cost += k * light(n, x)
                if n >= threshold * x:
                    cost += k * 1.2 * (n - threshold * x + 1)
            else:
                cost += k * (1 - threshold) * n * (1.2 + 0.3 * length)
        if best is None or cost < best:
            best, chosen = cost, x
    return chosen


def map_words(sizes: np.ndarray) -> np.ndarray:
    """64-bit words of a record's bitmap: a power of two, so that a large one folds onto a small one."""
    return np.exp2(np.ceil(np.log2(np.clip(2 * sizes, 128, 4096) / 64))).astype(np.int64)


def _bitmaps(doc: np.ndarray, h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Parity bitmaps of all records, one after the other: each run flips one bit of its record's."""
    starts = np.cumsum(words) - words
    cell = starts[doc] * 64 + ((h >> np.uint64(17)) % (words[doc] * 64).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(cell, minlength=int(words.sum()) * 64) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def _folded(flat: np.ndarray, start: np.ndarray, words: np.ndarray, k: int, to: int) -> np.ndarray:
    """Word ``k`` of bitmaps folded to ``to`` words."""
    out = flat[start + k]
    for r in range(1, int(words.max() // to)):
        more = np.flatnonzero(words > r * to)
        out[more] ^= flat[start[more] + r * to + k]
    return out


def _spread(sig: np.ndarray, doc: np.ndarray, most: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists that may be longer than ``HOT``, divided into pairs of blocks of their records."""
    blocks = np.ceil(most / HOT).astype(np.int64)
    hot = np.flatnonzero(blocks > 1)
    if not len(hot):
        return sig, doc
    n = blocks[hot]
    mine = (_mix(keys[doc[hot]].view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(hot)), n)
    other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    low, high = np.minimum(mine[at], other), np.maximum(mine[at], other)
    cold = np.flatnonzero(blocks <= 1)
    split = _mix(sig[hot][at] + _mix((low * (1 << 31) + high + 1).astype(np.uint64)))
    return np.concatenate([sig[cold], split]), np.concatenate([doc[cold], doc[hot][at]])


def _second_pass(width: int, min_words: int, threshold: float, codes, heavy: int, buckets: int):
    """Subsets and postings of all records as packed arrays: (bucket, class, blob)."""

    def blobs(c: int, sig: np.ndarray, doc: np.ndarray, most: np.ndarray, keys: np.ndarray, sizes: np.ndarray, words: np.ndarray, maps: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        sig, doc = _spread(sig, doc, most, keys)
        first = np.cumsum(words) - words
        # 32 bits tell the subsets of a bucket apart but for a few, which the bitmaps then reject.
        bucket = ((sig >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        low = sig & np.uint64((1 << 32) - 1)
        o = np.argsort(bucket.astype(np.uint64) << np.uint64(32) | low)
        bucket, low, doc = bucket[o], low[o], doc[o]
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in range(buckets):
            s = slice(ends[b], ends[b + 1])
            if ends[b] == ends[b + 1]:
                continue
            used, at = np.unique(doc[s], return_inverse=True)
            value = low[s]
            step = np.diff(value, prepend=np.uint64(0))
            n = words[used]
            mine = np.repeat(first[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            head = np.array([len(used), len(value), len(mine)], np.int64).tobytes()
            # Steps above 16 bits are rare: they are kept whole in a list of their own.
            wide = np.flatnonzero(step >= np.uint64(1 << 16))
            body = [head, np.array([len(wide)], np.int64).tobytes(), wide.astype(np.uint32).tobytes(), step[wide].astype(np.uint32).tobytes(), keys[used].tobytes(), sizes[used].astype(np.int32).tobytes(), maps[mine].tobytes(), (step & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), at.astype(np.uint16).tobytes()]
            yield b, c, b"".join(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(codes.value, np.uint8)
        shingler = Shingler(width, min_words)
        for ids, docs in _documents(batches, shingler):
            del ids
            keys = np.array([_key(d) for d in docs], np.int64)
            # Equal records of a batch go once.
            _, first = np.unique(keys, return_index=True)
            docs, keys = [docs[i] for i in first], keys[first]
            doc, h = shingler.runs(docs)
            code = table[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
            o = np.argsort(doc.astype(np.uint64) << np.uint64(44) | code.astype(np.uint64) << np.uint64(36) | h >> np.uint64(28))
            doc, h, code = doc[o], h[o], code[o]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            doc, h, code = doc[new], h[new], code[new]
            sizes = np.bincount(doc, minlength=len(docs))
            at = np.arange(len(doc)) - np.concatenate([[0], np.cumsum(sizes)[:-1]])[doc]
            shared = code > 1
            words = map_words(sizes)
            maps = _bitmaps(doc, h, words)
            most = most_of(code)
            out: list[tuple[int, int, bytes]] = []
            for c, bound in enumerate(CLASSES):
                top = CLASSES[c + 1] if c + 1 < len(CLASSES) else 1 << 60
                role = (sizes < min(top, heavy)) & (sizes >= threshold * bound - 1e-9) & (bound < heavy)
                if not role.any():
                    continue
                m = parts_of(bound, threshold)
                prefix = np.where(role, sizes - _least(np.maximum(sizes, bound), threshold) + m + 1, 0)
                take = (at < prefix[doc]) & shared
                d, x, held = doc[take], h[take], most[take]
                if m:
                    g = d * m + (_mix(x) % np.uint64(m)).astype(np.int64)
                    o = np.argsort(g, kind="stable")
                    d, x, g, held = d[o], x[o], g[o], held[o]
                    sig, of, long = [], [], []
                    ok = np.arange(len(g))
                    for off in range(1, len(g)):
                        ok = ok[: np.searchsorted(ok, len(g) - off)]
                        ok = ok[g[ok + off] == g[ok]]
                        if not len(ok):
                            break
                        sig.append(_mix(x[ok] * _P + _mix(x[ok + off]) + np.uint64(c)))
                        of.append(d[ok])
                        long.append(np.minimum(held[ok], held[ok + off]))
                    if not sig:
                        continue
                    sig, of, held = np.concatenate(sig), np.concatenate(of), np.concatenate(long)
                else:
                    sig, of = _mix(x + np.uint64(c + 1)), d
                if len(sig):
                    out += blobs(c, sig, of, held, keys, sizes, words, maps)
            role = sizes >= threshold * heavy - 1e-9
            if role.any():
                prefix = np.where(role, sizes - _least(np.maximum(sizes, heavy) if heavy < 1 << 60 else sizes, threshold) + 1, 0)
                take = (at < prefix[doc]) & shared
                if take.any():
                    out += blobs(len(CLASSES), _mix(h[take] + np.uint64(99)), doc[take], most[take], keys, sizes, words, maps)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "class", "blob"])

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    docs, sigs, cells, wide = np.frombuffer(blob, np.int64, 4)
    p = 32

    def take(kind, n: int) -> np.ndarray:
        nonlocal p
        x = np.frombuffer(blob, kind, n, p)
        p += x.nbytes
        return x

    where, big = take(np.uint32, wide), take(np.uint32, wide)
    keys, sizes, maps = take(np.int64, docs), take(np.int32, docs), take(np.uint64, cells)
    step, at = take(np.uint16, sigs).astype(np.uint64), take(np.uint16, sigs)
    step[where] = big
    return np.cumsum(step), at.astype(np.int64), keys, sizes, maps


def _candidates(threshold: float, heavy: int):
    """Pairs of a bucket that share a subset (or, with a heavy set, a run) and pass both filters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        slack = (1 - threshold) / (1 + threshold)
        for c in sorted(pdf["class"].unique()):
            blobs = pdf["blob"][pdf["class"] == c]
            parts = [_unpack(b) for b in blobs]
            base = np.cumsum([0, *(len(p[2]) for p in parts)])
            sig = np.concatenate([p[0] for p in parts])
            doc = np.concatenate([p[1] + base[i] for i, p in enumerate(parts)])
            keys, sizes, maps = (np.concatenate([p[j] for p in parts]) for j in (2, 3, 4))
            words = map_words(sizes)
            starts = np.cumsum(words) - words
            del parts
            # Equal records from different batches are one.
            keys, first, same = np.unique(keys, return_index=True, return_inverse=True)
            sizes, words, starts, doc = sizes[first].astype(np.int64), words[first], starts[first], same[doc]
            o = np.argsort(sig, kind="stable")
            sig, doc = sig[o], doc[o]
            again = np.zeros(len(sig), bool)
            eq = sig[1:] == sig[:-1]
            again[1:] |= eq
            again[:-1] |= eq
            sig, doc = sig[again], doc[again]
            o = np.argsort(doc, kind="stable")
            sig, doc = sig[o], doc[o]
            o = np.argsort(sig, kind="stable")
            sig, doc = sig[o], doc[o]
            one = np.ones(len(sig), bool)
            one[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
            sig, doc = sig[one], doc[one]
            ok = np.arange(len(sig))
            if c == len(CLASSES):
                # Heavy sets stand first in their lists; only they scan what follows.
                large = sizes[doc] >= heavy
                o = np.lexsort((~large, sig))
                sig, doc, ok = sig[o], doc[o], np.flatnonzero(large[o])
            for off in range(1, len(sig)):
                # Only places whose group goes on are looked at again, so the work is that of the pairs.
                ok = ok[: np.searchsorted(ok, len(sig) - off)]
                ok = ok[sig[ok + off] == sig[ok]]
                if not len(ok):
                    break
                for at in range(0, len(ok), 500_000):
                    a, b = doc[ok[at : at + 500_000]], doc[ok[at : at + 500_000] + off]
                    na, nb = sizes[a], sizes[b]
                    keep = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
                    a, b = a[keep], b[keep]
                    differ = np.zeros(len(a), np.int64)
                    least = np.minimum(words[a], words[b])
                    for to in np.unique(least):
                        at_ = np.flatnonzero(least == to)
                        x, y = a[at_], b[at_]
                        for k in range(to):
                            differ[at_] += np.bitwise_count(_folded(maps, starts[x], words[x], k, to) ^ _folded(maps, starts[y], words[y], k, to))
                    keep = differ <= np.floor(slack * (sizes[a] + sizes[b]) + 1e-9)
                    if keep.any():
                        found.append(np.unique(np.stack([keys[a[keep]], keys[b[keep]]], 1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"key_a": pairs.min(1), "key_b": pairs.max(1)})

    return run


class NearDuplicates:
    """``members``: id, key (records with the same words share one); ``links``: key_a < key_b, common, similarity."""

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links

    def pairs(self) -> DataFrame:
        """Every linked pair of records, ``id_a`` < ``id_b``; copies are expanded."""
        several = self.members.groupBy("key").count().where("count > 1").select(F.col("key").alias("key_a"), F.col("key").alias("key_b"))
        both = self.links.select("key_a", "key_b").unionByName(several)
        a = self.members.select(F.col("id").alias("x"), F.col("key").alias("key_a"))
        b = self.members.select(F.col("id").alias("y"), F.col("key").alias("key_b"))
        return both.join(a, "key_a").join(b, "key_b").where("x <> y and (key_a <> key_b or x < y)").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """One row per record: ``group_id`` (least id that links lead to), ``links`` to other texts, ``copies`` of its own."""
        roots = components(self.links)
        one = self.members.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        rooted = one.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("group_id")), "root")
        ends = self.links.select(F.col("key_a").alias("key")).unionByName(self.links.select(F.col("key_b").alias("key"))).groupBy("key").agg(F.count("*").alias("links"))
        return self.members.join(named.join(ends, "key", "left").select("key", "group_id", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links")), "key").select("id", "group_id", "copies", "links")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``key``, ``root``: the least key reachable over links, by rounds of large and small stars."""
    edges = settle(links.select(F.col("key_a").alias("u"), F.col("key_b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        after = settle(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        same = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        edges = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    lows = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("key"), "root")
    return lows.unionByName(lows.select(F.col("root").alias("key"), "root").distinct().join(lows.select("key"), "key", "left_anti"))


def near_duplicates(records: DataFrame, id_col: str, text: str, shingle: int = 5, threshold: float = 0.8, min_words: int = 0, heavy: int | None = None) -> NearDuplicates:
    """Links between records whose runs of ``shingle`` words have a Jaccard similarity of ``threshold`` or more.

    ``heavy`` fixes the size from which inverted lists are scanned; by default the cost model chooses it.
    """
    spark = records.sparkSession
    docs = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    seen = settle(docs.mapInArrow(_first_pass(shingle, min_words), "slice int, part int, counts binary, id bigint, key bigint, n_words int"))
    members = seen.where("slice = -1").select("id", "key", "n_words")
    grouped = seen.where("slice >= 0").select("slice", "part", "counts").repartition("slice", "part").mapInPandas(_sum_slices, "slice int, part int, counts binary")
    coded = grouped.repartition(SLICES, "slice").mapInPandas(_coded, "slice int, codes binary").collect()
    codes = np.zeros(SLOTS, np.uint8)
    for r in coded:
        codes[r.slice * (SLOTS // SLICES) : (r.slice + 1) * (SLOTS // SLICES)] = np.frombuffer(zlib.decompress(r.codes), np.uint8)
    shared = spark.sparkContext.broadcast(codes.tobytes())
    # Sizes in steps of an eighth: a bounded histogram.
    histogram = members.groupBy(F.floor(F.log(F.greatest(F.col("n_words"), F.lit(1))) * 8).alias("step")).agg(F.count("*").alias("n"), F.sum(F.col("n_words").cast("bigint")).alias("words")).collect()
    sizes = {max(1, int(r.words / r.n)): r.n for r in histogram}
    total = sum(r.words for r in histogram)
    length = list_length(codes, 1 - threshold)
    heavy = choose_boundary(sizes, threshold, length) if heavy is None else heavy
    buckets = max(1, -(-total // BUCKET_RUNS))
    packed = docs.mapInArrow(_second_pass(shingle, min_words, threshold, shared, heavy, buckets), "bucket int, class int, blob binary")
    logging.getLogger(__name__).info("sets of %s runs or more scan lists; %s of %s records, %s buckets", heavy, sum(n for size, n in sizes.items() if size >= heavy), sum(sizes.values()), buckets)
    # A task for each bucket: the number is given, so that small ones are not put together again.
    compare = _candidates(threshold, heavy)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        for _, part in pd.concat(held).groupby("bucket") if held else ():
            yield compare(part)

    candidates = settle(packed.repartitionById(buckets, "bucket").mapInPandas(run, "key_a bigint, key_b bigint").distinct())
    return NearDuplicates(members.select("id", "key"), settle(_verified(docs, members, candidates, shingle, min_words, threshold)))


def _verified(docs: DataFrame, members: DataFrame, candidates: DataFrame, shingle: int, min_words: int, threshold: float) -> DataFrame:
    ends = candidates.select(F.col("key_a").alias("key")).unionByName(candidates.select(F.col("key_b").alias("key"))).distinct()
    chosen = settle(members.join(ends, "key").groupBy("key").agg(F.min("id").alias("id")))
    few = chosen.count() <= BROADCAST_IDS
    ids = chosen.select("id").distinct()
    texts = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle, min_words)
        for b in batches:
            keys, blobs = [], []
            for t in b.column(1).to_pylist():
                w = shingler.words(t) if t is not None else None
                if w is not None:
                    keys.append(_key(w))
                    blobs.append(np.unique(shingler.runs([w])[1]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["key", "runs"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            common, union = [], []
            for x, y in zip(pdf["runs_a"], pdf["runs_b"], strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                n = len(np.intersect1d(a, b, assume_unique=True))
                common.append(n)
                union.append(len(a) + len(b) - n)
            out = pdf[["key_a", "key_b"]].assign(common=common, similarity=np.array(common, float) / np.maximum(np.array(union, float), 1))
            out = out[np.array(common) >= threshold * np.array(union) - 1e-9]
            if len(out):
                yield out

    # Equal ids may carry other texts: the key decides, and one row per key remains.
    runs = settle(texts.mapInArrow(sets, "key bigint, runs binary").join(F.broadcast(chosen.select("key")) if few else chosen.select("key"), "key", "left_semi").dropDuplicates(["key"]))
    joined = candidates.join(runs.select(F.col("key").alias("key_a"), F.col("runs").alias("runs_a")), "key_a").join(runs.select(F.col("key").alias("key_b"), F.col("runs").alias("runs_b")), "key_b")
    return joined.mapInPandas(compare, "key_a bigint, key_b bigint, common bigint, similarity double")


def found(chapters: DataFrame) -> DataFrame:
    """Pairs of chapters of at least 20 words that share 0.6 of their runs of three words."""
    return near_duplicates(chapters, "chapter_id", "text", 3, 0.6, 20).pairs().select(F.col("id_a").alias("chapter_id_a"), F.col("id_b").alias("chapter_id_b"))
