"""Noise in text from scanned pages (problem 4).

Word counts of the whole corpus give the frequent words; skip-gram vectors of all of them are learned
from the co-occurrence counts of the whole corpus. A rare word is linked to frequent
words that plausible glyph edits lead to; where it stands, the vectors rank these words by its context,
and the best is taken if it fits as well as words that stand where they belong do. How well that is, is
learned: the counted pairs tell the scores of words in their own contexts, the product of their shares
those in contexts of others, and the threshold parts the two best. Vectors that cannot part them correct
nothing. A frequent word is itself a misreading when a far more frequent word at one glyph edit has
nearly the same vector. Then furniture (running headers, page numbers) goes, words cut at line ends
are joined, and lines are reflowed into paragraphs.

Scale: counts are taken per task and summed; only words above a share of the corpus are collected,
so there are at most 1 / ``MIN_SHARE`` of them. Only pairs that occur are counted and sent; the driver
holds two cells of 12 bytes for each while it learns (a few times that while it sorts them), and its work
grows with the square of the dictionary. Texts are repaired one by one where they lie.

Edge cases: null and blank texts stay as they are and have no noise; a null ``chapter`` names no
header; very long texts are read whole; without frequent words nothing is corrected.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthika.session import settle

MIN_COUNT = 4
MIN_SHARE = 2e-6
DIMENSIONS = 24
WINDOW = 2
SLICES = 32
#: A task hands on its pairs when it holds so many; vectors are learned in blocks of so many cells.
HELD_PAIRS = 4_000_000
BLOCK_CELLS = 4_000_000
#: A frequent word is taken for a misreading of another only where that one is so many times as frequent.
RATIO = 20
MIN_COSINE = 0.55
#: Under so many occurrences a vector is unsure: there a word 5 * RATIO as frequent is taken without likeness, too.
FEW = 20
#: Vectors must tell this share more of the words in their own contexts than in others' to correct anything.
MIN_TOLD = 0.5
#: Lines at either end that are looked at and are no furniture.
EDGE_LINES = 3
#: Tasks whose counts are summed before those sums are.
GROUP_TASKS = 64
MIN_GLYPHS = 3

# What is seen, and what may have been printed.
SIGN_EDITS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("9", "g"), ("4", "a"), ("7", "t"), ("8", "b"), ("3", "e"), ("!", "i"), ("!", "l"),
    ("@", "a"), ("+", "t"), ("$", "s"), ("|", "l"), ("|", "i"), ("|", "।"), ("€", "e"), ("£", "e"), ("¢", "c"), ("(", "c"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("�", ""),
)
LETTER_EDITS = (
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("c", "e"), ("b", "h"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("l", "i"), ("i", "l"), ("li", "h"), ("h", "li"), ("m", "rn"), ("d", "cl"), ("e", "c"), ("h", "b"), ("nn", "m"), ("u", "ii"), ("I", "l"),
    ("ी", "ि"), ("भ", "म"), ("म", "भ"), ("व", "ब"), ("ब", "व"), ("रव", "ख"), ("ख", "रव"), ("प", "ष"), ("ष", "प"), ("ध", "घ"), ("घ", "ध"), ("य", "थ"), ("थ", "य"), ("ड", "ड़"), ("ढ", "ढ़"), ("ड", "ङ"), ("ठ", "ट"), ("ट", "ठ"), ("ि", "ी"), ("न", "त"), ("त", "न"),
    ("ব", "র"), ("র", "ব"), ("য", "ষ"), ("ষ", "য"), ("ড", "ড়"), ("য", "য়"), ("ঘ", "ষ"), ("ন", "ণ"), ("ி", "ீ"), ("ீ", "ி"), ("ன", "ண"), ("ள", "ன"), ("ர", "ா"), ("ா", "ர"),
)
_OUTER = ".,;:?\"'()[]।॥“”‘’…"
_ALL_OUTER = _OUTER + "!|-–—‐~*"
_CUTS = "-‐‑¬\xad–"
_INNER_SIGN = re.compile(r"[^\W\d_][@!+$|¦�^~<>={}\\€£¢0-9]+[^\W\d_]|^[@+$�|!][^\W\d_]{2,}|^[0-9][a-z]{2,}$|[^\W\d_]{2,}[@+$�0-9]$")
_ORDINAL = re.compile(r"^\d+(?:st|nd|rd|th|e|er|ml|cm|mm|kg|km|m|g|l|s|h|v|w|a|k|c)$")


def bare(token: str) -> str:
    """A word without outer signs, lower-cased."""
    return token.strip(_ALL_OUTER).lower()


def _has_letter(w: str) -> bool:
    return any(c.isalpha() for c in w)


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """``word``, ``n`` over all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw: Counter[str] = Counter()

        def flush() -> pd.DataFrame:
            out: Counter[str] = Counter()
            for t, n in raw.items():
                w = bare(t)
                if w and _has_letter(w):
                    out[w] += n
            raw.clear()
            return pd.DataFrame({"word": list(out.keys()), "n": list(out.values())})

        for pdf in batches:
            for t in pdf[text]:
                if t:
                    raw.update(t.split())
            if len(raw) > 500_000:
                yield flush()
        last = flush()
        if len(last):
            yield last

    return docs.select(text).mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> dict[str, int]:
    """Words whose count is at least ``MIN_COUNT`` and ``MIN_SHARE`` of all: a bounded dictionary."""
    counts = settle(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r.word: r.n for r in counts.where(F.col("n") >= max(MIN_COUNT, MIN_SHARE * total)).collect()}


def _sum_pairs(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct cells of all parts, with the sums of their counts."""
    cells, n = (np.concatenate([x[i] for x in parts]) for i in range(2))
    order = np.argsort(cells, kind="stable")
    cells, n = cells[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, int)
    return cells[first], np.add.reduceat(n, first) if len(first) else n


def _packed(cells: np.ndarray, n: np.ndarray) -> bytes:
    return zlib.compress(np.stack([np.diff(cells, prepend=0), n]).astype(np.int64).tobytes(), 1)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, n = np.frombuffer(zlib.decompress(blob), np.int64).reshape(2, -1)
    return np.cumsum(steps), n


class Pairs:
    """A symmetric table of pair counts, by rows; only cells that are not zero are held."""

    def __init__(self, size: int, row: np.ndarray, column: np.ndarray, n: np.ndarray):
        order = np.argsort(row, kind="stable")
        self.size, self.column, self.n = size, column[order].astype(np.int32), n[order].astype(np.float32)
        self.starts = np.searchsorted(row[order], np.arange(size + 1))

    @classmethod
    def of(cls, counts: np.ndarray) -> Pairs:
        row, column = np.nonzero(counts)
        return cls(len(counts), row, column, counts[row, column])

    def block(self, lo: int, hi: int, values: np.ndarray) -> np.ndarray:
        """Rows ``lo`` to ``hi`` with all their cells, filled from ``values``, one for each held cell."""
        out = np.zeros((hi - lo, self.size), np.float32)
        part = slice(self.starts[lo], self.starts[hi])
        out[np.repeat(np.arange(hi - lo), np.diff(self.starts[lo : hi + 1])), self.column[part]] = values[part]
        return out


def co_occurrence(docs: DataFrame, text: str, vocabulary: list[str]) -> Pairs:
    """Counts of pairs of the vocabulary within ``WINDOW`` words, in either order, over all texts."""
    v = len(vocabulary)
    if not v:
        return Pairs.of(np.zeros((0, 0), np.float32))
    numbers = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = numbers.value
        known: dict[str, int] = {}
        held: list[int] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def add() -> None:
            ids = np.array(held, np.int64)
            held.clear()
            for off in range(1, WINDOW + 1):
                a, b = ids[:-off], ids[off:]
                # A text ends with WINDOW marks of -1, which keep it apart from the next.
                ok = (a >= 0) & (b >= 0)
                a, b = a[ok], b[ok]
                parts.append(np.unique(np.minimum(a, b) * v + np.maximum(a, b), return_counts=True))

        def flush() -> Iterator[pd.DataFrame]:
            cells, n = _sum_pairs(parts)
            parts.clear()
            for s in range(SLICES):
                mine = cells // v % SLICES == s
                if mine.any():
                    yield pd.DataFrame({"slice": [s], "part": [TaskContext.get().partitionId() // GROUP_TASKS], "counts": [_packed(cells[mine], n[mine])]})

        for pdf in batches:
            for t in pdf[text]:
                if not t:
                    continue
                words = t.split()
                try:
                    held += [known[w] for w in words]
                except KeyError:
                    if len(known) > 500_000:
                        known.clear()
                    for w in words:
                        if w not in known:
                            known[w] = index.get(bare(w), -1)
                    held += [known[w] for w in words]
                held += [-1] * WINDOW
            if len(held) > 1_000_000:
                add()
                if sum(len(x) for x, _ in parts) > HELD_PAIRS:
                    parts[:] = [_sum_pairs(parts)]
                    if len(parts[0][0]) > HELD_PAIRS // 2:
                        yield from flush()
        if held:
            add()
        if parts:
            yield from flush()

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for pdf in batches:
            for s, part, blob in zip(pdf["slice"], pdf["part"], pdf["counts"], strict=True):
                mine = parts.setdefault((s, part), [])
                mine.append(_unpacked(blob))
                if len(mine) > 1 and sum(len(x) for x, _ in mine[1:]) > max(HELD_PAIRS, len(mine[0][0])):
                    mine[:] = [_sum_pairs(mine)]
        for (s, _), mine in parts.items():
            cells, n = _sum_pairs(mine)
            for at in range(0, len(cells), HELD_PAIRS):
                yield pd.DataFrame({"slice": [s], "part": [-1], "counts": [_packed(cells[at : at + HELD_PAIRS], n[at : at + HELD_PAIRS])]})

    # Summed by groups of tasks first, so that the last sums take a table from each group and not from each task;
    # written, so that the driver takes one part after the other.
    schema = "slice int, part int, counts binary"
    grouped = docs.select(text).mapInPandas(run, schema).repartition("slice", "part").mapInPandas(add_up, schema)
    rows = settle(grouped.repartition(SLICES, "slice").mapInPandas(add_up, schema))
    parts = [_unpacked(r.counts) for r in rows.toLocalIterator()]
    cells, n = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in parts)]) for i in range(2))
    a, b = np.divmod(cells, v)
    other = a != b
    return Pairs(v, np.concatenate([a, b[other]]), np.concatenate([b, a[other]]), np.concatenate([np.where(other, n, 2 * n), n[other]]))


def skip_gram(counts: Pairs | np.ndarray, negatives: int = 5, rounds: int = 60, rate: float = 0.08, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Word and context vectors: the skip-gram objective with negative sampling, over all counted pairs at once.

    With the pair counts at hand the expectation over negative samples is exact, so each round is a
    full gradient step (Adam).
    """
    c = counts if isinstance(counts, Pairs) else Pairs.of(counts)
    v = c.size
    rng = np.random.default_rng(seed)
    u, w = (rng.normal(0, 0.1, (v, DIMENSIONS)).astype(np.float32) for _ in range(2))
    if not len(c.n):
        return u, w
    p = np.power(np.bincount(c.column, c.n, v), 0.75)
    p = (p / p.sum()).astype(np.float32)
    # Counts are flattened, or the few most frequent words would take all rounds.
    flat = np.power(c.n, 0.6).astype(np.float32)
    n = np.bincount(np.repeat(np.arange(v), np.diff(c.starts)), flat, v).astype(np.float32)[:, None]
    norm = (n + negatives * n).clip(1e-6)
    state = [np.zeros_like(u), np.zeros_like(u), np.zeros_like(w), np.zeros_like(w)]
    step = max(1, BLOCK_CELLS // v)
    for t in range(1, rounds + 1):
        grad_u, grad_w = np.zeros_like(u), np.zeros_like(w)
        for lo in range(0, v, step):
            part = slice(lo, min(v, lo + step))
            block = c.block(lo, part.stop, flat)
            s = 1 / (1 + np.exp(-np.clip(u[part] @ w.T, -15, 15)))
            g = (block * (1 - s) - negatives * n[part] * p[None, :] * s) / norm[part]
            grad_u[part] = g @ w
            grad_w += g.T @ u[part]
        for x, grad, (i, j) in ((u, grad_u, (0, 1)), (w, grad_w, (2, 3))):
            state[i] = 0.9 * state[i] + 0.1 * grad
            state[j] = 0.99 * state[j] + 0.01 * grad * grad
            x += rate * (state[i] / (1 - 0.9**t)) / (np.sqrt(state[j] / (1 - 0.99**t)) + 1e-8)
    return u, w


def _below(t: np.ndarray, mean: np.ndarray, spread: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Share of a mixture of normal distributions (logistic curves come close) that lies under each ``t``."""
    z = (t[:, None] - mean[None, :]) / (spread[None, :] + 1e-6)
    return (1 / (1 + np.exp(-np.clip(1.702 * z, -40, 40)))) @ weight


def learn_threshold(counts: Pairs, u: np.ndarray, w: np.ndarray) -> float:
    """The score of a word in a context of 2 * ``WINDOW`` words that best parts its own contexts from those of others.

    Infinite where the vectors part less than ``MIN_TOLD`` of them.
    """
    v = counts.size
    if not len(counts.n):
        return np.inf
    p = np.bincount(counts.column, counts.n, v)
    p = (p / p.sum()).astype(np.float32)
    own, other = np.zeros((2, v)), np.zeros((2, v))
    step = max(1, BLOCK_CELLS // v)
    for lo in range(0, v, step):
        hi = min(v, lo + step)
        s = u[lo:hi] @ w.T
        block = counts.block(lo, hi, counts.n)
        n = block.sum(1).clip(1e-9)
        own[0, lo:hi], own[1, lo:hi] = (block * s).sum(1) / n, (block * s * s).sum(1) / n
        other[0, lo:hi], other[1, lo:hi] = s @ p, (s * s) @ p
    spread = [np.sqrt(np.maximum(x[1] - x[0] ** 2, 0) / (2 * WINDOW)) for x in (own, other)]
    grid = np.linspace(min(own[0].min(), other[0].min()), max(own[0].max(), other[0].max()), 400)
    told = _below(grid, other[0], spread[1], p) - _below(grid, own[0], spread[0], p)
    best = int(np.argmax(told))
    return float(grid[best]) if told[best] >= MIN_TOLD else np.inf


def edits(w: str, table: tuple[tuple[str, str], ...]) -> Iterator[str]:
    """Words that one edit of the table leads to."""
    for seen, printed in table:
        at = w.find(seen)
        while at >= 0:
            yield w[:at] + printed + w[at + len(seen) :]
            at = w.find(seen, at + 1)


class Speller:
    """Judges words: fine, misread (with its correction), or to be decided by context."""

    FINE, MISREAD, ASK, UNKNOWN = range(4)

    def __init__(self, words: dict[str, int], vocabulary: list[str], u: np.ndarray, w: np.ndarray, least: float, false_words: dict[str, str] | None = None):
        self.words, self.index, self.u, self.w, self.least = words, {x: i for i, x in enumerate(vocabulary)}, u, w, least
        self.false_words = {} if false_words is None else false_words
        self.known: dict[str, tuple[int, list[str]]] = {}
        self.doubt: dict[str, int] = {}
        self.furniture: dict[str | None, Furniture] = {}

    def forget(self, most: int = 400_000) -> None:
        """Drop what was judged when it has grown large."""
        if len(self.known) > most:
            self.known.clear()
            self.doubt.clear()
        if len(self.furniture) > 10_000:
            self.furniture.clear()

    def candidates(self, w: str, signs_only: bool) -> list[str]:
        """Frequent words that glyph edits of ``w`` lead to, the most frequent first."""
        n = self.words.get(w, 0)
        first = set(edits(w, SIGN_EDITS)) if signs_only else set(edits(w, LETTER_EDITS))
        found = {x for x in first if self.words.get(x.strip(_ALL_OUTER), 0) >= max(MIN_COUNT, RATIO * n)}
        if not found and signs_only:
            for x in first:
                found |= {y for y in [*edits(x, SIGN_EDITS), *edits(x, LETTER_EDITS)] if self.words.get(y.strip(_ALL_OUTER), 0) >= max(MIN_COUNT, RATIO * n)}
        return sorted({x.strip(_ALL_OUTER) for x in found} - {w} - set(self.false_words), key=lambda x: (-self.words[x], x))

    def learn_false_words(self) -> None:
        """Frequent words that are misreadings of far more frequent ones with nearly the same vector."""
        length = np.linalg.norm(self.u, axis=1) + 1e-9
        out = {}
        for w in self.words:
            if _INNER_SIGN.search(w):
                c = self.candidates(w, True)
                if c and not _ORDINAL.match(w):
                    out[w] = c[0]
                continue
            for c in self.candidates(w, False):
                a, b = self.index[w], self.index[c]
                alike = len(w) > 2 and float(self.u[a] @ self.u[b]) / (length[a] * length[b]) >= MIN_COSINE
                if alike or (len(w) > 3 and self.words[w] < FEW and self.words[c] >= 5 * RATIO * self.words[w]):
                    out[w] = c
                    break
        self.false_words = out

    def all_fine(self, words: list[str]) -> bool:
        try:
            return not any([self.doubt[w] for w in words])
        except KeyError:
            for w in words:
                self.judge(w)
            return not any([self.doubt[w] for w in words])

    def judge(self, token: str) -> tuple[int, list[str]]:
        got = self.known.get(token)
        if got is None:
            got = self.known[token] = self._judge(token)
            self.doubt[token] = got[0]
        return got

    def _judge(self, token: str) -> tuple[int, list[str]]:
        w = bare(token)
        if not w or not _has_letter(w):
            return self.FINE, []
        if w in self.false_words:
            return self.MISREAD, [self.false_words[w]]
        t = token.strip(_OUTER).lower()
        if w in self.words:
            # A mark of a sentence's end read as another sign.
            if token[-1:] == "|" and not w.isascii():
                return self.MISREAD, [w]
            return self.FINE, []
        if _ORDINAL.match(w):
            return self.FINE, []
        sign = bool(_INNER_SIGN.search(t))
        if sign or t != w:
            c = self.candidates(t, True)
            if c:
                return self.MISREAD, c
            if sign:
                return (self.MISREAD if any(not x.isalnum() and x not in "-'’" for x in w) and sum(x.isalpha() for x in w) >= 2 else self.UNKNOWN), []
        if "-" in w and all(x in self.words for x in w.split("-") if x):
            return self.FINE, []
        c = self.candidates(w, False) if len(w) > 2 else []
        return (self.ASK, c) if c else (self.UNKNOWN, [])

    def best(self, candidates: list[str], context: list[str]) -> tuple[str, bool]:
        """The candidate that fits the context best, the more frequent of equals, and whether it fits well enough."""
        at = [self.index[x] for x in context if x in self.index and x not in self.false_words]
        if not at:
            return candidates[0], False
        scores = (self.u[[self.index[x] for x in candidates]] @ self.w[at].T).mean(1)
        i = int(np.argmax(scores))
        return candidates[i], bool(scores[i] > self.least)


# Words beside a printed page number.
_PAGE_WORDS = r"(?:page|pages|pg|p|pag|पृष्ठ|पृ|पान|पेज|পৃষ্ঠা|পাতা|பக்கம்|ப)"
_DIGITS_SEEN = str.maketrans({"l": "1", "I": "1", "|": "1", "!": "1", "o": "0", "O": "0", "S": "5", "s": "5", "B": "8", "i": "1", "b": "6", "g": "9", "z": "2", "Z": "2"})
_NUMBER = r"[0-9०-९০-৯௦-௯]{1,4}"
_ALONE = re.compile(rf"^[\W_]*(?:{_PAGE_WORDS}[\s.:]*)?{_NUMBER}(?:\s*(?:/|of|de)\s*{_NUMBER})?[\W_]*$", re.I)
_NUMERAL = re.compile(r"^[\W_]*[ivxlc]{1,7}[\W_]*$", re.I)
_ROMAN = re.compile(r"^m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
_DECIMAL = re.compile(r"\d[.,]\d|%")
_FOLD = str.maketrans({"0": "o", "1": "l", "5": "s", "6": "b", "9": "g", "4": "a", "7": "t", "8": "b", "3": "e", "!": "i", "@": "a", "+": "t", "$": "s", "|": "l"})
_PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("ी", "ि"), ("भ", "म"), ("ब", "व"), ("रव", "ख"), ("ष", "प"), ("ध", "घ"), ("थ", "य"), ("़", ""), ("b", "h"), ("c", "e"), ("i", "l"))


_NOT_NAME = re.compile(r"[^a-zà-öø-ÿœऀ-෿]+")


def fold(s: str) -> str:
    """Letters only, with signs and letters that are easily misread for each other made equal."""
    s = s.lower().translate(_FOLD)
    for a, b in _PAIRS:
        s = s.replace(a, b)
    return _NOT_NAME.sub("", s)


def chapter_name(chapter: str | None) -> str:
    """The name in a chapter's title, without its word and number."""
    if not chapter:
        return ""
    return re.split(r"\s[—–-]\s", chapter, maxsplit=1)[-1].strip()


def _is_page_number(line: str) -> bool:
    s = line.strip()
    if not s or len(s) > 24 or _DECIMAL.search(s):
        return False
    if _ALONE.match(s):
        return True
    core = re.sub(r"^[\W_]+|[\W_]+$", "", s)
    if _NUMERAL.match(s) and _ROMAN.match(core.lower()) and (core.islower() or core.isupper()):
        return True
    m = re.match(rf"^({_PAGE_WORDS}[\s.:]+)?(\S{{1,4}})$", core, re.I)
    return bool(m and any(c.isdigit() for c in m[2]) and m[2].translate(_DIGITS_SEEN).isdigit())


class Furniture:
    """Finds a chapter's running header and page number among the lines at top and bottom."""

    def __init__(self, chapter: str | None):
        self.name = fold(chapter_name(chapter))
        self.whole = fold(chapter or "")
        self.longest = len(chapter or "") + 60
        self.grams = {self.name[i : i + 3] for i in range(len(self.name) - 2)}

    def of(self, line: str) -> tuple[bool, bool]:
        """(header, page number) of one line."""
        if _is_page_number(line):
            return False, True
        s = line.strip()
        # Blanks don't count for the length, as headers may be letterspaced.
        if len(self.name) < 2 or not s or (len(s) > self.longest and len(s) - s.count(" ") > self.longest) or s[-1] in ".?!।,":
            return False, False
        f = fold(s)
        if len(f) > len(self.whole) + 40 or len(f) < 0.7 * len(self.name):
            return False, False
        held = self.name in f
        if not held and len(self.name) >= 6:
            # Slightly misread: most of the name stands in the line in order.
            if sum([g in f for g in self.grams]) < 0.4 * len(self.grams):
                return False, False
            match = SequenceMatcher(None, self.name, f, autojunk=False)
            same = sum(b.size for b in match.get_matching_blocks())
            held = same >= 0.85 * len(self.name) and len(f) <= len(self.whole) + 30
        if not held or len(self.name) < 0.3 * len(f):
            return False, False
        first, last = re.split(r"\s+", s)[0].strip("|[]()~-–—"), re.split(r"\s+", s)[-1].strip("|[]()~-–—")
        number = any(x and any(c.isdigit() for c in x) and x.translate(_DIGITS_SEEN).isdigit() for x in (first, last)) or bool(re.search(rf"(?:^|[\s|]){_PAGE_WORDS}[\s.:]+{_NUMBER}\s*$", s, re.I)) or any(_ROMAN.match(x) and x for x in (first, last) if x and x.islower())
        return True, number


def repair(text: str, chapter: str | None, speller: Speller) -> tuple[str, list[str], int]:
    """The text as paragraphs, the kinds of noise found in it, and how many words were misread."""
    lines = text.split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip()]
    kinds: set[str] = set()
    drop: set[int] = set()
    if len(filled) > 1:
        furniture = speller.furniture.get(chapter)
        if furniture is None:
            furniture = speller.furniture[chapter] = Furniture(chapter)
        for order in (filled, filled[::-1]):
            plain = 0
            for i in order:
                header, number = furniture.of(lines[i])
                if header or number:
                    drop.add(i)
                elif (plain := plain + 1) == EDGE_LINES:
                    break
                if header:
                    kinds.add("header")
                if number:
                    kinds.add("pageno")
    body = [lines[i] if i not in drop else None for i in range(len(lines))]
    body = [x for x in body if x is not None]
    # Words cut at line ends.
    joined: list[list[str]] = []
    blank = True
    carry = False
    misread = 0
    for k, line in enumerate(body):
        words = line.split()
        if not words:
            blank, carry = True, False
            continue
        if carry and joined and joined[-1]:
            left = joined[-1].pop()
            head, right = left[:-1], words[0]
            whole, compound = bare(head + right), bare(left[:-1] + "-" + right)
            cut = True
            if left[-1] in "-–" and whole not in speller.words:
                parts = bare(head) in speller.words and bare(right) in speller.words
                cut = compound not in speller.words and not (parts and speller.judge(whole)[0] >= Speller.ASK and len(bare(head)) > 2 and len(bare(right)) > 2)
            if cut:
                kinds.add("hyphen")
            joined[-1].append(head + right if cut else head + "-" + right)
            words = words[1:]
            joined[-1] += words
        elif blank or not joined:
            joined.append(words)
        else:
            joined[-1] += words
        blank = False
        last = joined[-1][-1] if joined[-1] else ""
        after = body[k + 1].split() if k + 1 < len(body) else []
        carry = len(last) > 1 and last[-1] in _CUTS and last[-2].isalpha() | ("ऀ" <= last[-2] <= "෿") and bool(after) and (after[0][0].isalpha() and not after[0][0].isupper() or "ऀ" <= after[0][0] <= "෿" or after[0][0] in "@!+$015")
    out = []
    for words in joined:
        if speller.all_fine(words):
            out.append(" ".join(words))
            continue
        k = 0
        fixed: list[str] = []
        while k < len(words):
            t = words[k]
            verdict, candidates = speller.judge(t)
            if verdict == Speller.FINE:
                # A stray blank inside a word: its halves are rare or no words, together they are one.
                fixed.append(t)
                k += 1
                continue
            near = None
            if verdict in (Speller.UNKNOWN, Speller.ASK):
                for a, b in ((k - 1, k), (k, k + 1)):
                    if 0 <= a and b < len(words) and bare(words[a] + words[b]) in speller.words and words[a][-1:] not in ".,;:?!।" and speller.words.get(bare(words[a] + words[b]), 0) >= MIN_COUNT and (bare(words[a]) + bare(words[b])).isalpha():
                        near = (a, b)
                        break
            if near == (k - 1, k) and fixed:
                fixed[-1] = fixed[-1] + t
                misread += 1
            elif near == (k, k + 1):
                fixed.append(t + words[k + 1])
                misread += 1
                k += 1
            elif verdict in (Speller.MISREAD, Speller.ASK):
                # A sign inside a word is a misreading whatever it stands for; letters are one only where another word fits.
                better, fits = speller.best(candidates, [bare(x) for x in fixed[-WINDOW:] + words[k + 1 : k + 1 + WINDOW]]) if candidates else ("", False)
                taken = verdict == Speller.MISREAD or fits
                misread += taken
                fixed.append(_as_printed(t, better) if taken and better else t)
            else:
                fixed.append(t)
            k += 1
        out.append(" ".join(fixed))
    if misread >= MIN_GLYPHS:
        kinds.add("glyph")
    return "\n\n".join(out), sorted(kinds), misread


def _as_printed(token: str, better: str) -> str:
    """The correction with the outer signs and the capital of what was read."""
    t = token.lstrip(_OUTER)
    head = token[: len(token) - len(t)]
    core = t.rstrip(_OUTER)
    tail = t[len(core) :]
    if core.endswith("|") and not better.isascii():
        tail = "।" + tail
    return head + (better.upper() if core.isupper() and len(core) > 1 else better[:1].upper() + better[1:] if core[:1].isupper() else better) + tail


def fit_speller(docs: DataFrame, text: str) -> Speller:
    """Dictionary and vectors of a corpus."""
    words = frequent_words(count_words(docs, text))
    vocabulary = sorted(words, key=lambda w: (-words[w], w))
    pairs = co_occurrence(docs, text, vocabulary)
    u, w = skip_gram(pairs)
    speller = Speller(words, vocabulary, u, w, learn_threshold(pairs, u, w))
    speller.learn_false_words()
    return speller


def repaired(docs: DataFrame, text: str = "own_text", with_text: bool = True) -> DataFrame:
    """``chapter_id``, ``repaired``, ``noise`` (kinds), ``misread`` (words) of chapters with ``chapter`` and ``text``.

    Without ``with_text`` the repaired texts stay where they were made.
    """
    speller = fit_speller(docs, text)
    parts = docs.sparkSession.sparkContext.broadcast((speller.words, list(speller.index), speller.u, speller.w, speller.least, speller.false_words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Speller(*parts.value)
        for pdf in batches:
            if not len(pdf):
                continue
            own.forget()
            rows = [repair(t, c if isinstance(c, str) else None, own) if isinstance(t, str) and t.strip() else (t if isinstance(t, str) else None, [], 0) for t, c in zip(pdf[text], pdf["chapter"], strict=True)]
            yield pd.DataFrame({"chapter_id": pdf["chapter_id"], "repaired": [r[0] if with_text else None for r in rows], "noise": [r[1] for r in rows], "misread": [r[2] for r in rows]})

    return docs.select("chapter_id", "chapter", text).mapInPandas(run, "chapter_id bigint, repaired string, noise array<string>, misread bigint")


def found(prepared: DataFrame, types: DataFrame) -> DataFrame:
    """Kinds of noise of every chapter that is prose; ``types`` are those of problem 5."""
    noisy = repaired(prepared, with_text=False).where(F.size("noise") > 0).select("chapter_id", F.explode("noise").alias("noise"))
    return noisy.join(types.where("kind <> 'prose'").select("chapter_id"), "chapter_id", "left_anti")
