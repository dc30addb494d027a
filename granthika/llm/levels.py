"""Reading level of each document (problem 9).

A linear ranker learns from all pairs of graded documents of different level which is harder, from syntax
(sentence length, commas, subordination) and vocabulary (word length, syllables, derived endings,
and the level at which the samples use a word). Isotonic regression turns its scores into levels.
A document's score is the word-weighted median over its sentences, so a stray sentence, a heading or
a few lines of figures do not move it.

The model is fitted on the fixed table of samples, at most ``MOST_SAMPLES`` rows; documents are
scored one by one where they lie, without a shuffle. The language of a document without a label is read
by the network of problem 2.

Edge cases: null, blank and non-English texts and those under ``MIN_WORDS`` words have no level and
no row in ``found``; a text without sentence marks is one sentence, its length is capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from granthika.llm import languages

MIN_WORDS = 40
MOST_SAMPLES = 5_000
FOLDS = 5

_STRIP = ".,;:!?\"'()[]“”‘’—–-"
_VOWELS = re.compile(r"[aeiouy]+")
_DERIVED = re.compile(r"(?:tion|sion|ity|ism|ical|ence|ance|ment|ness|ive|ous|ised|ized|isation|ization|ology|logical|ually|ly)s?$")
_SUBORDINATE = frozenset("although because whenever whereas whether which that while unless until since though if when whose insofar thereby provided so nevertheless".split())
#: Per word: letters, 7 or more, 10 or more, syllables, derived, subordinating, comma, level in the samples, that level above
#: each boundary of the scale, counted.
_BOUNDARIES = (1.5, 2.5, 3.5)
_FIGURES = 12
#: Pairs are gone through in blocks of about so many.
BLOCK_PAIRS = 1_000_000
N_FEATURES = _FIGURES + 1


def word_levels(samples: list[tuple[int, str]], weight: float = 2.0) -> dict[str, float]:
    """Mean level of the samples in which a word stands, drawn towards the mean of all by ``weight``."""
    mean = float(np.mean([lv for lv, _ in samples])) if samples else 2.5
    got: dict[str, list[float]] = {}
    for lv, text in samples:
        for w in {x.strip(_STRIP).lower() for x in text.split()}:
            s = got.setdefault(w, [0.0, 0.0])
            s[0] += lv
            s[1] += 1
    return {w: (s + weight * mean) / (n + weight) for w, (s, n) in got.items()}


class Reader:
    """Features of texts; every distinct word is judged once and kept in a table."""

    def __init__(self, levels: dict[str, float], most: int = 300_000):
        self.levels, self.most = levels, most
        self.mean = float(np.mean(list(levels.values()))) if levels else 2.5
        self.known: dict[str, int] = {}
        self.figures = np.zeros((1024, _FIGURES))
        self.stops = np.zeros(1024, bool)

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > self.most:
            self.known.clear()
        for w in words:
            if w in self.known:
                continue
            k = len(self.known)
            if k == len(self.figures):
                self.figures = np.concatenate([self.figures, np.zeros_like(self.figures)])
                self.stops = np.concatenate([self.stops, np.zeros_like(self.stops)])
            bare = w.strip(_STRIP).lower()
            self.stops[k] = w.rstrip("\"'”’)]")[-1:] in (".", "!", "?")
            if bare.isalpha() or (bare and bare.replace("-", "").replace("'", "").isalpha()):
                n = len(bare)
                lv = self.levels.get(bare, self.mean + 0.08 * (n - 5))
                self.figures[k] = (n, n >= 7, n >= 10, max(1, len(_VOWELS.findall(bare))), bool(_DERIVED.search(bare)) and n > 5, bare in _SUBORDINATE, w[-1] == ",", lv, *(lv >= b for b in _BOUNDARIES), 1)
            else:
                self.figures[k] = 0
            self.known[w] = k

    def sentences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Features of each sentence, and its words as weight; figures and signs don't count as words."""
        words = text.split()
        if not words:
            return np.zeros((0, N_FEATURES)), np.zeros(0)
        try:
            ids = [self.known[w] for w in words]
        except KeyError:
            self._learn(words)
            ids = [self.known[w] for w in words]
        starts = np.concatenate([[0], np.flatnonzero(self.stops[ids])[:] + 1])
        starts = starts[starts < len(words)]
        sums = np.add.reduceat(self.figures[ids], starts, axis=0)
        n = sums[:, -1]
        sums, n = sums[n > 0], n[n > 0]
        return np.concatenate([sums[:, :-1] / n[:, None], np.minimum(n, 40)[:, None] / 40, np.log1p(np.minimum(n, 40))[:, None]], 1), n


def _weighted_median(x: np.ndarray, w: np.ndarray) -> float:
    o = np.argsort(x)
    c = np.cumsum(w[o])
    return float(x[o][np.searchsorted(c, c[-1] / 2)])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: block means of y, not decreasing in x; (right ends, values)."""
    o = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi in zip(x[o], y[o], strict=True):
        blocks.append([xi, yi, 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            e, m, n = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[2] = e, (b[1] * b[2] + m * n) / (b[2] + n), b[2] + n
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def rank(z: np.ndarray, of: np.ndarray, rounds: int, rate: float, ridge: float) -> np.ndarray:
    """Weights of the logistic ranker over all pairs of rows of ``z`` whose levels ``of`` differ."""
    w = np.zeros(z.shape[1])
    pairs = [(z[of == v], z[of < v]) for v in np.unique(of)[1:]]
    count = sum(len(hard) * len(easy) for hard, easy in pairs)
    for _ in range(rounds if count else 0):
        grad = np.zeros_like(w)
        for hard, easy in pairs:
            low = easy @ w
            step = max(1, BLOCK_PAIRS // len(easy))
            for at in range(0, len(hard), step):
                part = hard[at : at + step]
                p = 1 / (1 + np.exp(np.clip((part @ w)[:, None] - low[None, :], -30, 30)))
                grad += p.sum(1) @ part - p.sum(0) @ easy
        w += rate * (grad / count - ridge * w)
    return w


class LevelModel:
    """Ranker and calibration; ``level`` gives a text's level and score."""

    def __init__(self, samples: list[tuple[int, str]], rounds: int = 150, rate: float = 0.5, ridge: float = 1e-3):
        samples = [(int(a), b) for a, b in samples if a is not None and b and b.split()][:MOST_SAMPLES]
        if not samples:
            raise ValueError("no graded samples")
        y = np.array([a for a, _ in samples], float)
        fold = np.arange(len(samples)) % FOLDS
        parts = {}
        for f in range(FOLDS):  # A sample's words get their level from the other folds.
            reader = Reader(word_levels([s for s, k in zip(samples, fold, strict=True) if k != f] or samples))
            for i in np.flatnonzero(fold == f):
                parts[i] = reader.sentences(samples[i][1])
        parts = [parts[i] for i in range(len(samples))]
        features = np.concatenate([f for f, _ in parts])
        self.mean, self.scale = features.mean(0), features.std(0) + 1e-6
        # A document stands in a pair as the word-weighted mean of its sentences.
        whole = np.array([np.average(f, axis=0, weights=n) if len(n) else self.mean for f, n in parts])
        self.weights = rank((whole - self.mean) / self.scale, y, rounds, rate, ridge)
        scores = np.array([self._score(*parts[i]) for i in range(len(samples))])
        ends, values = isotonic(scores, y)
        levels = sorted({int(v) for v in y})
        self.levels = levels
        # A level begins halfway between the last score calibrated below its lower bound and the first above.
        cuts = []
        for lo, hi in zip(levels, levels[1:], strict=False):
            k = int(np.searchsorted(values, (lo + hi) / 2))
            below = ends[k - 1] if k else scores.min()
            above = scores[scores > below].min() if (scores > below).any() else below
            cuts.append((below + above) / 2)
        self.cuts = np.array(cuts)
        self.words = word_levels(samples)

    def _score(self, f: np.ndarray, n: np.ndarray) -> float:
        return _weighted_median(((f - self.mean) / self.scale) @ self.weights, n) if len(n) else 0.0

    def level(self, reader: Reader, text: str) -> tuple[int, float]:
        s = self._score(*reader.sentences(text))
        return self.levels[int(np.searchsorted(self.cuts, s))], s


def fit(level_samples: DataFrame) -> LevelModel:
    rows = level_samples.where("level is not null and text is not null").orderBy("sample_id").limit(MOST_SAMPLES).collect()
    return LevelModel([(r.level, r.text) for r in rows])


def reading_levels(documents: DataFrame, level_samples: DataFrame, lang_samples: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``level``, ``score``, ``n_words`` of every English document of ``min_words`` words or more.

    A label is right where it stands; where none does, the network of problem 2 reads the text.
    """
    model, tagger = fit(level_samples), languages.fit(lang_samples, level_samples)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model.words)
        for pdf in batches:
            if not len(pdf):
                continue
            n = pdf["text"].map(lambda t: len(t.split()))
            pdf, n = pdf[n >= min_words], n[n >= min_words]
            label = pdf["lang"].map(lambda x: x.strip().lower() if isinstance(x, str) else "")
            open_ = (label == "").to_numpy()
            english = (label == "en").to_numpy()
            if open_.any():
                english[open_] = [x == "en" for x in languages.main_languages(tagger, list(pdf["text"][open_]))]
            rows = [(i, *model.level(reader, t), k) for i, t, k in zip(pdf["doc_id"][english], pdf["text"][english], n[english], strict=True)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "level", "score", "n_words"])

    return documents.where("text is not null").select("doc_id", "lang", "text").mapInPandas(run, "doc_id bigint, level bigint, score double, n_words bigint")


def found(documents: DataFrame, level_samples: DataFrame, lang_samples: DataFrame) -> DataFrame:
    return reading_levels(documents, level_samples, lang_samples).select("doc_id", "level")
