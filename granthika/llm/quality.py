"""Per-document text statistics and the text types they imply (problem 5).

One pass computes the statistics of each text (without its site's own lines) and lets a fixed set of
labelling functions, each a threshold on one statistic, vote for a type or abstain. The votes are
noisy labels that contradict each other: how far each function is to be trusted, for each type, is
learned by expectation-maximization from their agreements over all documents, and a document's type
is the most probable one a posteriori.

Only the counts of distinct vote patterns reach the driver. A pattern is one digit per function, so
their number is bounded by the functions, not by the corpus.

Edge cases: null and blank texts have zero statistics and no type (null ``kind``), as have texts
under ``min_words`` words; very long texts are read whole; repeated rows each get their row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthika.llm.sitelines import mark_site_lines
from granthika.session import settle

KINDS = ("prose", "list", "table", "junk")
MIN_WORDS = 10
STATS = (
    "n_words", "n_lines", "mean_word_len", "symbol_share", "digit_share", "common_share", "sentence_end_share", "entry_share", "cell_share", "number_share", "wordlike_share", "odd_script_share", "blank_share", "tail_number_share", "slash_share", "short_line_share", "separator_share", "single_letter_share", "stop_share",
)

_ENTRY = re.compile(r"^\s*(?:[-*•◦▪✓✔·–—‣○●>]\s|\(?(?:\d{1,3}|[a-z]{1,3}|[ivx]{1,5})[.)]\s|\d{1,2}(?:\.\d{1,2})+\s)")
_TAIL = re.compile(r"(?:(?:,\s*\d{1,4})+|\.{4,}\s*\d{1,4}|[…·.\s]{4,}\d{1,4}|\sx\s*\d+)\s*$")
_CELLS = re.compile(r"\t|\||\S {3,}\S")
_NUMERIC = re.compile(r"^[\W_]*\d[\d.,:/%\-]*[\W_]*$|^[-–—]$")
_NUM_LINE = re.compile(r"^\s*(?:-|–|[\d.,%]+)\s*$")
_ENDS = re.compile(r"[.!?।॥…:;][\"'”’)\]]*\s*$")
_WORD = re.compile(r"^\W*(?=\D)(?:\w|[-'’ऀ-෿‌‍])+\W*$")
_CID = re.compile(r"\(cid:\d+\)|�")
_HEX = re.compile(r"^(?=\w*\d)(?=\w*[a-z])[0-9a-z+/=]{12,}$", re.I)
_ODD_MARK = re.compile(r"(?:[àáâãäåÃÂ][\u0080-¿])|(?:[\u0080-\u009f])")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()ऀ-෿‌‍।॥’‘“”-]")
_BLANKS = re.compile(r"_{3,}|\.{6,}|…{2,}")
_VOWEL = re.compile(r"[aeiouyàâäéèêëîïôöùûü]", re.I)
_LATIN = re.compile(r"^[A-Za-z]+$")


#: Properties of a word that the statistics sum: characters, symbols, digits, then flags.
_WORD_FIGURES = 10


def _word_figures(w: str, common: frozenset[str]) -> tuple[int, ...]:
    bare = w.strip(".,;:!?\"'()[]।॥“”‘’").lower()
    if _LATIN.match(bare):
        wordlike = len(bare) <= 22 and (len(bare) < 3 or bool(_VOWEL.search(bare)))
    elif not bare:
        wordlike = False
    elif bare.isascii():
        wordlike = bool(_WORD.match(w)) and len(bare) < 25 and not _HEX.match(bare)
    else:
        wordlike = bool(_WORD.match(w)) and not _ODD_MARK.search(bare)
    odd = 2 * len(_ODD_MARK.findall(w)) + 7 * len(_CID.findall(w)) + (len(bare) if len(bare) >= 12 and _HEX.match(bare) else 0)
    return (len(w), len(_SYMBOL.findall(w)), sum(c.isdigit() for c in w), bare in common, bool(_NUMERIC.match(w)), wordlike, odd, w[-1] in ";,/|" or w in "•·", len(bare) == 1 and bare.isalpha(), w[-1] in ".!?।॥")


class WordTable:
    """Figures of every word met so far, so that each distinct word is judged once; emptied when large."""

    def __init__(self, common: frozenset[str], most: int = 400_000):
        self.common, self.most = common, most
        self.known: dict[str, int] = {}
        self.figures = np.zeros((1024, _WORD_FIGURES), np.int64)

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > self.most:
            self.known.clear()
        for w in words:
            if w not in self.known:
                k = len(self.known)
                if k == len(self.figures):
                    self.figures = np.concatenate([self.figures, np.zeros_like(self.figures)])
                self.figures[k] = _word_figures(w, self.common)
                self.known[w] = k

    def sums(self, words: list[str]) -> np.ndarray:
        try:
            ids = [self.known[w] for w in words]
        except KeyError:
            self._learn(words)
            ids = [self.known[w] for w in words]
        return self.figures[ids].sum(0)


def statistics(text: str, table: WordTable) -> tuple[float, ...]:
    """The figures named in ``STATS`` for one text."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    chars, symbols, digits, hits, numeric, wordlike, odd, seps, letters, stops = map(int, table.sums(words))
    lines = [x for x in text.split("\n") if x.strip()]
    per = max(1, len(lines))
    entry = tail = cell = ends = short = slash = 0
    previous = False
    for x in lines:
        k = x.count(" ") + x.count("\t") + 1
        is_entry, is_tail = bool(_ENTRY.match(x)), x[-1].isdigit() and bool(_TAIL.search(x))
        entry += is_entry
        tail += is_tail
        commas = x.count(", ")
        is_cell = "\t" in x or "|" in x or ("   " in x and bool(_CELLS.search(x.strip()))) or (commas >= 2 and commas + 1 >= k / 2.5 and not is_tail)
        now = k < 4 and bool(_NUM_LINE.match(x))
        cell += is_cell or now or (previous and k <= 3 and not is_entry)
        previous = now
        ends += k > 3 and bool(_ENDS.search(x[-12:]))
        short += k <= 3
        slash += " / " in x
    return (
        float(n), float(len(lines)), chars / n, symbols / chars, digits / chars, hits / n, ends / per, entry / per, cell / per, numeric / n, wordlike / n, odd / chars, (len(_BLANKS.findall(text)) if "___" in text or "......" in text or "……" in text else 0) / per, tail / per, slash / per, short / per, seps / n, letters / n, stops / n,
    )


#: Labelling functions, a threshold on one statistic each: a text votes for the type if ``low <= statistic < high``.
#: They are noisy and contradict each other; how far each is to be trusted is learned.
RULES = (
    ("common_share", 0.22, np.inf, "prose"), ("stop_share", 0.03, 0.35, "prose"), ("sentence_end_share", 0.45, np.inf, "prose"),
    ("entry_share", 0.5, np.inf, "list"), ("tail_number_share", 0.5, np.inf, "list"), ("blank_share", 0.4, np.inf, "list"), ("slash_share", 0.5, np.inf, "list"), ("separator_share", 0.25, np.inf, "list"),
    ("cell_share", 0.5, np.inf, "table"), ("number_share", 0.3, np.inf, "table"),
    ("odd_script_share", 0.2, np.inf, "junk"), ("single_letter_share", 0.7, np.inf, "junk"), ("wordlike_share", 0.0, 0.55, "junk"), ("symbol_share", 0.3, np.inf, "junk"), ("mean_word_len", 18.0, np.inf, "junk"), ("mean_word_len", 0.0, 2.0, "junk"),
)


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """A row per text, a column per labelling function; 0 abstains, 1 + index of the type votes."""
    out = np.zeros((len(s["n_words"]), len(RULES)), np.int8)
    for j, (name, low, high, kind) in enumerate(RULES):
        out[(s[name] >= low) & (s[name] < high), j] = 1 + KINDS.index(kind)
    return out


def vote_patterns(docs: DataFrame, text: str, common: frozenset[str], keep: list[str], stats: tuple[str, ...] = STATS) -> DataFrame:
    """``keep`` columns, the statistics and ``pattern``: the votes as one string of digits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordTable(common)
        for pdf in batches:
            if not len(pdf):
                continue
            rows = np.array([statistics(t or "", words) for t in pdf[text]], float).reshape(len(pdf), len(STATS))
            v = votes({k: rows[:, j] for j, k in enumerate(STATS)})
            out = pdf[keep].copy()
            for k in stats:
                out[k] = rows[:, STATS.index(k)]
            digits = np.ascontiguousarray(v + 48).view(f"S{v.shape[1]}").ravel()
            out["pattern"] = digits.astype(f"U{v.shape[1]}")
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep) + "".join(f", {k} double" for k in stats) + ", pattern string"
    return docs.select(*dict.fromkeys([*keep, text])).mapInPandas(run, schema)


def majority(v: np.ndarray) -> np.ndarray:
    """Shares of the types by a vote in which every function counts alike; equal ones where none votes."""
    q = np.stack([(v == 1 + t).sum(1) for t in range(len(KINDS))], 1) + 1e-3
    return q / q.sum(1, keepdims=True)


def fit_label_model(patterns: list[tuple[str, int]], rounds: int = 200, steady: float = 0.3) -> dict[str, tuple[float, ...]]:
    """Posterior over ``KINDS`` of each vote pattern, by expectation-maximization.

    Each function has a table P(vote | type), each type a prior; both are re-estimated from the
    posteriors until they settle. The first posteriors are sharpened shares of the votes. ``steady``
    counts of a function's votes over all texts are added to its table of every type alike: they steady
    the tables of rare types and say nothing about which type a vote is right for.
    """
    if not patterns:
        return {}
    v = np.array([[int(c) for c in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    k = len(KINDS)
    q = majority(v) ** 2
    q /= q.sum(1, keepdims=True)
    hot = np.stack([v == d for d in range(k + 1)], 2).astype(float)
    over_all = np.einsum("p,pmd->md", n, hot) / n.sum()
    for _ in range(rounds):
        prior = (n @ q + 1) / (n.sum() + k)
        table = np.einsum("p,pt,pmd->tmd", n, q, hot) + steady * over_all + 1e-3
        table /= table.sum(2, keepdims=True)
        score = np.log(prior) + np.einsum("pmd,tmd->pt", hot, np.log(table))
        new = np.exp(score - score.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    q[(v == 0).all(1)] = (n @ q + 1) / (n.sum() + k)  # Without a vote the prior holds.
    return {p: tuple(map(float, x)) for (p, _), x in zip(patterns, q, strict=True)}


def accuracies(patterns: list[tuple[str, int]], model: dict[str, tuple[float, ...]]) -> list[float]:
    """Share of each function's votes that the posteriors hold right; nan for one that never votes."""
    v = np.array([[int(c) for c in p] for p, _ in patterns]).reshape(len(patterns), len(RULES))
    n, q = np.array([c for _, c in patterns], float), np.array([model[p] for p, _ in patterns])
    out = []
    for j, (_, _, _, kind) in enumerate(RULES):
        w = n * (v[:, j] > 0)
        out.append(float((w * q[:, KINDS.index(kind)]).sum() / w.sum()) if w.any() else float("nan"))
    return out


def common_word_set(common_words: DataFrame) -> frozenset[str]:
    """The table of frequent words is a fixed list of a few hundred rows."""
    return frozenset(r.word.lower() for r in common_words.select("word").where("word is not null").distinct().collect())


def text_types(docs: DataFrame, common_words: DataFrame, id_col: str = "chapter_id", text: str = "own_text", min_words: int = MIN_WORDS, extra: tuple[str, ...] = (), stats: tuple[str, ...] = STATS) -> DataFrame:
    """``id_col``, ``extra``, the statistics (those in ``stats``), ``kind`` and its probability ``confidence``."""
    seen = settle(vote_patterns(docs, text, common_word_set(common_words), [id_col, *extra], tuple(dict.fromkeys(["n_words", *stats]))))
    counts = [(r.pattern, r["count"]) for r in seen.where(F.col("n_words") >= min_words).groupBy("pattern").count().collect()]
    model = fit_label_model(sorted(counts))
    rows = [(p, KINDS[int(np.argmax(x))], float(max(x))) for p, x in model.items()]
    kinds = seen.sparkSession.createDataFrame(rows, "pattern string, kind string, confidence double")
    short = F.col("n_words") < min_words
    return seen.join(F.broadcast(kinds), "pattern", "left").withColumn("kind", F.when(~short, F.col("kind"))).withColumn("confidence", F.when(~short, F.col("confidence")))


def chapter_types(chapters: DataFrame, common_words: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """Types of chapters after their site's lines are taken out.

    A chapter whose whole text has ``MIN_WORDS`` words counts, even where the site's lines are most of it.
    """
    marked = mark_site_lines(chapters.select("chapter_id", "content_id", "source", "text")) if marked is None else marked
    return text_types(marked.select("chapter_id", "own_text"), common_words)


def found(chapters: DataFrame, common_words: DataFrame) -> DataFrame:
    marked = mark_site_lines(chapters.select("chapter_id", "content_id", "source", "text")).select("chapter_id", "own_text")
    return text_types(marked, common_words, stats=()).where("kind <> 'prose'").select("chapter_id", "kind")
