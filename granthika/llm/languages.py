"""Language of documents and of their passages (problem 2).

A bidirectional gated recurrent network reads the UTF-8 bytes of a text and gives every position a
probability for each language. It is trained here, in numpy, by backpropagation through time, on
windows cut from the labelled samples, some of which change language midway. A sentence takes the
mean of its positions, a passage is a run of sentences of one language, and a document's confidence
is the mean over its bytes.

Scale: the samples are a fixed table (at most ``MOST_SAMPLES`` rows are read); the network, a few
thousand numbers, goes to the executors with the function. Texts are read whole, in windows of
``WINDOW`` bytes, many windows at a time, without a shuffle.

Edge cases: null and blank texts have no language; a sentence of few words takes its neighbours'
language where it is not certain of its own; very long texts are only more windows; repeated rows
each get their rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = 6
WINDOW = 128
#: Bytes that a step of the network reads.
STRIDE = 2
STEPS = 450
BATCH = 64
MOST_SAMPLES = 5_000
MIN_WORDS = 20
READ_BYTES = 6_000_000
# Labels that name no language.
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "none", "null", "unknown", "undefined", "?", "other")
_ENDS = re.compile(rb"\x0b+|[.!?]+[\"')\]]*\s+|\xe0\xa5\xa4[\"')\]|]*\s*|\|\s+|\n\s*\n")


def clean(text: str) -> bytes:
    """The bytes the network reads: lower-cased, and as many as the text has.

    A line much shorter than the longest ends a sentence (a heading, say): its end becomes a vertical tab.
    """
    if "\n" in text:
        lines = text.split("\n")
        short = 0.6 * max(map(len, lines))
        text = lines[0] + "".join(("\x0b" if len(a) < short else "\n") + b for a, b in zip(lines, lines[1:], strict=False))
    return text.encode("utf-8", "replace").lower()


class ByteTagger:
    """The network: input tables (2 directions, ``STRIDE`` bytes, 3H, 256), recurrent (2, 3H, H), output (languages, 2H).

    A step reads ``STRIDE`` bytes, each through its own table, and labels their positions. The gates'
    rows are held at half scale, as a sigmoid is taken as (1 + tanh(x / 2)) / 2.
    """

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.table = rng.normal(0, 0.2, (2, STRIDE, 3 * hidden, 256)).astype(np.float32)
        self.table[:, :, :hidden] += 0.25  # Gates begin by keeping the state.
        self.u = rng.normal(0, 0.2, (2, 3 * hidden, hidden)).astype(np.float32)
        self.out = rng.normal(0, 0.3, (len(langs), 2 * hidden)).astype(np.float32)
        self.bias = np.zeros((len(langs), 1), np.float32)

    def _cell(self, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step of both directions: new state, and what the gradient needs. z and r are tanh of half their input."""
        k = self.hidden
        q = self.u @ h
        zr = a[:, : 2 * k]
        zr += q[:, : 2 * k]
        np.tanh(zr, out=zr)
        z, r, qn = zr[:, :k], zr[:, k:], q[:, 2 * k :]
        n = r * qn
        n += qn
        n += a[:, 2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += h
        new += n
        new *= 0.5
        return new, z, r, n, qn

    def pair_tables(self) -> np.ndarray:
        """The gates' inputs of every pair of bytes, (2 directions, 3H, 65536)."""
        return np.ascontiguousarray((self.table[:, 0, :, :, None] + self.table[:, 1, :, None, :]).reshape(2, 3 * self.hidden, 65536))

    def probabilities(self, x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """P(language) of every step for pairs of bytes x (steps, B), each 256 * first + second: (steps, languages, B)."""
        t, b = x.shape
        k = self.hidden
        h = np.zeros((2, k, b), np.float32)
        p = np.zeros((t, len(self.langs), b), np.float32)
        a = np.empty((2, 3 * k, b), np.float32)
        out, wf, wb = np.empty((len(self.langs), b), np.float32), self.out[:, :k].copy(), self.out[:, k:].copy()
        for i in range(t):
            np.take(pairs[0], x[i], axis=1, out=a[0], mode="clip")
            np.take(pairs[1], x[t - 1 - i], axis=1, out=a[1], mode="clip")
            h = self._cell(a, h)[0]
            np.matmul(wf, h[0], out=out)
            p[i] += out
            np.matmul(wb, h[1], out=out)
            p[t - 1 - i] += out
        p += self.bias
        np.clip(p, -30, 30, out=p)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over steps of bytes x (steps, STRIDE, B) and labels y (steps, B), and its gradients through time."""
        k, (t, _, b) = self.hidden, x.shape
        inputs = np.stack([sum(self.table[d, s][:, at[:, s]].transpose(1, 0, 2) for s in range(STRIDE)) for d, at in ((0, x), (1, x[::-1]))], 1)
        h = np.zeros((2, k, b), self.table.dtype)
        states, kept = np.empty((t, 2, k, b), self.table.dtype), []
        for i in range(t):
            new, *gates = self._cell(inputs[i].copy(), h)
            kept.append((h, *gates))
            states[i] = h = new
        both = np.concatenate([states[:, 0], states[::-1, 1]], 1)
        logits = self.out @ both + self.bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        hot = np.zeros_like(p)
        np.put_along_axis(hot, y[:, None, :], 1, 1)
        loss = float(-np.log((p * hot).sum(1) + 1e-9).mean())
        d = (p - hot) / (t * b)
        g_out = np.einsum("tlb,thb->lh", d, both)
        g_bias = d.sum((0, 2))[:, None]
        d_both = self.out.T @ d
        d_state = np.stack([d_both[:, :k], d_both[::-1, k:]], 1)
        d_a = np.empty_like(inputs)
        g_u = np.zeros_like(self.u)
        dh = np.zeros_like(h)
        for i in range(t - 1, -1, -1):
            h, z, r, n, qn = kept[i]
            dh = dh + d_state[i]
            dn = 0.5 * dh * (1 - z) * (1 - n * n)
            dz = 0.5 * dh * (h - n) * (1 - z * z)
            dr = dn * qn * (1 - r * r)
            dq = np.concatenate([dz, dr, dn * (1 + r)], 1)
            d_a[i] = np.concatenate([dz, dr, dn], 1)
            g_u += dq @ h.transpose(0, 2, 1)
            dh = 0.5 * dh * (1 + z) + self.u.transpose(0, 2, 1) @ dq
        g_table = np.zeros_like(self.table)
        for s in range(STRIDE):
            for e, at in ((0, x[:, s]), (1, x[::-1, s])):
                flat = at.reshape(-1)
                for j in range(3 * k):
                    g_table[e, s, j] = np.bincount(flat, weights=d_a[:, e, j].reshape(-1), minlength=256)
        return loss, [g_table, g_u, g_out, g_bias]

    def fit(self, samples: list[tuple[str, str]], steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 5) -> ByteTagger:
        """Train on (language, text); windows begin anywhere, and a third of them change language."""
        rng = np.random.default_rng(seed)
        pools = [[clean(t) for g, t in samples if g == lang and t and t.strip()] for lang in self.langs]
        whole = [b" ".join(p) for p in pools]
        sentences = [[s for t in p for s in _cut(t)] for p in pools]
        weights = [self.table, self.u, self.out, self.bias]
        m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        n = len(self.langs)
        for step in range(1, steps + 1):
            x, y = np.full((WINDOW, batch), 32, np.int64), np.zeros((WINDOW, batch), np.int64)
            for j in range(batch):
                a, b = rng.integers(0, n, 2)
                text = whole[a] + b" "
                at = int(rng.integers(0, max(1, len(text) - WINDOW)))
                row = text[at : at + WINDOW]
                y[:, j] = a
                if a != b and rng.random() < 0.45:
                    # A whole sentence of one language and then another: the change is where sentences meet.
                    s = sentences[a][rng.integers(0, len(sentences[a]))][-int(rng.integers(10, WINDOW - 10)) :]
                    o = sentences[b][rng.integers(0, len(sentences[b]))]
                    row = s + o
                    y[len(s) :, j] = b
                row = (row + b" " * WINDOW)[:WINDOW]
                x[:, j] = np.frombuffer(row, np.uint8)
            _, grads = self.gradient(x.reshape(WINDOW // STRIDE, STRIDE, batch), y[::STRIDE])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            lr = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            for i, g in enumerate(grads):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                weights[i] -= (lr * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def read_flat(self, texts: list[bytes], at_once: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes in whole windows, the place at which each text begins, and the probabilities of all steps.

        A text is followed by one blank or more, which fill its last window.
        """
        windows = np.array([len(t) // WINDOW + 1 for t in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(windows)])
        line = np.full(int(first[-1]) * WINDOW, 32, np.uint8)
        for t, f in zip(texts, first, strict=False):
            line[f * WINDOW : f * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
        steps = WINDOW // STRIDE
        flat, pairs = line.reshape(-1, steps, STRIDE), self.pair_tables()
        p = np.empty((len(flat), steps, len(self.langs)), np.float32)
        for i in range(0, len(flat), at_once):
            part = flat[i : i + at_once].astype(np.intp)
            x = np.ascontiguousarray((part[:, :, 0] * 256 + part[:, :, 1]).T)
            p[i : i + at_once] = self.probabilities(x, pairs).transpose(2, 0, 1)
        return line, first[:-1] * WINDOW, p.reshape(-1, len(self.langs))

    def read(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text the probabilities of its steps, (bytes / STRIDE, languages)."""
        _, first, p = self.read_flat(texts)
        return [p[f // STRIDE : f // STRIDE + -(-len(t) // STRIDE)] for t, f in zip(texts, first, strict=True)]


def _cut(text: bytes) -> list[bytes]:
    out, a = [], 0
    for m in _ENDS.finditer(text):
        out.append(text[a : m.end()])
        a = m.end()
    if a < len(text):
        out.append(text[a:])
    return [x for x in out if x.strip()]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63, 124]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[34, 39, 41, 93]] = True


def sentences_in(line: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of all texts in ``line`` at once: where they begin, their words, and their text's number.

    A sentence ends with a stop (and a closing sign) before white space, with a danda, with a vertical
    tab (which ``clean`` puts after headings), or with white space that begins and ends with a line end.
    """
    space = _SPACE[line]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))
    if not len(begin):
        return begin, begin, begin
    last = line[end]
    closed = _CLOSE[last]
    core = np.where(closed & (end > 0), line[end - 1], last)
    at = np.where(closed, end - 1, end)
    danda = (core == 0xA4) & (line[at - 1] == 0xA5) & (line[at - 2] == 0xE0)
    stop = _STOP[core] | danda
    gap_head, gap_tail = line[np.minimum(end + 1, len(line) - 1)], line[begin - 1]
    heading = (gap_head[:-1] == 11) | (gap_tail[1:] == 11)
    blank = (gap_head[:-1] == 10) & (gap_tail[1:] == 10) & (begin[1:] - end[:-1] > 2)
    new = np.concatenate([[True], stop[:-1] | heading | blank])
    text = np.searchsorted(first, begin, side="right") - 1
    new[1:] |= text[1:] != text[:-1]
    k = np.flatnonzero(new)
    return begin[k], np.diff(np.append(k, len(begin))), text[k]


def passages(starts: np.ndarray, words: np.ndarray, size: int, p: np.ndarray, least: int = 4) -> list[tuple[int, int, int, int, float]]:
    """Passages of a text of ``size`` bytes as (start, end, language, words, confidence).

    A sentence of fewer than ``least`` words goes with the passage before it, as does one whose language has less than two
    thirds of it (half, from twice ``least`` words on).
    """
    if not len(starts):
        return []
    starts = np.concatenate([[0], starts[1:]])
    ends = np.append(starts[1:], size)
    sums = np.add.reduceat(p, starts // STRIDE, axis=0)
    means = sums / sums.sum(1, keepdims=True)
    best, sure = means.argmax(1), means.max(1)
    steady = (words >= least) & (sure >= np.where(words >= 2 * least, 0.5, 0.67))
    if steady.any():
        last = int(np.bincount(best[steady], weights=words[steady]).argmax())
    else:
        last = int(sums.sum(0).argmax())
    out: list[list] = []
    for a, b, k, w, ok in zip(starts.tolist(), ends.tolist(), best.tolist(), words.tolist(), steady.tolist(), strict=True):
        last = k if ok else last
        if out and out[-1][2] == last:
            out[-1][1] = b
            out[-1][3] += w
        else:
            out.append([a, b, last, w])
    return [(a, b, k, w, float(p[a // STRIDE : -(-b // STRIDE), k].mean())) for a, b, k, w in out]


def languages_of(parts: list[tuple[int, int, int, int, float]], min_words: int = MIN_WORDS) -> list[tuple[int, int, float]]:
    """Languages of a text with these passages as (language, words, confidence), the main one first.

    Another language counts with ``min_words`` words in whole sentences.
    """
    words: dict[int, int] = {}
    for _, _, k, w, _ in parts:
        words[k] = words.get(k, 0) + w
    order = sorted(words, key=lambda k: (-words[k], k))
    confidence = {k: float(np.average([c for *_, kk, _, c in parts if kk == k], weights=[b - a for a, b, kk, _, _ in parts if kk == k])) for k in order}
    return [(k, words[k], confidence[k]) for i, k in enumerate(order) if i == 0 or words[k] >= min_words]


def read_languages(model: ByteTagger, texts: list[bytes], with_passages: bool = False) -> Iterator[tuple[list[tuple[int, int, float]], list[tuple[int, int, int, int, float]]]]:
    """(languages, passages) of each text; passages only where asked for or needed.

    A text all of whose sentences have one language beyond doubt is settled for all texts at once.
    """
    line, first, p = model.read_flat(texts)
    starts, words, of = sentences_in(line, first)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    plain = np.zeros(len(texts), bool)
    if len(starts) and not with_passages:
        steps = np.array([-(-len(t) // STRIDE) for t in texts])
        room = np.diff(np.append(first // STRIDE, len(p)))
        # The blanks that fill a text's last window don't count.
        p[np.arange(len(p)) - np.repeat(first // STRIDE, room) >= np.repeat(steps, room)] = 0
        head = np.concatenate([[True], of[1:] != of[:-1]])
        at = np.where(head, first[of], starts) // STRIDE
        sums = np.add.reduceat(p, at, axis=0)
        best, sure = sums.argmax(1), sums.max(1) / np.maximum(sums.sum(1), 1e-9)
        begin = np.flatnonzero(head)
        same = (np.minimum.reduceat(best, begin) == np.maximum.reduceat(best, begin)) & (np.minimum.reduceat(sure, begin) >= 0.67)
        plain[of[begin[same]]] = True
        whole = np.add.reduceat(sums, begin, axis=0)
        share = whole[np.arange(len(begin)), best[begin]] / np.maximum(whole.sum(1), 1e-9)
        total = np.add.reduceat(words, begin)
        where = np.full(len(texts), -1)
        where[of[begin]] = np.arange(len(begin))
    for n, t in enumerate(texts):
        if plain[n]:
            k = where[n]
            yield [(int(best[begin[k]]), int(total[k]), float(share[k]))], []
            continue
        a, b, f = bounds[n], bounds[n + 1], first[n]
        parts = passages(starts[a:b] - f, words[a:b], len(t), p[f // STRIDE : f // STRIDE + -(-len(t) // STRIDE)])
        yield languages_of(parts), parts


def _slice_end(text: bytes, at: int, size: int) -> int:
    """Where a slice of at most ``size`` bytes from ``at`` on ends: after its last sentence, blank or character."""
    end = at + size
    if end >= len(text):
        return len(text)
    for marks in ((b". ", b"! ", b"? ", b"\n", "। ".encode()), (b" ",)):
        cut = max(text.rfind(m, at, end) + len(m) if text.rfind(m, at, end) >= 0 else 0 for m in marks)
        # The blank may go to the next slice, so that bytes are paired as in the whole text.
        cut -= (cut - at) % STRIDE
        if cut > at:
            return cut
    while end > at + 1 and text[end] & 0xC0 == 0x80:
        end -= 1
    return end


def read_long(model: ByteTagger, text: bytes, at_once: int = READ_BYTES) -> tuple[list[tuple[int, int, float]], list[tuple[int, int, int, int, float]]]:
    """(languages, passages) of a very long text, read whole but a slice at a time, so that memory stays bounded.

    A slice ends with a sentence, or where it has none, with a character.
    """
    out: list[tuple[int, int, int, int, float]] = []
    at, end = 0, 0
    while end < len(text):
        at, end = end, _slice_end(text, end, at_once)
        ((_, parts),) = read_languages(model, [text[at:end]], True)
        for a, b, k, w, c in parts:
            a, b = a + at, b + at
            if out and out[-1][2] == k:
                a0, b0, _, w0, c0 = out.pop()
                a, w, c = a0, w + w0, (c0 * (b0 - a0) + c * (b - a)) / max(1, b - a0)
            out.append((a, b, k, w, c))
    return languages_of(out), out


#: Models of this process by their samples, the last few of them.
_FITTED: dict[str, ByteTagger] = {}


def main_languages(model: ByteTagger, texts: list[str]) -> list[str | None]:
    """The language most words of each text are in; None for a text without any."""
    out: list[str | None] = [None] * len(texts)
    held: list[int] = []
    data = [clean(t) for t in texts]
    size = 0
    for i in range(len(texts) + 1):
        if held and (i == len(texts) or size >= READ_BYTES):
            for k, (langs, _) in zip(held, read_languages(model, [data[k] for k in held]), strict=True):
                out[k] = model.langs[langs[0][0]] if langs else None
            held, size = [], 0
        if i == len(texts) or not data[i].strip():
            continue
        if len(data[i]) > 2 * READ_BYTES:
            langs = read_long(model, data[i])[0]
            out[i] = model.langs[langs[0][0]] if langs else None
        else:
            held.append(i)
            size += len(data[i])
    return out


def fit(lang_samples: DataFrame, english: DataFrame | None = None) -> ByteTagger:
    """Train on the labelled samples and, if given, on more English ones (``sample_id``, ``text``).

    A model is kept as long as the process, so equal samples train once.
    """
    rows = lang_samples.where("lang is not null and text is not null").orderBy("sample_id").limit(MOST_SAMPLES).collect()
    if not rows:
        raise ValueError("no labelled samples")
    samples = [(r.lang, r.text) for r in rows]
    if english is not None and any(g == "en" for g, _ in samples):
        samples += [("en", r.text) for r in english.where("text is not null").orderBy("sample_id").limit(MOST_SAMPLES).collect()]
    name = hashlib.sha256(repr(samples).encode("utf-8", "surrogatepass")).hexdigest()
    if name not in _FITTED:
        if len(_FITTED) >= 4:
            _FITTED.clear()
        _FITTED[name] = ByteTagger(sorted({g for g, _ in samples})).fit(samples)
    return _FITTED[name]


def document_languages(docs: DataFrame, model: ByteTagger, id_col: str = "chapter_id", text: str = "own_text", min_words: int = 1, by_passage: bool = False) -> DataFrame:
    """One row for each language of a text (``lang``, ``words``, ``confidence``, ``languages`` in all), or for each passage.

    Passages have ``passage`` from 1 and their byte ``start`` and ``end`` instead of ``languages``.
    """
    kind = dict(docs.dtypes)[id_col]

    def read(ids: list, texts: list[bytes]) -> Iterator[pd.DataFrame]:
        rows = []
        found = [read_long(model, t) for t in texts] if len(texts[0]) > 2 * READ_BYTES else read_languages(model, texts, by_passage)
        for i, (langs, parts) in zip(ids, found, strict=True):
            if by_passage:
                rows += [(i, model.langs[k], w, c, n, a, b) for n, (a, b, k, w, c) in enumerate(parts, 1)]
            else:
                rows += [(i, model.langs[k], w, c, len(langs)) for k, w, c in langs]
        if rows:
            yield pd.DataFrame(rows, columns=[id_col, "lang", "words", "confidence", *(["passage", "start", "end"] if by_passage else ["languages"])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        texts: list[bytes] = []
        held = 0
        for pdf in batches:
            for i, t in zip(pdf[id_col], pdf[text], strict=True):
                if isinstance(t, str) and len(t.split()) >= min_words:
                    data = clean(t)
                    if len(data) > 2 * READ_BYTES:
                        yield from read([i], [data])
                        continue
                    ids.append(i)
                    texts.append(data)
                    held += len(data)
                    if held >= READ_BYTES:
                        yield from read(ids, texts)
                        ids, texts, held = [], [], 0
        if ids:
            yield from read(ids, texts)

    rest = ", passage int, start int, end int" if by_passage else ", languages int"
    return docs.select(id_col, text).mapInPandas(run, f"`{id_col}` {kind}, lang string, words int, confidence double{rest}")


def label_codes(lang_samples: DataFrame) -> DataFrame:
    """Names and codes of languages as labels: ``label``, ``label_lang``."""
    names = lang_samples.select(F.lower(F.trim("medium")).alias("label"), F.col("lang").alias("label_lang"))
    return names.unionByName(lang_samples.select(F.lower(F.trim("lang")).alias("label"), F.col("lang").alias("label_lang"))).where("label is not null").distinct()


def found(pages: DataFrame, types: DataFrame, lang_samples: DataFrame, english: DataFrame | None = None) -> DataFrame:
    """Pages of prose whose label is missing, names another language, or covers only one of several."""
    got = document_languages(pages, fit(lang_samples, english), min_words=MIN_WORDS)
    labels = pages.select("chapter_id", F.lower(F.regexp_replace("medium", r"^[\s\x{a0}]+|[\s\x{a0}]+$", "")).alias("label")).join(F.broadcast(label_codes(lang_samples)), "label", "left").select("chapter_id", "label_lang")
    wrong = got.join(labels, "chapter_id").where("label_lang is null or languages > 1 or label_lang <> lang")
    return wrong.join(types.where("kind <> 'prose'").select("chapter_id"), "chapter_id", "left_anti").select("chapter_id", "lang")
