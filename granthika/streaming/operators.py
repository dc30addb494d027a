"""Stateful stream operators: sentences, frames, debounce, sessions, correlation.

State is one short buffer or one pair of values per key, dropped by an explicit end row or a timeout.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granthika.functions import text as T
from granthika.operators.grounding import REFUSAL_TEXT

# Where a sentence and a message end.
_END = re.compile(r"[.!?।]+[\s\"')\]]*")
_FRAME = re.compile(r"[\r\n]")


def _cut_sentences(buffer: str) -> tuple[list[str], str]:
    """Complete sentences at the front of a buffer, and what is left."""
    out = []
    while m := _END.search(buffer):
        s, buffer = buffer[: m.end()].strip(), buffer[m.end() :]
        if s:
            out.append(s)
    return out, buffer


def _cut_frames(buffer: str) -> tuple[list[str], str]:
    *whole, rest = _FRAME.split(buffer)
    return [x.strip() for x in whole if x.strip()], rest


def _in_order(batches: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """All rows that a trigger brings for a key; Arrow may hand them over in several batches, in any order."""
    held = [pdf for pdf in batches if len(pdf)]
    return pd.concat(held).sort_values(by, kind="stable") if held else pd.DataFrame()


def _assembler(cut, flush: bool, wait_ms: int | None):
    columns = ["stream_id", "index", "text"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, index = state.get if state.exists else ("", 0)
        rows, over = [], state.hasTimedOut
        for text, end in _in_order(batches, "seq")[["chunk", "eos"]].itertuples(index=False) if not over else ():
            found, buffer = cut(buffer + (text or ""))
            over = bool(end)
            for s in [*found, *([buffer.strip()] if over and flush and buffer.strip() else [])]:
                rows.append((key[0], index, s))
                index += 1
            if over:
                break
        if over:
            if state.hasTimedOut and flush and buffer.strip():
                rows.append((key[0], index, buffer.strip()))
            if state.exists:
                state.remove()
        else:
            state.update((buffer, index))
            if wait_ms is not None:
                state.setTimeoutDuration(wait_ms)
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return run


def _timeout(wait_ms: int | None) -> str:
    """With a timeout Spark runs batches for ever, also of a source that has ended; without one end rows alone drop state."""
    return GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def sentences(chunks: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """Sentences of each ``stream_id`` as soon as they end; a row with ``eos``, or ``wait_ms`` without rows, brings out the rest.

    Takes ``stream_id`` string, ``seq``, ``chunk``, ``eos``; gives ``stream_id``, ``index``, ``text``. Rows of a trigger
    are taken in order of ``seq``; what comes after the end row in it is passed over, and the state goes with the stream.
    """
    return chunks.groupBy("stream_id").applyInPandasWithState(_assembler(_cut_sentences, True, wait_ms), "stream_id string, index int, text string", "buffer string, n int", "append", _timeout(wait_ms))


def frames(chunks: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """Messages of a serial stream, divided by line ends; an unfinished one waits for its end, and goes with the stream."""
    return chunks.groupBy("stream_id").applyInPandasWithState(_assembler(_cut_frames, False, wait_ms), "stream_id string, index int, text string", "buffer string, n int", "append", _timeout(wait_ms))


def _refuses(text: str) -> bool:
    t = text.strip()
    return not t or bool(regex.match(T.REFUSAL, t))


def _cleaned(text: str) -> str:
    return regex.sub(T.EMPTY_BRACKETS, "", regex.sub(T.REFUSAL, "", regex.sub(T.PREAMBLE, "", text))).strip()


def answers(chunks: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """Streamed answers as sentences: ``stream_id``, ``index``, ``text_en``, ``refused``, ``citations``, ``reason``.

    Takes what ``sentences`` takes, with ``gated`` (the gate refused the request) and ``citations``. A request that the
    gate refuses, or whose answer begins with the sentinel, gives exactly one refusal. Else each sentence is cleaned,
    empty ones are passed over, indexes have no gaps, and only the first sentence carries the citations.
    """
    fields = ["stream_id", "index", "text_en", "refused", "citations", "reason"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, index, seen, done = state.get if state.exists else ("", 0, 0, False)
        rows, over = [], state.hasTimedOut

        def say(found: list[str], cited: list[str]) -> bool:
            nonlocal index, seen
            for s in found:
                seen += 1
                if seen == 1 and _refuses(s):
                    rows.append((key[0], 0, REFUSAL_TEXT, True, [], "no answer in the sources"))
                    return True
                if t := _cleaned(s):
                    rows.append((key[0], index, t, False, cited if index == 0 else [], None))
                    index += 1
            return False

        cites: list[str] = []
        for text, end, gated, cited in _in_order(batches, "seq")[["chunk", "eos", "gated", "citations"]].itertuples(index=False) if not over else ():
            cites = [] if cited is None else list(cited)
            if not done and gated:
                rows.append((key[0], 0, REFUSAL_TEXT, True, [], "below the gate"))
                done = True
            if not done:
                found, buffer = _cut_sentences(buffer + (text or ""))
                done = say(found, cites)
            over = bool(end)
            if over:
                break
        if over:
            if not done and buffer.strip():
                say([buffer.strip()], cites)
            if state.exists:
                state.remove()
        else:
            state.update((buffer, index, seen, done))
            if wait_ms is not None:
                state.setTimeoutDuration(wait_ms)
        if rows:
            yield pd.DataFrame(rows, columns=fields)

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, index int, text_en string, refused boolean, citations array<string>, reason string", "buffer string, n int, seen int, done boolean", "append", _timeout(wait_ms))


def delivered(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None], **trigger):
    """Hand each batch of sentences to ``on_batch``, in order of stream and index; gives the running query."""
    def each(batch: DataFrame, number: int) -> None:  # noqa: E306
        on_batch(batch.orderBy("stream_id", "index"), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def debounced(events: DataFrame, quiet_s: float = 0.1) -> DataFrame:
    """Changes of ``value`` per ``key`` more than ``quiet_s`` after the last one taken; ``at`` in seconds.

    The state is one pair of values for each key there is.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, at = state.get if state.exists else (None, -1e300)
        rows = []
        for t, v in _in_order(batches, "at")[["at", "value"]].itertuples(index=False):
            if v != value and t - at > quiet_s:
                rows.append((key[0], t, v))
                value, at = v, t
        if value is not None:
            state.update((value, at))
        if rows:
            yield pd.DataFrame(rows, columns=["key", "at", "value"])

    return events.groupBy("key").applyInPandasWithState(run, "key string, at double, value string", "value string, at double", "append", GroupStateTimeout.NoTimeout)


def correlated(requests: DataFrame, responses: DataFrame, within: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Responses of the same kind within a time of a request: a stream-stream interval join."""
    q = requests.withWatermark("request_ts", late)
    r = responses.withWatermark("response_ts", late)
    return q.join(r, (F.col("request_kind") == F.col("response_kind")) & (F.col("response_ts") >= F.col("request_ts")) & (F.col("response_ts") <= F.expr(f"request_ts + interval {within}")))


def push_to_talk(events: DataFrame, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions of each ``key`` by gaps: their bounds and number of rows."""
    return events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def gauge(events: DataFrame, every: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Rows and mean value of each fixed period."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every)).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")
