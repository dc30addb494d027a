"""Logs of a device: latencies, histograms, sessions, correlation, routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAMPS = ("audio_start", "audio_stop", "asr_start", "asr_stop", "nmt_a_stop", "llm_start", "llm_end", "nmt_b_stop", "app_end")


def stage_latencies(log: DataFrame) -> DataFrame:
    """``id``, ``stage``, ``seconds``: differences of consecutive stamps; missing stamps make null stages."""
    pairs = F.array(*[F.struct(F.lit(b).alias("stage"), F.round(F.col(f"timestamps.{b}") - F.col(f"timestamps.{a}"), 6).alias("seconds")) for a, b in zip(STAMPS, STAMPS[1:], strict=False)])
    return log.select("id", F.inline(pairs))


def total_seconds(timings: Column, without: str = "total") -> Column:
    """Sum of a map of timings but for one key."""
    kept = F.map_filter(timings, lambda k, v: k != without)
    return F.aggregate(F.map_values(kept), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def sessions(events: DataFrame, user: str, ts: str, down: Column, order: tuple[str, ...]) -> DataFrame:
    """``session``: the number of markers so far, 0 before the first."""
    w = Window.partitionBy(user).orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("session", F.sum(F.when(down, 1).otherwise(0)).over(w).cast("bigint"))


def latest_per_key(rows: DataFrame, key: str, order: tuple[str, ...], *columns: str) -> DataFrame:
    """The last row of each key, without a sort."""
    last = F.max(F.struct(*order, *columns)).alias("last_")
    return rows.groupBy(key).agg(last).select(key, *(F.col(f"last_.{c}").alias(c) for c in dict.fromkeys([*order, *columns])))


def changes(events: DataFrame, key: str, ts: str, value: str, order: tuple[str, ...], quiet_s: float) -> DataFrame:
    """Rows whose value differs from the row before and comes more than ``quiet_s`` after it."""
    w = Window.partitionBy(key).orderBy(ts, *order)
    gap = F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(w)
    seen = events.withColumn("before_", F.lag(value).over(w)).withColumn("gap_", gap)
    return seen.where(F.col("before_").isNull() | ((F.col("before_") != F.col(value)) & (F.col("gap_") > quiet_s * 1e6))).drop("before_", "gap_")


def correlated(requests: DataFrame, responses: DataFrame, key: str, ts: str, within_s: int) -> DataFrame:
    """Responses of the same key within so many seconds of a request, the first for each request.

    Rows meet in buckets of the window's width, so a key's history is never paired with itself whole.
    """
    width = within_s * 1_000_000
    q = requests.withColumn("b_", F.explode(F.array(F.floor(F.unix_micros(ts) / width), F.floor(F.unix_micros(ts) / width) + 1)))
    r = responses.select(F.col(key), F.col("response_id"), F.col(ts).alias("response_ts"), F.floor(F.unix_micros(ts) / width).alias("b_"))
    near = q.join(r, [key, "b_"]).where((F.col("response_ts") >= F.col(ts)) & (F.unix_micros("response_ts") - F.unix_micros(ts) <= width))
    return near.groupBy("request_id").agg(F.min(F.struct("response_ts", "response_id")).alias("m")).select("request_id", F.col("m.response_id").alias("response_id"))


def routed(message: Column) -> Column:
    """Kind of a serial message by its prefix."""
    return (
        F.when(message.startswith("BT0"), "trigger_down").when(message.startswith("BT1"), "trigger_up").when(message.startswith("B"), "button")
        .when(message.startswith("dOK"), "ready").when(message.startswith("C"), "command").otherwise("other")
    )


def setting_of(message: Column) -> Column:
    """A user interface message as (setting, value), null for others."""
    body = F.substring_index(message, " ", 1)
    name = F.when(body.isin("ASR", "TTS"), F.concat(F.lower(body), F.lit("_language"))).when(body == "MODE", F.lit("mode"))
    return F.when(name.isNotNull(), F.struct(name.alias("setting"), F.lower(F.trim(F.substring(message, F.length(body) + 2, F.length(message)))).alias("value")))


def status_of(free_gb: Column, least: float = 2.0) -> Column:
    return F.when(free_gb > least, "PASS").otherwise("WARN")


def hit_test(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes (a small, stated set: buttons of a screen) that hold each point, borders of the origin included."""
    p, b = points.alias("p"), F.broadcast(boxes).alias("b")
    inside = (F.col("p.x") >= F.col("b.x0")) & (F.col("p.x") < F.col("b.x0") + F.col("b.w")) & (F.col("p.y") >= F.col("b.y0")) & (F.col("p.y") < F.col("b.y0") + F.col("b.h"))
    return p.join(b, inside).select("p.point_id", "b.label")


def overlay(*maps: Column) -> Column:
    """Maps merged, the right one wins."""

    def over(left: Column, right: Column) -> Column:
        kept = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
        return F.map_from_entries(F.concat(F.map_entries(kept), F.map_entries(right)))

    return reduce(over, maps)


def key_value(text: Column) -> Column:
    """``k=v`` cut at the first equals sign; text without one raises."""
    parts = F.split(text, "=", 2)
    return F.when(F.size(parts) == 2, F.struct(F.element_at(parts, 1).alias("k"), F.element_at(parts, 2).alias("v"))).otherwise(F.raise_error(F.concat(F.lit("not a setting: "), text)).cast("struct<k:string,v:string>"))


def first_ipv4(addresses: Column) -> Column:
    """The first address without a colon, else the first."""
    return F.coalesce(F.try_element_at(F.filter(addresses, lambda a: ~a.contains(":")), F.lit(1)), F.try_element_at(addresses, F.lit(1)))


def touched(points: DataFrame, height: int = 240) -> DataFrame:
    """Raw touches as screen points: the display is turned, so the axes change places and one is mirrored."""
    return points.withColumn("x_", F.col("y")).withColumn("y", F.lit(height) - F.col("x")).withColumn("x", F.col("x_")).drop("x_")


def radio_selection(hits: DataFrame, order: str = "point_id", passing: tuple[str, ...] = ("Reset", "Reboot", "Shutdown")) -> DataFrame:
    """``group`` and ``label``: the button selected last in each group, a group being labels with the same first word.

    Buttons that act at once are never selected, but a hit on one clears its group, too.
    """
    last = hits.groupBy(F.substring_index("label", " ", 1).alias("group")).agg(F.max_by("label", F.struct(order, "label")).alias("label"))
    return last.where(~F.col("label").isin(*passing))


def payload_status(body: Column) -> Column:
    """State of a service by what it answered: FAIL without a body, WARN for one that is no JSON, else PASS."""
    return F.when(body.isNull() | (body == ""), "FAIL").when(F.try_parse_json(body).isNull(), "WARN").otherwise("PASS")
