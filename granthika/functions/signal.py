"""PCM samples and other device data as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_SCALE = 32768.0
GAIN = 1.2


def to_float(samples: Column) -> Column:
    return F.transform(samples, lambda x: x / F.lit(FULL_SCALE))


def peak(samples: Column) -> Column:
    """Largest amplitude; 0 for no samples. Taken in 32 bits, so the least sample counts whole."""
    return F.coalesce(F.greatest(F.abs(F.array_min(samples).cast("int")), F.abs(F.array_max(samples).cast("int"))), F.lit(0))


def amplified(samples: Column) -> Column:
    """Samples raised so that their peak is 1.2 times full scale, clipped to 16 bits; silence stays as it is."""
    p = peak(samples)
    gain = F.when(p > 0, F.lit(FULL_SCALE) / p * F.lit(GAIN)).otherwise(F.lit(1.0))
    return F.transform(samples, lambda x: F.greatest(F.least(x * gain, F.lit(32767.0)), F.lit(-32768.0)).cast("int").cast("smallint"))


def rms(samples: Column) -> Column:
    n = F.size(samples)
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return F.when(n > 0, F.sqrt(total / n)).otherwise(F.lit(0.0))


def duration_s(n_bytes: Column, width: Column, channels: Column, rate: Column) -> Column:
    """Seconds of a clip; a rate, width or channel count of 0 counts as 1."""
    one = lambda c: F.when(c > 0, c).otherwise(F.lit(1))
    return n_bytes / (one(width) * one(channels)) / one(rate)


def sine(n: Column, rate: int = 16000, hertz: float = 440.0, amplitude: float = 12000.0) -> Column:
    """A test tone of n samples."""
    import math

    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.sin(i * F.lit(2 * math.pi * hertz / rate)) * amplitude).cast("int").cast("smallint"))


def packed_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def phase(seconds: Column, period: float = 3.0, phases: int = 4) -> Column:
    """Phase of a repeating animation."""
    return F.floor(F.pmod(seconds, F.lit(period)) / F.lit(period / phases)).cast("int")


def intensity(seconds: Column, period: float = 3.0, phases: int = 4) -> Column:
    """How far the current phase has come, from 0 to 1: one light fades in by it and the one before out."""
    part = period / phases
    return F.pmod(seconds, F.lit(period)) / F.lit(part) - phase(seconds, period, phases)


# Colours by name.
COLOURS = {
    "off": (0, 0, 0), "black": (0, 0, 0), "on": (255, 255, 255), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 255, 0), "blue": (0, 0, 255),
    "yellow": (255, 200, 0), "purple": (100, 0, 255), "cyan": (0, 255, 255), "orange": (255, 75, 0),
}


def named_rgb(name: Column) -> Column:
    """A colour's name packed; null for an unknown one."""
    packed = F.create_map(*[F.lit(x) for k, (r, g, b) in COLOURS.items() for x in (k, r << 16 | g << 8 | b)])
    return F.try_element_at(packed, name)


def parsed_rgb(values: Column) -> Column:
    """``r,g,b`` packed, each number to its low eight bits; other texts give null."""
    parts = F.transform(F.split(values, ","), lambda x: F.trim(x).try_cast("int").bitwiseAND(255))
    return F.when(F.size(parts) == 3, packed_rgb(parts[0], parts[1], parts[2]))


def to_byte(value: Column, kind: str) -> Column:
    """A level as 0 to 255: a fraction (``double``) scaled and cut, a ``boolean`` off or full, a number as it is."""
    return {"double": (value * F.lit(255.0)).cast("int"), "boolean": F.when(value, 255).otherwise(0)}.get(kind, value)
