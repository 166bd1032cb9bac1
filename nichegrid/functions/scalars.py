"""Scalar column functions for figures' numbers and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_slope(value: Column, low: float, center: float, high: float) -> Column:
    """0 at low, 0.5 at center, 1 at high, straight between; outside it goes on with the same slopes."""
    if not low < center < high:
        raise ValueError("low, center and high must rise")
    return F.when(value <= center, (value - low) / (2 * (center - low))).otherwise(0.5 + (value - center) / (2 * (high - center)))


def symmetric_log(value: Column, threshold: float, limit: float) -> Column:
    """-1..1 for values within the limit: straight up to the threshold, logarithmic beyond it."""
    if not 0 < threshold < limit:
        raise ValueError("threshold must be above 0 and below the limit")
    bend = lambda c: F.when(F.abs(c) <= threshold, c / threshold).otherwise(F.signum(c) * (1 + F.log(F.abs(c) / threshold)))
    return bend(value) / bend(F.lit(float(limit)))


def slug(name: str) -> str:
    """A name for files: runs of other characters than letters, digits, dot and minus become one underscore."""
    return re.sub(r"[^A-Za-z0-9.\-]+", "_", name).strip("_")


def shorten(name: str, most: int) -> str:
    """A name of `most` characters at most; a longer one keeps its beginning and ends in a hash of the whole."""
    if len(name) <= most:
        return name
    import zlib

    return f"{name[: most - 9]}-{zlib.crc32(name.encode()):08x}"
