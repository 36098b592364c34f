"""Repeatable draws: every random choice is a hash of a seed and the row's own key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def hash60(*parts: Column) -> Column:
    """The first 15 hex digits of ``md5("a:b:...")`` as a non-negative bigint."""
    joined = F.concat_ws(":", *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")


def hash32(value: Column) -> Column:
    """The first 8 hex digits of ``md5(value)`` as a non-negative bigint."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint")


def unit_interval(hashed: Column) -> Column:
    """A 60-bit hash as a double in [0, 1)."""
    return hashed.cast("double") / F.lit(float(1 << HASH_BITS))
