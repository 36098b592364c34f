"""Dataset categories by name prefix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquilt import config as C

DEFAULT_RULES = {"hq": C.DEFAULT_HQ_PREFIXES, "lq": [], "text": [], "math": []}


def parse_rules(**settings: str) -> dict[str, list[str]]:
    """Comma-separated settings per category; an empty setting is an empty list."""
    return {category: value.split(",") if value else [] for category, value in settings.items()}


def matching_categories(name: Column, rules: dict[str, list[str]]) -> Column:
    """Each category once whose prefixes include one that starts ``name``."""
    tests = [
        F.when(reduce(Column.__or__, [name.startswith(p) for p in prefixes]), F.lit(category))
        for category, prefixes in rules.items()
        if prefixes
    ]
    if not tests:
        return F.array().cast("array<string>")
    return F.filter(F.array(*tests), lambda c: c.isNotNull())


def route_by_prefix(df: DataFrame, rules: dict[str, list[str]], name: str = "source") -> DataFrame:
    """One row per matching category; rows without one are dropped. The rules are constants of the plan."""
    return df.withColumn("category", F.explode(matching_categories(F.col(name), rules)))
