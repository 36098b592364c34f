"""Chat strings from turn rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquilt.functions.prompts import message


def render_chat(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(key, conversations)``: the closed turns of a conversation in order, as one string.

    The result is a single cell per conversation, so its turns must meet; each turn is rendered before the
    exchange and only the finished string and its place travel. A null text or role is an empty one: the turn stays.
    """
    rendered = turns.select(key, F.struct(F.col(order).alias("o"), message(F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))).alias("m")).alias("_t"))
    chats = rendered.groupBy(key).agg(F.array_sort(F.collect_list("_t")).alias("_turns"))
    return chats.select(key, F.array_join("_turns.m", "").alias("conversations"))
