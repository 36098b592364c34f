"""Shards, shuffles, epochs and batches.

These steps need only the row key. Run them on the narrow key columns and join the samples afterwards
(``plans.epochs``, ``plans.encode``): text and token arrays then cross the network once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquilt import config as C
from pixelquilt.functions.hashing import hash60
from pixelquilt.operators.ordinals import (
    BUCKET,
    bounded_broadcast,
    default_buckets,
    hash_bucket,
    id_ordinal,
    ordinal,
    whole_keys,
)


def row_total(df: DataFrame) -> Column:
    """The table's row count as a scalar subquery."""
    return df.select(F.count(F.lit(1)).alias("n")).scalar()


def _div(value: Column, by: int) -> Column:
    return F.floor(value / by).cast("bigint")


def contiguous(df: DataFrame, key: str, world: int, dense: bool = False) -> tuple[DataFrame, int]:
    """``shard_contiguous`` and the table's row count. ``dense``: the key numbers the rows from 0 already."""
    placed, rows = id_ordinal(df, key, dense=dense)
    base, extra = divmod(rows, world)
    longer = extra * (base + 1)
    place = F.col("ord")
    rank = F.when(place < longer, _div(place, base + 1)).otherwise(extra + _div(place - longer, max(base, 1)))
    return _with_rank(placed, rank, base, extra), rows


def strided(df: DataFrame, key: str, world: int, dense: bool = False) -> tuple[DataFrame, int]:
    """``shard_strided`` and the table's row count. ``dense``: the key numbers the rows from 0 already."""
    placed, rows = id_ordinal(df, key, dense=dense)
    return _with_rank(placed, F.col("ord") % world, *divmod(rows, world)), rows


def _with_rank(placed: DataFrame, rank: Column, base: int, extra: int) -> DataFrame:
    # Never null, so that later joins on the rank add no null test over its whole expression.
    ranked = placed.withColumn("rank", F.coalesce(rank, F.lit(0)))
    return ranked.withColumn("shard_rows", base + (F.col("rank") < extra).cast("bigint"))


def shard_contiguous(df: DataFrame, key: str, world: int) -> DataFrame:
    """Rank by contiguous blocks in key order; the first ``n mod world`` ranks hold one row more.

    Adds ``ord``, ``rank`` and ``shard_rows`` (the rank's size).
    """
    return contiguous(df, key, world)[0]


def shard_strided(df: DataFrame, key: str, world: int) -> DataFrame:
    """Row ``i`` in key order goes to rank ``i % world``. Adds ``ord``, ``rank`` and ``shard_rows``."""
    return strided(df, key, world)[0]


def epoch_expand(df: DataFrame, epochs: int) -> DataFrame:
    """Every row once per epoch."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(epochs - 1).cast("bigint"))))


def seeded_shuffle(
    df: DataFrame,
    key: str,
    seed: int,
    within: list[str] | None = None,
    epoch: str | None = None,
    groups: int | None = None,
    out: str = "ord",
) -> DataFrame:
    """A full permutation per group, repeatable from ``(seed + epoch, key)``."""
    within = within or []
    epoch_column = F.col(epoch) if epoch else F.lit(0)
    buckets = default_buckets(df.sparkSession)
    hashed = df.withColumn("_h", hash60(F.lit(seed) + epoch_column, F.col(key)))
    hashed = hashed.withColumn(BUCKET, hash_bucket(F.col("_h"), buckets))
    return ordinal(hashed.drop(out), within, ["_h", key], out, buckets=buckets, groups=groups).drop("_h")


def buffer_shuffle(
    df: DataFrame,
    key: str,
    seed: int,
    within: list[str] | None = None,
    epoch: str | None = None,
    place: str = "ord",
    buffer: int = C.BUFFER_ROWS,
    out: str = "ord",
) -> DataFrame:
    """Permute inside blocks of ``buffer`` consecutive rows; ``place`` is the row's ordinal in its group."""
    epoch_column = F.col(epoch) if epoch else F.lit(0)
    blocked = df.withColumn("_block", F.floor(F.col(place) / buffer).cast("bigint"))
    blocked = blocked.withColumn("_h", hash60(F.lit(seed) + epoch_column, F.col(key)))
    order = Window.partitionBy(*(within or []), "_block").orderBy("_h", key)
    moved = F.col("_block") * buffer + F.row_number().over(order) - 1
    return blocked.withColumn(out, moved.cast("bigint")).drop("_block", "_h")


def assign_batches(
    df: DataFrame,
    batch_size: int,
    keys: list[str] | None = None,
    place: str = "ord",
    group_rows: str | None = None,
    groups: int | None = None,
    drop_last: bool = True,
) -> DataFrame:
    """Consecutive groups of ``batch_size`` rows: ``batch_id`` and ``pos``; a short last group is dropped.

    ``group_rows`` names a column that already holds the group's size (the shard steps add one); otherwise the
    groups are counted.
    """
    keys = keys or []
    sized = df
    if drop_last:
        if group_rows:
            sized = df.withColumn("_n", F.col(group_rows))
        elif keys:
            sized, names, added = whole_keys(df, keys)
            counts = sized.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
            sized = sized.join(bounded_broadcast(counts, groups), names).drop(*added)
        else:
            sized = df.withColumn("_n", row_total(df))
        full = F.floor(F.col("_n") / batch_size).cast("bigint") * batch_size
        sized = sized.filter(F.col(place) < full).drop("_n")
    return sized.withColumn("batch_id", F.floor(F.col(place) / batch_size).cast("bigint")).withColumn(
        "pos", (F.col(place) % batch_size).cast("bigint")
    )


def pad_stride_sample(df: DataFrame, key: str, world: int) -> DataFrame:
    """Repeat the first rows until the count divides by ``world``, then rank takes every ``world``-th row.

    Fewer rows than the padding needs is an error.
    """
    placed, rows = id_ordinal(df, key)
    pad = -rows % world
    if pad > rows:
        raise ValueError("Too few rows to pad every rank")
    repeated = F.array(F.col("ord"), F.when(F.col("ord") < pad, F.col("ord") + rows))
    copies = F.explode(F.filter(repeated, lambda o: o.isNotNull()))
    return placed.withColumn("ord", copies).withColumn("rank", F.col("ord") % world)


def step_budget(df: DataFrame, total: int, step: str = "global_step") -> DataFrame:
    return df.filter(F.col(step) < total)


def step_filter(df: DataFrame, every: int, skip_zero: bool = False, step: str = "global_step") -> DataFrame:
    """Every ``every``-th step, with or without step 0."""
    condition = F.col(step) % every == 0
    return df.filter(condition & (F.col(step) != 0) if skip_zero else condition)
