"""Where every sample goes: ``(key, epoch, rank, batch_id, pos)`` on keys alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquilt.operators import sharding as S

PLACE = ["epoch", "rank", "batch_id", "pos"]


@dataclass(frozen=True)
class EpochPlan:
    """Planned rows with the numbers they follow from, so that counts need no further pass."""

    rows: DataFrame
    total: int
    world: int
    batch_size: int
    epochs: int

    def batches(self, rank: Column) -> Column:
        """Full batches of a rank per epoch."""
        base, extra = divmod(self.total, self.world)
        size = F.when(rank < extra, F.lit(base + 1)).otherwise(F.lit(base))
        return F.floor(size / self.batch_size).cast("bigint")

    def steps(self) -> DataFrame:
        """``(epoch, rank, batch_id)`` of every full batch, by arithmetic: no row of the table is looked at."""
        base, extra = divmod(self.total, self.world)
        longer, shorter = (base + 1) // self.batch_size, base // self.batch_size
        head = extra * longer
        per_epoch = head + (self.world - extra) * shorter
        at = F.col("id") % max(per_epoch, 1)

        def place(at: Column, first_rank: int, batches: int) -> Column:
            each = max(batches, 1)
            return F.struct((first_rank + F.floor(at / each)).cast("bigint").alias("rank"), (at % each).alias("batch_id"))

        where = F.when(at < head, place(at, 0, longer)).otherwise(place(at - head, extra, shorter))
        numbers = self.rows.sparkSession.range(self.epochs * per_epoch)
        return numbers.select(F.floor(F.col("id") / max(per_epoch, 1)).cast("bigint").alias("epoch"), where.alias("_at")).select("epoch", "_at.rank", "_at.batch_id")


def _finish(shuffled: DataFrame, key: str, total: int, world: int, batch_size: int, epochs: int) -> EpochPlan:
    batched = S.assign_batches(shuffled, batch_size, ["epoch", "rank"], group_rows="shard_rows")
    return EpochPlan(batched.select(key, *PLACE), total, world, batch_size, epochs)


def main_plan(samples: DataFrame, key: str, world: int, batch_size: int, seed: int, epochs: int = 1, dense: bool = False) -> EpochPlan:
    """The main table: contiguous shards, a full shuffle per rank and epoch, full batches. ``dense``: the key numbers the
    rows from 0 without gaps, as ``with_row_order`` does for a whole scan, and needs no numbering."""
    sharded, total = S.contiguous(samples.select(key), key, world, dense)
    shuffled = S.seeded_shuffle(
        S.epoch_expand(sharded, epochs), key, seed, ["epoch", "rank"], "epoch", groups=world * epochs
    )
    return _finish(shuffled, key, total, world, batch_size, epochs)


def side_plan(samples: DataFrame, key: str, world: int, batch_size: int, seed: int, epochs: int = 1, dense: bool = False) -> EpochPlan:
    """A lazily read table: strided shards, a bounded shuffle per rank and epoch, full batches."""
    sharded, total = S.strided(samples.select(key), key, world, dense)
    local = sharded.withColumn("ord", F.floor(F.col("ord") / world).cast("bigint"))
    shuffled = S.buffer_shuffle(S.epoch_expand(local, epochs), key, seed, ["epoch", "rank"], "epoch")
    return _finish(shuffled, key, total, world, batch_size, epochs)


def plan_main(samples: DataFrame, key: str, world: int, batch_size: int, seed: int, epochs: int = 1, dense: bool = False) -> DataFrame:
    return main_plan(samples, key, world, batch_size, seed, epochs, dense).rows


def plan_side(samples: DataFrame, key: str, world: int, batch_size: int, seed: int, epochs: int = 1, dense: bool = False) -> DataFrame:
    return side_plan(samples, key, world, batch_size, seed, epochs, dense).rows


def plan_validation(samples: DataFrame, key: str, world: int) -> DataFrame:
    """Strided shards in order, one row per batch."""
    sharded, total = S.strided(samples.select(key), key, world)
    local = sharded.withColumn("ord", F.floor(F.col("ord") / world).cast("bigint")).withColumn(
        "epoch", F.lit(0).cast("bigint")
    )
    return _finish(local, key, total, world, 1, 1).rows
