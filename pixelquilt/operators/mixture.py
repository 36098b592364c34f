"""The interleaved feed of main, text and math batches, and the draws by weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquilt import config as C
from pixelquilt.functions.hashing import hash60, unit_interval
from pixelquilt.operators.ordinals import bounded_broadcast, running_sums

KINDS = ["main", "text", "math"]


def batches_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per batch of a batched table."""
    return rows.filter(F.col("pos") == 0).select(*keys, "batch_id")


def batches_per_rank(rows: DataFrame, keys: list[str], out: str = "batches") -> DataFrame:
    return batches_of(rows, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def global_steps(main_batches: DataFrame, per_epoch: Column, overlap: bool = False) -> DataFrame:
    """Number the main batches as training steps: ``epoch * B + i`` per rank.

    ``overlap`` repeats the last step id of an epoch as the first of the next, ``epoch * (B - 1) + i``.
    Also keeps the epoch's first step.
    """
    stride = per_epoch - 1 if overlap else per_epoch
    first = (F.col("epoch") * stride).cast("bigint")
    return main_batches.withColumn("epoch_start", first).withColumn(
        "global_step", F.col("epoch_start") + F.col("batch_id")
    )


def mixture_schedule(steps: DataFrame, text_every: int = C.TEXT_EVERY, math_every: int = C.MATH_EVERY) -> DataFrame:
    """What each step feeds: always a main batch, a text and a math batch on their own beat.

    ``k`` counts the draws of a kind since the epoch began, from 0; for main it is the batch itself.
    ``steps`` holds ``global_step``, ``epoch_start`` and ``batch_id``.
    """
    step, start = F.col("global_step"), F.col("epoch_start")

    def beat(kind: str, order: int, every: int) -> Column:
        k = F.floor((step + 1) / every) - F.floor(start / every) - 1
        entry = F.struct(
            F.lit(kind).alias("kind"), F.lit(order).alias("kind_order"), k.cast("bigint").alias("k")
        )
        return F.when((step + 1) % every == 0, entry)

    main = F.struct(F.lit("main").alias("kind"), F.lit(0).alias("kind_order"), F.col("batch_id").alias("k"))
    feeds = F.filter(F.array(main, beat("text", 1, text_every), beat("math", 2, math_every)), lambda e: e.isNotNull())
    kept = [c for c in steps.columns if c not in ("batch_id", "epoch_start")]
    return steps.select(*kept, F.explode(feeds).alias("_feed")).select(*kept, "_feed.kind", "_feed.kind_order", "_feed.k")


def cycle_batches(
    schedule: DataFrame,
    rows: DataFrame,
    kind: str,
    batches: Column | None = None,
    groups: int | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Rows of one side stream for every draw of it; after its last batch the stream starts again.

    ``batches`` is the stream's number of batches for the draw's rank; without it the batches are counted. The
    joined key is the drawn batch. A stream with few batches is small as a whole and passes Spark's own
    broadcast check; a long one spreads its draws over its batches.
    """
    keys = keys or ["epoch", "rank"]
    draws = schedule.filter(F.col("kind") == kind)
    if batches is None:
        draws = draws.join(bounded_broadcast(batches_per_rank(rows, keys), groups), keys)
    else:
        draws = draws.withColumn("batches", batches).filter(F.col("batches") > 0)
    drawn = draws.withColumn("batch_id", F.col("k") % F.nullif("batches", F.lit(0))).drop("batches", "k")
    return drawn.join(rows, [*keys, "batch_id"])


def mix(parts: list[DataFrame]) -> DataFrame:
    """All parts as one table."""
    mixed = parts[0]
    for part in parts[1:]:
        mixed = mixed.unionByName(part, allowMissingColumns=True)
    return mixed


def interleave(parts: list[DataFrame], steps_per_chunk: int = 1024) -> DataFrame:
    """The mixed stream: all parts as one table, each rank's steps in order inside chunks of steps."""
    chunk = F.floor(F.col("global_step") / steps_per_chunk)
    return mix(parts).repartition("rank", chunk).sortWithinPartitions("rank", "global_step", "kind_order", "pos")


def mixed_loss(main: Column, text: Column, math: Column) -> Column:
    """The reported loss of a step: each side loss that is present is averaged into it in turn."""
    with_text = F.when(text.isNotNull(), (main + text) / 2.0).otherwise(main)
    return F.when(math.isNotNull(), (with_text + math) / 2.0).otherwise(with_text)


def size_weights(df: DataFrame, category: str) -> DataFrame:
    """Each category's share of all rows."""
    total = df.select(F.count(F.lit(1))).scalar()
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("weight", F.col("n_rows").cast("double") / total)


#: Weights are cut into so many units; a draw is one of them.
WEIGHT_UNITS = 1 << 40
#: Cells of equal width that the units are divided into, at least.
CELLS = 1024


def draw_table(weights: DataFrame, category: str) -> tuple[DataFrame, int, int]:
    """``(_cell, lo, hi, category)``, the units of all categories, and the width of a cell.

    The units of the categories lie one after the other, in the order of their names; a category stands in every cell
    that its units touch. There are at least as many cells as categories, so a cell holds two of them on average and
    the table has at most one row for each category and each cell.
    """
    whole = weights.select(category, F.floor(F.col("weight") * F.lit(float(WEIGHT_UNITS))).cast("bigint").alias("_units")).filter("_units > 0")
    total, count = whole.agg(F.coalesce(F.sum("_units"), F.lit(0)), F.count(F.lit(1))).first()
    width = max(1, -(-total // max(count, CELLS)))
    ranges = running_sums(whole, [], category, {"hi": F.col("_units")}).withColumn("lo", F.col("hi") - F.col("_units"))
    cells = F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))
    return ranges.select(F.explode(cells).alias("_cell"), "lo", "hi", category), total, width


def weighted_pick(steps: DataFrame, weights: DataFrame, category: str, seed: int, step: str) -> DataFrame:
    """Draw one category per step by weight: a division gives the draw's cell, a comparison the category in it.

    The table of cells meets the steps on the cell. Spark broadcasts it while it is small; a table of many categories is
    joined by cell, and draws are spread evenly over cells. Without weights no step has a category.
    """
    table, total, width = draw_table(weights, category)
    unit = F.floor(unit_interval(hash60(F.lit(seed), F.col(step))) * F.lit(float(total))).cast("bigint")
    drawn = steps.withColumn("_unit", unit).withColumn("_cell", F.floor(F.col("_unit") / width))
    hit = drawn.join(table, "_cell").filter((F.col("_unit") >= F.col("lo")) & (F.col("_unit") < F.col("hi")))
    return hit.select(*steps.columns, category)
