"""The training feed: main, text and math batches interleaved by step, and its place on disk.

A written feed is a table of step ranges: a folder for each rank and run of steps, files in the order in which a trainer
takes the rows, and a manifest of the files with their first and last step. A trainer that stopped goes on at any step and
reads only the ranges from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquilt import config as C
from pixelquilt.operators import mixture as M
from pixelquilt.operators.sharding import step_budget
from pixelquilt.plans.epochs import EpochPlan

FEED_BATCH = ["rank", "global_step", "kind"]


def _stepped(main: EpochPlan, rows: DataFrame, overlap: bool) -> DataFrame:
    """Rows of the main plan with their step: arithmetic on what each row already carries."""
    return M.global_steps(rows, main.batches(F.col("rank")), overlap)


def training_steps(main: EpochPlan, overlap: bool = False) -> DataFrame:
    """One row per rank and step of the main plan. They follow from its numbers alone: nothing is read."""
    return _stepped(main, main.steps(), overlap).select("epoch", "rank", "batch_id", "epoch_start", "global_step")


def feed_parts(
    main: EpochPlan,
    text: EpochPlan | None,
    math: EpochPlan | None,
    total_steps: int | None = None,
    text_every: int = C.TEXT_EVERY,
    math_every: int = C.MATH_EVERY,
    overlap: bool = False,
) -> list[DataFrame]:
    """The rows of each kind as ``(key, epoch, rank, global_step, kind, kind_order, batch_id, pos)``.

    The three plans share the key name. A missing side stream has no steps. Main rows need no join; only the
    draws of the side streams meet their batches.
    """
    lead, steps = _stepped(main, main.rows, overlap), training_steps(main, overlap)
    if total_steps is not None:
        lead, steps = step_budget(lead, total_steps), step_budget(steps, total_steps)
    parts = [lead.drop("epoch_start").withColumns({"kind": F.lit("main"), "kind_order": F.lit(0)})]
    schedule = M.mixture_schedule(steps, text_every, math_every)
    for kind, plan in (("text", text), ("math", math)):
        if plan is not None:
            parts.append(M.cycle_batches(schedule, plan.rows, kind, plan.batches(F.col("rank"))))
    return parts


def plan_feed(main: EpochPlan, text: EpochPlan | None, math: EpochPlan | None, **options) -> DataFrame:
    """All rows of the feed, in no order; to be encoded."""
    return M.mix(feed_parts(main, text, math, **options))


def ordered_feed(main: EpochPlan, text: EpochPlan | None, math: EpochPlan | None, **options) -> DataFrame:
    """All rows of the feed, each rank's steps in order."""
    return M.interleave(feed_parts(main, text, math, **options))


def arrange_feed(rows: DataFrame, steps_per_range: int = C.STEPS_PER_RANGE) -> DataFrame:
    """Rows where ``write_feed`` writes them: by rank and range of steps, in order. To be done while rows are texts."""
    ranged = rows.withColumn("step_range", F.floor(F.col("global_step") / steps_per_range).cast("bigint"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranged.repartition(tasks, "rank", "step_range").sortWithinPartitions("rank", "step_range", "global_step", "kind_order", "pos")


def write_feed(arranged: DataFrame, path: str, steps_per_range: int = C.STEPS_PER_RANGE) -> None:
    """Write arranged rows by rank and range of steps, then the manifest of what was written: one row a file."""
    arranged.write.partitionBy("rank", "step_range").mode("overwrite").parquet(f"{path}/rows")
    spark = arranged.sparkSession
    # The step column alone is read back.
    written = spark.read.schema(arranged.schema).parquet(f"{path}/rows").select("rank", "step_range", "global_step", F.col("_metadata.file_path").alias("file"))
    files = written.groupBy("rank", "step_range", "file").agg(
        F.min("global_step").alias("first_step"), F.max("global_step").alias("last_step"), F.count(F.lit(1)).alias("rows")
    )
    files.withColumn("steps_per_range", F.lit(steps_per_range)).write.mode("overwrite").parquet(f"{path}/manifest")
    if spark.read.parquet(f"{path}/manifest").isEmpty():
        # Without rows there is no folder either; a file without rows keeps the columns.
        arranged.limit(0).write.mode("overwrite").parquet(f"{path}/rows")


def read_feed(spark: SparkSession, path: str, first_step: int = 0, rank: int | None = None) -> DataFrame:
    """The written rows from a step on, of all ranks or one. Earlier ranges are not opened."""
    manifest = spark.read.parquet(f"{path}/manifest")
    found = manifest.select("steps_per_range").first()
    rows = spark.read.parquet(f"{path}/rows").withColumns({c: F.col(c).cast("bigint") for c in ("rank", "step_range")})
    if rank is not None:
        rows = rows.filter(F.col("rank") == rank)
    if first_step and found:
        rows = rows.filter((F.col("step_range") >= first_step // found[0]) & (F.col("global_step") >= first_step))
    return rows


def last_steps(spark: SparkSession, path: str) -> DataFrame:
    """``(rank, last_step, rows)`` of a written feed, from its manifest."""
    return spark.read.parquet(f"{path}/manifest").groupBy("rank").agg(F.max("last_step").alias("last_step"), F.sum("rows").alias("rows"))
