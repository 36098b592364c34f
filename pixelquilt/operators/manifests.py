"""Checkpoint manifests: which to remove, where to resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_step(path: Column) -> Column:
    return F.element_at(F.split(path, "_"), -1).cast("bigint")


def trailing_epoch(path: Column) -> Column:
    return F.element_at(F.split(path, "_"), -2).cast("bigint")


def keep_last_k(manifest: DataFrame, k: int, run: str = "run", path: str = "path") -> DataFrame:
    """The manifest rows to remove: per run, all but the ``k`` newest by the step in the name.

    The newest are found with a ranked limit, which Spark already applies before the exchange, so at most ``k``
    rows per run and task move. The rest follows by an anti join on the row's own key, which has no hot values.
    """
    numbered = manifest.withColumn("step", trailing_step(F.col(path)))
    newest = Window.partitionBy(run).orderBy(F.desc("step"), F.desc(path))
    kept = numbered.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= k)
    kept = kept.select(F.col(run).alias("_run"), F.col(path).alias("_path"))
    same = F.col(run).eqNullSafe(F.col("_run")) & F.col(path).eqNullSafe(F.col("_path"))
    return numbered.join(kept, same, "left_anti")


def latest_entry(manifest: DataFrame, run: str = "run", path: str = "path") -> DataFrame:
    """Per run the newest entry, the step to resume with and the epoch, all from the entry's name."""
    step = trailing_step(F.col(path))
    newest = manifest.groupBy(run).agg(F.max_by(F.col(path), F.struct(step, F.col(path))).alias(path))
    return newest.select(
        run,
        path,
        (trailing_step(F.col(path)) + 1).alias("resume_step"),
        trailing_epoch(F.col(path)).alias("resume_epoch"),
    )
