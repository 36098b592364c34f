"""Running averages, throughput and the metric record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquilt.operators.ordinals import BUCKET, order_cuts, running_sums, whole_keys


def running_meter(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    weight: Column | int = 1,
    prefix: str = "meter_",
    bucket: str | None = None,
) -> DataFrame:
    """The state of an average meter after each update: last value, sum, count, average.

    ``order`` is a number unique within the key, such as the step. Null values are not updates and leave the
    meter as it was.
    """
    weight = F.lit(weight) if isinstance(weight, int) else weight
    counted = F.when(value.isNotNull(), weight)
    summed = running_sums(
        df.withColumn(f"{prefix}val", value),
        keys,
        order,
        {f"{prefix}sum": (value * weight).cast("double"), f"{prefix}count": counted.cast("bigint")},
        bucket=bucket,
    )
    average = F.col(f"{prefix}sum") / F.nullif(F.col(f"{prefix}count"), F.lit(0))
    return summed.withColumn(f"{prefix}avg", average)


def meter_segments(
    df: DataFrame, keys: list[str], order: str, is_reset: Column, out: str = "segment", bucket: str | None = None
) -> DataFrame:
    """Number the stretches between resets. The resetting row still belongs to the stretch it ends."""
    flag = F.when(is_reset, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return running_sums(df, keys, order, {out: flag}, inclusive=False, bucket=bucket)


def meter_reset(
    df: DataFrame, keys: list[str], order: str, value: Column, is_reset: Column, weight: Column | int = 1
) -> DataFrame:
    """A running meter that starts again after every reset.

    Both running sums use the same cells of (key, bucket); the second adds the segment to them and needs no
    exchange of the rows again.
    """
    df, names, added = whole_keys(df, keys)
    cut = order_cuts(df, order).bucket(df, order)
    segmented = meter_segments(cut, names, order, is_reset, bucket=BUCKET)
    return running_meter(segmented, [*names, "segment"], order, value, weight, bucket=BUCKET).drop(BUCKET, *added)


def throughput(df: DataFrame, step_time: Column, batch_size: int, world: int, accumulation: int = 1) -> DataFrame:
    """Samples per second over all ranks and per rank, from the last step time.

    The step time covers one micro step while the numerator counts all accumulated ones; the formula is kept.
    """
    seconds = F.nullif(step_time, F.lit(0.0))
    return df.withColumn("samples_per_second", float(accumulation * batch_size * world) / seconds).withColumn(
        "samples_per_second_per_gpu", float(accumulation * batch_size) / seconds
    )


def metric_records(
    df: DataFrame,
    keys: list[str],
    step: str,
    data_time: Column,
    step_time: Column,
    is_logged: Column,
    lr: Column,
    loss: Column,
    batch_size: int,
    world: int,
    accumulation: int = 1,
) -> DataFrame:
    """One record per logged step: meter averages since the last log, throughput, rate and loss."""
    inputs = df.withColumns({"_dt": data_time, "_st": step_time, "_log": is_logged, "_lr": lr, "_loss": loss})
    segmented = meter_segments(inputs, keys, step, F.col("_log"))
    cells = [*keys, "segment"]
    # A stretch ends with its logged row, so the state after that row is the stretch's aggregate.
    logged = segmented.groupBy(*cells).agg(
        F.avg("_dt").alias("data_time"),
        F.avg("_st").alias("step_time"),
        F.max_by(F.struct("_st", "_lr", "_loss", "_log"), step).alias("_last"),
        F.max(step).alias("global_step"),
    ).filter(F.col("_last._log"))
    rated = throughput(logged, F.col("_last._st"), batch_size, world, accumulation)
    return rated.select(
        *keys,
        F.col("global_step").cast("bigint").alias("global_step"),
        "data_time",
        "step_time",
        "samples_per_second",
        "samples_per_second_per_gpu",
        F.col("_last._lr").alias("lr"),
        F.col("_last._loss").alias("loss"),
    )
