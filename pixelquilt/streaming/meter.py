"""Meters over a metric stream, with bounded state: per window, and as the training loop keeps them, with resets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _instant(stream: DataFrame, ts: str) -> Column:
    """Watermarks need an instant; a timestamp without zone is read as UTC, whatever the session's zone."""
    if not isinstance(stream.schema[ts].dataType, T.TimestampNTZType):
        return F.col(ts)
    origin = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", origin, F.col(ts)))


def utc_ntz(instant: Column) -> Column:
    """An instant as its UTC wall clock."""
    return F.convert_timezone(None, F.lit("UTC"), instant.cast("timestamp_ntz"))


def windowed_meter(stream: DataFrame, key: str, ts: str, value: Column, window: str, watermark: str, tie: str) -> DataFrame:
    """Last value, sum, count and average per key and tumbling window. ``tie`` orders updates of one instant."""
    timed = stream.withColumn("_ts", _instant(stream, ts)).withColumn("_v", value)
    grouped = timed.withWatermark("_ts", watermark).groupBy(F.window("_ts", window).alias("_w"), key)
    meters = grouped.agg(
        F.max_by("_v", F.struct("_ts", tie)).alias("meter_val"),
        F.sum("_v").alias("meter_sum"),
        F.count("_v").alias("meter_count"),
        F.avg("_v").alias("meter_avg"),
    )
    return meters.select(F.col("_w.start").alias("window_start"), key, "meter_val", "meter_sum", "meter_count", "meter_avg")


_STATE = "segment bigint, total double, n bigint, steps array<bigint>, vals array<double>, resets array<boolean>"


_ROW = ["step", "segment", "meter_val", "meter_sum", "meter_count", "meter_avg"]


def _meter_rows(held: tuple, upto: int) -> tuple[dict[str, np.ndarray], tuple]:
    """Meters of the waiting updates up to a step, in order, as columns, and what is left to wait."""
    segment, total, n, steps, values, resets = held
    step = np.array(steps, np.int64)
    order = np.argsort(step, kind="stable")
    count = int(np.searchsorted(step, upto, "right", sorter=order))
    ready, rest = order[:count].tolist(), order[count:].tolist()
    segments, totals, counts = [], [], []
    for i in ready:
        if values[i] is not None:
            total, n = total + values[i], n + 1
        segments.append(segment)
        totals.append(total)
        counts.append(n)
        if resets[i]:
            segment, total, n = segment + 1, 0.0, 0
    sums, updates = np.array(totals, np.float64), np.array(counts, np.int64)
    # Without updates there is no average.
    averages = np.divide(sums, updates, out=np.full(count, np.nan), where=updates > 0)
    columns = [step[order[:count]], np.array(segments, np.int64), np.array([values[i] for i in ready], np.float64), sums, updates, averages]
    return dict(zip(_ROW, columns)), (segment, total, n, [steps[i] for i in rest], [values[i] for i in rest], [resets[i] for i in rest])


def stateful_meter(stream: DataFrame, key: str, step: str, value: Column, is_reset: Column, lateness: int) -> DataFrame:
    """The running meter of each key, started again after every reset, over updates that arrive in any order.

    ``step`` numbers the updates of a key from 0, and is the clock (a step is a millisecond): an update may come up to ``lateness`` steps behind the newest
    one of any key. Until then later updates wait in the key's state; a timer lets them go when nothing earlier can
    come any more. So the state of a key is its sums and the updates of the last ``lateness`` steps, and results equal
    those of ``meter_reset`` over all updates that were not too late. Null values are not updates, but may reset. A
    stream that ends is closed by ``closing_row``.
    """
    updates = stream.select(
        F.col(key).alias("key"), F.col(step).cast("bigint").alias("step"), value.cast("double").alias("value"), F.coalesce(is_reset, F.lit(False)).alias("reset"), F.timestamp_millis(F.col(step).cast("bigint") + 1).alias("_ts")
    )
    kind = updates.schema["key"].dataType.simpleString()

    def advance(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        segment, total, n, steps, values, resets = state.get if state.exists else (0, 0.0, 0, [], [], [])
        held = [segment, total, n, list(steps), list(values), list(resets)]
        for frame in frames:
            held[3] += frame["step"].tolist()
            held[4] += [None if v != v else v for v in frame["value"].tolist()]
            held[5] += frame["reset"].tolist()
        rows, left = _meter_rows(tuple(held), state.getCurrentWatermarkMs() - 1)
        state.update(left)
        if left[3]:
            state.setTimeoutTimestamp(left[3][0] + 1)
        # A group with nothing to say costs no frame.
        if len(rows["step"]):
            yield pd.DataFrame({"key": [group[0]] * len(rows["step"]), **rows}, copy=False)

    timed = updates.withWatermark("_ts", f"{lateness} milliseconds").groupBy("key")
    schema = f"key {kind}, step bigint, segment bigint, meter_val double, meter_sum double, meter_count bigint, meter_avg double"
    meters = timed.applyInPandasWithState(advance, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return meters.filter(F.col("step") < CLOSING_STEP).withColumnsRenamed({"key": key, "step": step})


#: The step of a closing row; far behind all others, and still an instant.
CLOSING_STEP = 9_000_000_000_000


def closing_row(spark: SparkSession, schema: T.StructType, step: str) -> DataFrame:
    """The last row of a stream: it moves the clock past every waiting update, and has no meter of its own."""
    return spark.range(1).select(*[F.lit(CLOSING_STEP if f.name == step else None).cast(f.dataType).alias(f.name) for f in schema])


def drain_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each trigger's changed meters below ``path/trigger=<n>``; a repeated trigger overwrites its own."""

    def put(changed: DataFrame, trigger: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/trigger={trigger}")

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(put)
        .start()
    )
    query.awaitTermination()
    return query


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest state of every meter a drained stream has written."""
    updates = spark.read.parquet(path)
    values = [c for c in updates.columns if c not in (*keys, "trigger")]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "trigger").alias("_s"))
    return newest.select(*keys, "_s.*")
