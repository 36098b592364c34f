"""Meter, throughput, record and manifest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelquilt.catalog.base import query, table
from pixelquilt.operators import manifests, meters
from pixelquilt.session import scratch_path
from pixelquilt.sources.tables import metric_log


def cents(value="value"):
    """The values have two decimals; whole hundredths keep every sum exact, whatever the order of addition."""
    return F.round(F.col(value) * 100).cast("bigint").cast("double")


CENTS = "round(value * 100)"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", cents().alias("c"))


@query(
    "running_meter",
    f"""SELECT event_id, user_id, {CENTS} AS meter_val, sum({CENTS} * 2) OVER w AS meter_sum, count(*) OVER w * 2 AS meter_count,
 sum({CENTS} * 2) OVER w / (count(*) OVER w * 2) AS meter_avg
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def _running(spark, d):
    rows = _events(spark, d).select("event_id", "user_id", "c")
    return meters.running_meter(rows, ["user_id"], "event_id", F.col("c"), 2).drop("c")


_SEGMENTED = """seg AS (SELECT *, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM events)"""


@query(
    "meter_reset",
    f"""WITH {_SEGMENTED} SELECT event_id, user_id, segment, {CENTS} AS meter_val, sum({CENTS}) OVER w AS meter_sum,
 count(*) OVER w AS meter_count, sum({CENTS}) OVER w / count(*) OVER w AS meter_avg
FROM seg WINDOW w AS (PARTITION BY user_id, segment ORDER BY event_id)""",
)
def _reset(spark, d):
    metered = meters.meter_reset(_events(spark, d), ["user_id"], "event_id", F.col("c"), F.col("event_type") == "error")
    return metered.drop("value", "event_type", "c")


@query(
    "throughput",
    """SELECT event_id, 2 * 4 * 8 / nullif(value, 0) AS samples_per_second, 2 * 4 / nullif(value, 0) AS samples_per_second_per_gpu FROM events""",
)
def _throughput(spark, d):
    return meters.throughput(_events(spark, d).select("event_id", "value"), F.col("value"), 4, 8, 2).drop("value")


@query(
    "metric_log",
    f"""WITH {_SEGMENTED}, g AS (SELECT user_id, segment, avg({CENTS}) AS data_time, avg({CENTS} * 2) AS step_time, max(event_id) AS global_step,
 max_by({CENTS}, event_id) AS v, max_by(event_type, event_id) AS t FROM seg GROUP BY user_id, segment)
SELECT user_id, global_step, data_time, step_time,
 4 * 8 / nullif(v * 2, 0) AS samples_per_second, 4 / nullif(v * 2, 0) AS samples_per_second_per_gpu,
 0.0001::DOUBLE AS lr, v AS loss FROM g WHERE t = 'error'""",
)
def _metric_log(spark, d):
    records = meters.metric_records(
        _events(spark, d),
        ["user_id"],
        "event_id",
        data_time=F.col("c"),
        step_time=F.col("c") * 2,
        is_logged=F.col("event_type") == "error",
        lr=F.lit(1e-4),
        loss=F.col("c"),
        batch_size=4,
        world=8,
    )
    path = scratch_path(spark, "metrics")
    metric_log(records, path, 0)
    return spark.read.parquet(path).drop("trigger")


_MANIFEST = "SELECT o_custkey AS run, 'checkpoint_steps_' || (o_orderkey % 7) || '_' || o_orderkey AS path, o_orderkey AS step FROM orders"


def _manifest(spark, d):
    key = F.col("o_orderkey")
    path = F.concat(F.lit("checkpoint_steps_"), (key % 7).cast("string"), F.lit("_"), key.cast("string"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("run"), path.alias("path"))


@query(
    "keep_last_k",
    f"""SELECT run, path, step FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn FROM ({_MANIFEST})) WHERE rn > 3""",
)
def _keep_last_k(spark, d):
    return manifests.keep_last_k(_manifest(spark, d), 3)


@query(
    "latest_entry",
    f"""SELECT run, max_by(path, step) AS path, max(step) + 1 AS resume_step, max_by(step % 7, step) AS resume_epoch FROM ({_MANIFEST}) GROUP BY run""",
)
def _latest_entry(spark, d):
    return manifests.latest_entry(_manifest(spark, d))
