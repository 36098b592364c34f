"""Incremental and user-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelquilt.catalog.base import BATCH_SIZE, MAX_LENGTH, SEED, SQL, WORLD, digest, query, sql_caption, sql_clip, sql_digest, sql_ids, sql_labels, sql_plan_main, table
from pixelquilt.catalog.metrics import CENTS, cents
from pixelquilt.operators.batch_udfs import collate_batches, map_batches
from pixelquilt.plans.epochs import plan_main
from pixelquilt.session import scratch_path
from pixelquilt.sources.tables import stream_metric_log
from pixelquilt.streaming import meter, prompts

_RULES = {"hq": ["src1"], "text": ["src2", "src1"]}


@query(
    "stream_prompts",
    f"""WITH r AS (SELECT doc_id, 'hq' AS category, text FROM documents WHERE starts_with(source, 'src1')
 UNION ALL SELECT doc_id, 'text', text FROM documents WHERE starts_with(source, 'src2') OR starts_with(source, 'src1')),
e AS (SELECT doc_id, category, {sql_clip(sql_ids(sql_caption('text', 'doc_id')), MAX_LENGTH)} AS ids FROM r)
SELECT doc_id, category, {sql_digest('ids')} AS ids_md5, {sql_digest(sql_labels('ids'))} AS labels_md5 FROM e""",
)
def _stream_prompts(spark, d):
    schema = table(spark, d, "documents").schema
    arrivals = prompts.read_arrivals(spark, f"{d}/documents.parquet*", schema)
    path = scratch_path(spark, "prompts")
    prompts.drain_to_parquet(prompts.prompt_rows(arrivals, _RULES, "doc_id", "text", MAX_LENGTH, SEED), path, f"{path}-log")
    rows = spark.read.parquet(path)
    return rows.select(
        "doc_id", "category", digest(F.col("input_ids")).alias("ids_md5"), digest(F.col("labels")).alias("labels_md5")
    )


@query(
    "stream_meter",
    f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, (array_agg({CENTS} ORDER BY ts DESC, event_id DESC))[1] AS meter_val, sum({CENTS}) AS meter_sum,
 count(value) AS meter_count, avg({CENTS}) AS meter_avg FROM events GROUP BY 1, 2""",
)
def _stream_meter(spark, d):
    schema = table(spark, d, "events").schema
    arrivals = prompts.read_arrivals(spark, f"{d}/events.parquet*", schema)
    meters = meter.windowed_meter(arrivals, "event_type", "ts", cents(), "1 hour", "2 hours", "event_id")
    path = scratch_path(spark, "meters")
    meter.drain_updates(meters, path, f"{path}-log")
    latest = meter.latest_updates(spark, path, ["window_start", "event_type"])
    return latest.select(
        meter.utc_ntz(F.col("window_start")).alias("window_start"),
        "event_type",
        "meter_val",
        "meter_sum",
        "meter_count",
        "meter_avg",
    )


@query("stream_meter_reset", SQL["meter_reset"])
def _stream_meter_reset(spark, d):
    """The loop's meter over arriving events: a reset at each logged step, the order restored from the event numbers."""
    schema = table(spark, d, "events").schema
    path, closing = scratch_path(spark, "reset-meters"), scratch_path(spark, "closing")
    meter.closing_row(spark, schema, "event_id").limit(0).write.parquet(closing)

    def drain():
        arrivals = prompts.read_arrivals(spark, f"{d}/events.parquet*", schema).unionByName(prompts.read_arrivals(spark, closing, schema))
        meters = meter.stateful_meter(arrivals, "user_id", "event_id", cents(), F.col("event_type") == "error", 1000)
        stream_metric_log(meters, path, f"{path}-log")

    drain()
    meter.closing_row(spark, schema, "event_id").write.mode("append").parquet(closing)
    drain()
    return spark.read.parquet(path).drop("trigger")


def _with_chars(frame, column):
    return frame.assign(text_chars=frame[column].str.len()).drop(columns=[column])


@query("map_batches", "SELECT doc_id, length(text) AS text_chars FROM documents")
def _map_batches(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return map_batches(docs, _with_chars, "doc_id bigint, text_chars bigint", 64, column="text")


def _total_chars(frame, unit):
    return frame.assign(batch_chars=int(frame["n_chars"].sum()) * unit).drop(columns=["n_chars"])


@query(
    "collate_batches",
    f"""WITH {sql_plan_main('plan', 'documents', 'doc_id')} SELECT doc_id, epoch, rank, batch_id, pos,
 (sum(n_chars) OVER (PARTITION BY epoch, rank, batch_id))::BIGINT * 2 AS batch_chars FROM plan JOIN documents USING (doc_id)""",
)
def _collate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    rows = plan_main(docs, "doc_id", WORLD, BATCH_SIZE, SEED).join(docs, "doc_id")
    schema = "doc_id bigint, epoch bigint, rank bigint, batch_id bigint, pos bigint, batch_chars bigint"
    return collate_batches(rows, _total_chars, schema, unit=2)
