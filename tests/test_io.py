"""Sources, sinks and streams."""

import random
import shutil
import struct

import pytest
from tests.paths import SF
from pyspark.sql import functions as F

from pixelquilt.catalog.intake import _write_pngs
from pixelquilt.operators import meters, mixture
from pixelquilt.operators.features import overlay_embeddings
from pixelquilt.operators.routing import parse_rules
from pixelquilt.plans import epochs, feed
from pixelquilt.plans.ingest import ingest
from pixelquilt.session import scratch_path
from pixelquilt.sources import buckets, images, tables
from pixelquilt.streaming import meter, prompts


def write(spark, path, data, schema="image_url string, conversations string, source string"):
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(path))


def one_file(spark, tmp_path, name, data):
    staging = tmp_path / "staging" / name
    write(spark, staging, data)
    part = next(p for p in staging.iterdir() if p.suffix == ".parquet")
    folder = tmp_path / "files"
    folder.mkdir(exist_ok=True)
    shutil.copy(part, folder / name)
    return folder


def test_scan_routed(spark, tmp_path):
    for name in ("cc3m_0.parquet", "cc3m_1.parquet", "textA.parquet", "other.parquet"):
        folder = one_file(spark, tmp_path, name, [(name, "chat", name[:4])])
    (folder / "cc3m_readme.txt").write_text("x")
    rules = parse_rules(hq="cc3m,cc", lq="", text="text,cc3m_1", math="nothing")
    found = tables.scan_routed(spark, str(folder), rules)
    got = {k: sorted(r["image_url"] for r in v.collect()) for k, v in found.items()}
    assert got == {
        "hq": ["cc3m_0.parquet", "cc3m_1.parquet"],
        "lq": [],
        "text": ["cc3m_1.parquet", "textA.parquet"],
        "math": [],
    }
    assert "text" in found["hq"].columns


def test_scan_is_not_recursive(spark, tmp_path):
    folder = one_file(spark, tmp_path, "a.parquet", [("u", "c", "s")])
    (folder / "deep").mkdir()
    shutil.copy(folder / "a.parquet", folder / "deep" / "b.parquet")
    assert tables.scan_samples(spark, str(folder)).count() == 1


def test_scan_routed_takes_names_literally(spark, tmp_path):
    for name in ("a{b.parquet", "ab.parquet", "a,c.parquet"):
        folder = one_file(spark, tmp_path, name, [(name, "chat", "s")])
    (folder / "deep").mkdir()
    shutil.copy(folder / "ab.parquet", folder / "deep" / "abc.parquet")
    found = tables.scan_routed(spark, str(folder), {"x": ["a{", "a,"], "y": ["ab"]})
    assert sorted(r["image_url"] for r in found["x"].collect()) == ["a,c.parquet", "a{b.parquet"]
    assert [r["image_url"] for r in found["y"].collect()] == ["ab.parquet"]


def test_row_order_over_files(spark, tmp_path):
    for name, n in (("b.parquet", 3), ("a.parquet", 2), ("c.parquet", 0), ("d.parquet", 2)):
        folder = one_file(spark, tmp_path, name, [(f"{name}{i}", "chat", "s") for i in range(n)])
    scan = tables.scan_samples(spark, str(folder))
    got = {r["row_order"]: r["image_url"] for r in tables.with_row_order(scan).collect()}
    expected = [f"{name}{i}" for name, n in (("a.parquet", 2), ("b.parquet", 3), ("d.parquet", 2)) for i in range(n)]
    assert got == dict(enumerate(expected))
    part = tables.with_row_order(scan.filter("image_url <> 'b.parquet1'").withColumn("_file", F.lit(1)))
    assert [r["image_url"] for r in part.orderBy("row_order").collect()] == [e for e in expected if e != "b.parquet1"]
    assert part.columns == [*scan.columns, "_file", "row_order"]


def _exchanged(plan):
    """Schemas of the rows that exchanges move."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    own = [plan.schema().simpleString()] if plan.nodeName() == "Exchange" else []
    children = plan.children()
    return own + [s for i in range(children.size()) for s in _exchanged(children.apply(i))]


@pytest.mark.parametrize("name", ["pad_right", "pad_left", "generation_trim", "encode_text", "drop_token", "position_ids"])
def test_no_exchange_moves_padded_arrays(spark, name):
    from pixelquilt.catalog import QUERIES

    moved = _exchanged(QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan())
    assert moved and not any("array<int>" in schema for schema in moved)


def test_write_samples_moves_texts_only(spark):
    from pixelquilt.catalog.intake import text_batches

    plan = text_batches(spark, SF, tables.arrange_batches)._jdf.queryExecution().executedPlan()
    assert not any("array<int>" in schema for schema in _exchanged(plan))


def test_spread_only_small_inputs(spark):
    docs = tables.scan_samples(spark, SF, None, "documents.parquet")
    assert tables.spread(docs, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, numPartitions=64)
    assert tables.spread(wide, "id") is wide


def test_scratch_path_uses_the_shared_folder(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert before is None or path.startswith(before)
    assert path != scratch_path(spark, "x")


def test_image_metadata_and_ingest(spark, tmp_path):
    import pandas as pd

    folder = tmp_path / "images"
    list(_write_pngs([pd.DataFrame({"doc_id": [1, 2], "width": [5, 7], "height": [6, 8]})], str(folder)))
    (folder / "broken.png").write_bytes(b"not an image")
    sizes = images.image_metadata(spark, str(folder))
    got = {(r["path"].rsplit("/", 1)[1], r["width"], r["height"]) for r in sizes.collect()}
    assert got == {("1.png", 5, 6), ("2.png", 7, 8)}
    samples = spark.createDataFrame([("1.png", "cc3m"), (" ", "cc3m"), ("gone.png", "text")], "image_url string, source string")
    rows = ingest(samples, {"hq": ["cc"], "text": ["t"]}, str(folder), sizes)
    found = {(r["category"], r["source"], r["has_image"], r["width"]) for r in rows.collect()}
    assert found == {("hq", None, True, 5), ("hq", None, False, None), ("text", "text", True, None)}


def test_a_path_on_half_of_the_rows_is_dealt_out(spark):
    samples = spark.range(20_000, numPartitions=4).select("id", F.when(F.col("id") % 2 == 0, F.lit("/hot.png")).when(F.col("id") % 4 == 1, F.format_string("/%d.png", F.col("id"))).alias("image_path"))
    sizes = spark.range(20_000).filter("id % 8 = 1").select(F.format_string("/%d.png", F.col("id")).alias("path"), F.col("id").alias("width"), F.lit(2).cast("bigint").alias("height"))
    sizes = sizes.unionByName(spark.createDataFrame([("/hot.png", 5, 6)], sizes.schema))
    assert images.shared_paths(samples, "image_path") == ["/hot.png"]
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = images.with_image_size(samples, sizes)
        per_task = [r["count"] for r in found.filter("image_path IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()]
        got = {r["id"]: (r["image_path"], r["width"], r["height"]) for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(per_task) < 2 * 15_000 / 8
    want = {i: ("/hot.png", 5, 6) if i % 2 == 0 else (f"/{i}.png", i if i % 8 == 1 else None, 2 if i % 8 == 1 else None) if i % 4 == 1 else (None, None, None) for i in range(20_000)}
    assert got == want


def test_sizes_come_from_headers():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 12, 34)
    bmp = b"BM" + bytes(16) + struct.pack("<ii", 5, -7)
    # A JPEG with an application segment and a table before its frame.
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + b"\xff\xc4" + struct.pack(">H", 4) + b"ab" + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 99, 77)
    assert [images.header_size(x) for x in (png, gif, bmp, jpeg)] == [(640, 480), (12, 34), (5, 7), (77, 99)]
    assert [images.header_size(x) for x in (b"", png[:20], b"\xff\xd8\xff", b"text")] == [None] * 4


def test_header_partitions_are_ranges_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(images, "FILES_PER_PARTITION", 3)
    for i in range(7):
        (tmp_path / f"{i}.gif").write_bytes(b"GIF89a" + struct.pack("<HH", i + 1, 9) + bytes(100))
    reader = images.HeaderReader([str(tmp_path)])
    parts = reader.partitions()
    assert [len(p.value[1]) for p in parts] == [3, 3, 1]
    assert sorted(size for p in parts for _, size, _ in reader.read(p)) == list(range(1, 8))


def test_write_samples_layout(spark, tmp_path):
    df = spark.range(64).select(
        (F.col("id") % 2).alias("epoch"), (F.col("id") % 4).alias("rank"), F.floor(F.col("id") / 8).alias("batch_id"), (F.col("id") % 8).alias("pos")
    )
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_samples(df, path, batches_per_file=1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = spark.read.parquet(path)
    assert back.count() == 64
    files = back.select(F.input_file_name().alias("f"), "epoch", "rank", "batch_id", "pos")
    # A batch is never split over files, and a rank is not one file.
    assert files.groupBy("epoch", "rank", "batch_id").agg(F.countDistinct("f").alias("n")).filter("n > 1").count() == 0
    assert files.select("f").distinct().count() > files.select("epoch", "rank").distinct().count()
    folder = next((tmp_path / "out").glob("epoch=*/rank=*"))
    for part in folder.glob("*.parquet"):
        order = [tuple(r) for r in spark.read.parquet(str(part)).select("batch_id", "pos").coalesce(1).collect()]
        assert order == sorted(order)


def test_metric_log_holds_a_trigger_once(spark, tmp_path):
    path = str(tmp_path / "log")
    put = lambda trigger, *rows: tables.metric_log(spark.createDataFrame(list(rows), "global_step long, loss double"), path, trigger)
    put(0, (1, 0.5), (2, 0.4))
    put(1, (3, 0.3))
    put(1, (3, 0.3))
    put(2)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, 0.5, 0), (2, 0.4, 0), (3, 0.3, 1)]


def test_streamed_records_are_logged_once_after_a_failure(spark, tmp_path, monkeypatch):
    landing, path, log = (str(tmp_path / n) for n in ("landing", "log", "checkpoint"))
    schema = "global_step long, loss double"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(landing)
        tables.stream_metric_log(spark.readStream.schema(schema).parquet(landing), path, log)

    arrive((1, 0.5), (2, 0.4))
    put = tables.metric_log

    def fails_after_writing(batch, path, trigger):
        put(batch, path, trigger)
        raise RuntimeError("lost")

    monkeypatch.setattr(tables, "metric_log", fails_after_writing)
    with pytest.raises(Exception, match="lost"):
        arrive((3, 0.3))
    assert spark.read.parquet(path).count() == 3
    monkeypatch.setattr(tables, "metric_log", put)
    arrive((4, 0.2))  # the failed trigger comes again, with its own rows
    assert sorted(r["global_step"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4]


def test_meter_rows_are_columns():
    """No frame for each key: columns of what is ready, and what waits."""
    held = (3, 5.0, 2, [4, 1, 9, 2, 6], [1.0, None, 7.0, 2.0, 8.0], [False, False, False, True, False])
    found, left = meter._meter_rows(held, 6)
    assert {c: v.tolist() for c, v in found.items() if c not in ("meter_val", "meter_avg")} == {
        "step": [1, 2, 4, 6], "segment": [3, 3, 4, 4], "meter_sum": [5.0, 7.0, 1.0, 9.0], "meter_count": [2, 3, 1, 2]
    }
    assert found["meter_avg"].tolist() == [2.5, 7 / 3, 1.0, 4.5] and str(found["meter_val"].tolist()) == "[nan, 2.0, 1.0, 8.0]"
    assert left == (4, 9.0, 2, [9], [7.0], [False])
    none, kept = meter._meter_rows(held, 0)
    assert not len(none["step"]) and kept[:3] == held[:3] and kept[3] == sorted(held[3])


def test_stateful_meter_equals_the_meter_with_resets(spark, tmp_path):
    """Updates out of order over many triggers; one far too late."""
    draw = random.Random(3)
    schema = "k string, step long, v double, logged boolean"
    rows = [(draw.choice(["a", "b", None]), step, draw.choice([None, float(draw.randint(0, 99))]), draw.random() < 0.1) for step in range(600)]
    arrivals = sorted(rows, key=lambda r: r[1] + draw.randint(0, 40))
    landing, out, log = (str(tmp_path / n) for n in ("landing", "out", "log"))

    def arrive(data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        tables.stream_metric_log(meter.stateful_meter(stream, "k", "step", F.col("v"), F.col("logged"), 50), out, log)

    for at in range(0, 600, 150):
        arrive(arrivals[at : at + 150])
    got = spark.read.parquet(out)
    # Meters of the newest steps wait for what may still come.
    assert 0 < got.count() < 600
    arrive([("a", 3, 1e6, True)])
    arrive([tuple(r) for r in meter.closing_row(spark, spark.createDataFrame([], schema).schema, "step").collect()])
    columns = ["k", "step", "segment", "meter_val", "meter_sum", "meter_count", "meter_avg"]
    want = meters.meter_reset(spark.createDataFrame(rows, schema), ["k"], "step", F.col("v"), F.col("logged"))
    assert sorted(map(tuple, spark.read.parquet(out).select(columns).collect()), key=repr) == sorted(map(tuple, want.select(columns).collect()), key=repr)


def test_waiting_updates_are_bounded():
    held = (0, 0.0, 0, [5, 3, 9, 8], [1.0, 2.0, None, 4.0], [False, True, False, False])
    rows, left = meter._meter_rows(held, 8)
    assert rows["step"].tolist() == [3, 5, 8] and rows["segment"].tolist() == [0, 1, 1] and rows["meter_sum"].tolist() == [2.0, 1.0, 5.0]
    assert left == (1, 5.0, 2, [9], [None], [False])


def test_stored_vectors_are_overlaid_where_they_lie(spark):
    words = spark.range(300).select(F.floor(F.col("id") / 10).alias("sample_id"), (F.col("id") % 10).alias("pos"), F.array(F.col("id").cast("double")).alias("vec"), F.when(F.col("id") % 3 > 0, F.col("id") % 10).otherwise(-1).alias("patch_idx"))
    patches = spark.range(300).select(F.floor(F.col("id") / 10).alias("sample_id"), (F.col("id") % 10).alias("patch_idx"), F.array(-F.col("id").cast("double")).alias("vec"))
    keys = ["sample_id", "patch_idx"]
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        overlaid = overlay_embeddings(buckets.stored_by(words, keys, "words"), buckets.stored_by(patches, keys, "patches"))
        assert "Exchange" not in overlaid._jdf.queryExecution().executedPlan().toString()
        got = {(r["sample_id"], r["pos"]): r["vec"] for r in overlaid.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(i // 10, i % 10): [float(-i if i % 3 else i)] for i in range(300)}


def test_cached_scan(spark, tmp_path):
    df = spark.range(5)
    assert tables.cached_scan(df, str(tmp_path / "kept")).count() == 5
    kept = tables.cached_scan(df)
    assert kept.storageLevel.useDisk and not kept.storageLevel.useMemory
    kept.unpersist()


RULES = {"hq": ["src1"], "text": ["src2", "src1"]}


def test_stream_equals_batch_over_two_arrivals(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    landing, out, log = (str(tmp_path / n) for n in ("landing", "out", "log"))

    def arrive(part):
        docs.filter(f"doc_id % 2 = {part}").coalesce(2).write.mode("append").parquet(landing)

    def drain():
        stream = prompts.read_arrivals(spark, landing, docs.schema, files_per_trigger=1)
        prompts.drain_to_parquet(prompts.prompt_rows(stream, RULES, "doc_id", "text", 512, 42), out, log)

    arrive(0)
    drain()
    half = spark.read.parquet(out).select("doc_id").distinct().count()
    arrive(1)
    drain()
    expected = prompts.prompt_rows(docs, RULES, "doc_id", "text", 512, 42)
    got = spark.read.parquet(out)
    assert 0 < half < got.select("doc_id").distinct().count()
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


def test_stream_meter_keeps_state_between_triggers(spark, tmp_path):
    landing, out, log = (str(tmp_path / n) for n in ("landing", "out", "log"))
    schema = "ts timestamp_ntz, k string, v double"

    def arrive(data):
        spark.createDataFrame(data, "t string, k string, v double").select(
            F.col("t").cast("timestamp_ntz").alias("ts"), "k", "v"
        ).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        meter.drain_updates(meter.windowed_meter(stream, "k", "ts", F.col("v"), "1 hour", "1 hour", "v"), out, log)

    arrive([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 3.0)])
    arrive([("2024-01-01 00:30:00", "a", 8.0), ("2024-01-01 01:10:00", "b", 5.0)])
    got = {(str(r["window_start"]), r["k"]): r for r in meter.latest_updates(spark, out, ["window_start", "k"]).collect()}
    first = got[("2024-01-01 00:00:00", "a")]
    assert (first["meter_val"], first["meter_sum"], first["meter_count"], first["meter_avg"]) == (8.0, 12.0, 3, 4.0)
    assert got[("2024-01-01 01:00:00", "b")]["meter_sum"] == 5.0


@pytest.mark.parametrize("name", ["assign_batches", "running_meter", "interleave", "overlay_embeddings"])
def test_no_cross_joins(spark, name):
    from pixelquilt.catalog import QUERIES

    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def feed_plans(spark, rows=150, world=3):
    keys = [spark.range(lo, lo + n).select(F.col("id").alias("k")) for lo, n in ((0, rows), (1000, 40), (2000, 30))]
    return [make(df, "k", world, 4, 7, 2) for make, df in zip((epochs.main_plan, epochs.side_plan, epochs.side_plan), keys)]


@pytest.mark.parametrize("rows", [150, 37, 13, 11, 0])
def test_steps_follow_from_the_numbers_of_a_plan(spark, rows):
    main = feed_plans(spark, rows)[0]
    planned = main.rows.select("epoch", "rank", "batch_id").distinct()
    assert sorted(map(tuple, main.steps().collect())) == sorted(map(tuple, planned.collect()))


def test_schedules_read_no_table(spark):
    schedule = mixture.mixture_schedule(feed.training_steps(feed_plans(spark)[0]))
    leaves = [n.nodeName() for n in leaves_of(schedule._jdf.queryExecution().optimizedPlan())]
    assert leaves == ["Range"] and schedule.count() > 0


def leaves_of(plan):
    children = plan.children()
    return [n for i in range(children.size()) for n in leaves_of(children.apply(i))] or [plan]


def test_a_written_feed_goes_on_at_any_step(spark, tmp_path):
    main, text, math = feed_plans(spark)
    planned = feed.plan_feed(main, text, math, text_every=3, math_every=5)
    path = str(tmp_path / "feed")
    feed.write_feed(feed.arrange_feed(planned, 4), path, 4)
    columns = ["rank", "global_step", "kind", "batch_id", "pos", "k"]
    whole = sorted(map(tuple, planned.select(columns).collect()))
    assert sorted(map(tuple, feed.read_feed(spark, path).select(columns).collect())) == whole
    for step in (1, 4, 7, 23, 999):
        resumed = feed.read_feed(spark, path, step)
        assert sorted(map(tuple, resumed.select(columns).collect())) == [r for r in whole if r[1] >= step]
        # Files of earlier ranges are not opened.
        assert all(int(f.split("step_range=")[1].split("/")[0]) >= step // 4 for f in resumed.select("_metadata.file_path").distinct().toPandas()["file_path"])
    one = feed.read_feed(spark, path, 7, rank=1)
    assert sorted(map(tuple, one.select(columns).collect())) == [r for r in whole if r[1] >= 7 and r[0] == 1]
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    assert sum(r["rows"] for r in manifest) == len(whole) and all(r["last_step"] - r["first_step"] < 4 for r in manifest)
    assert {r["rank"]: r["last_step"] for r in feed.last_steps(spark, path).collect()} == {r: max(w[1] for w in whole if w[0] == r) for r in range(3)}
    # A file holds its rows in the order in which they are taken.
    for r in manifest:
        held = [tuple(x) for x in spark.read.parquet(r["file"]).select("global_step", "kind_order", "pos").collect()]
        assert held == sorted(held)


def test_a_feed_without_steps_is_empty(spark, tmp_path):
    main, text, math = feed_plans(spark, 0)
    feed.write_feed(feed.arrange_feed(feed.plan_feed(main, text, math)), str(tmp_path / "none"))
    assert feed.read_feed(spark, str(tmp_path / "none"), 3).count() == 0
