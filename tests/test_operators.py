"""Invariants, hot keys and errors of the table steps."""

import random

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pixelquilt import config as C
from pixelquilt.operators import batch_udfs, batching, features, manifests, meters, mixture, routing, sharding, vocab
from pixelquilt.operators.ordinals import bounded_broadcast, order_cuts, running_sums
from pixelquilt.plans import encode, epochs, feed, postprocess


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("n, world", [(10, 3), (9, 3), (2, 5), (0, 2), (1, 1)])
def test_shards_are_disjoint_and_complete(spark, n, world):
    df = spark.range(n).withColumnRenamed("id", "k")
    for shard in (sharding.shard_contiguous, sharding.shard_strided):
        got = shard(df, "k", world).collect()
        assert sorted(r["k"] for r in got) == list(range(n))
        sizes = {r: sum(x["rank"] == r for x in got) for r in range(world)}
        assert sum(sizes.values()) == n and max(sizes.values()) - min(sizes.values()) <= 1
        assert all(x["shard_rows"] == sizes[x["rank"]] for x in got)
        assert [sizes[r] for r in range(world)] == sorted(sizes.values(), reverse=True)


def test_clustered_ids_give_even_buckets(spark):
    # A third of the ids lies in a tiny range, the others are spread over the whole 60-bit space.
    dense = [5_000_000_000 + i for i in range(1000)]
    sparse = random.Random(1).sample(range(1 << 50), 2000)
    df = spark.createDataFrame([(i,) for i in dense + sparse], "k long")
    cut = order_cuts(df, "k", 64).bucket(df, "k", "b")
    sizes = [r["count"] for r in cut.groupBy("b").count().collect()]
    assert max(sizes) < 4 * 3000 / 64
    ordered = sorted(dense + sparse)
    got = {r["k"]: r["ord"] for r in sharding.shard_strided(df, "k", 3).collect()}
    # Cuts from a sample are as good: only evenness depends on them.
    sampled = order_cuts(spark.range(100_000).withColumnRenamed("id", "k"), "k", 64)
    assert sampled.rows == 100_000 and len(sampled.cuts) == 63
    assert got == {k: i for i, k in enumerate(ordered)}


def test_shuffle_is_a_permutation_and_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    seen = []
    for partitions in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            plan = epochs.plan_main(df.repartition(int(partitions)), "k", 3, 4, 42, 2)
            seen.append(rows(plan, "epoch", "rank", "batch_id", "pos", "k"))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1]
    first = [r[4] for r in seen[0] if r[:2] == (0, 0)]
    second = [r[4] for r in seen[0] if r[:2] == (1, 0)]
    assert first != second and first != sorted(first)
    assert set(first) | set(second) <= set(range(167))


def test_batches_are_full(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    got = epochs.plan_main(df, "k", 4, 5, 1).groupBy("rank", "batch_id").count().collect()
    assert {r["count"] for r in got} == {5} and len(got) == 4 * 5
    loose = sharding.assign_batches(sharding.shard_strided(df, "k", 1), 10, drop_last=False)
    assert loose.groupBy("batch_id").count().filter("count = 3").count() == 1
    counted = sharding.assign_batches(sharding.shard_strided(df, "k", 1), 10, ["rank"], groups=1)
    assert counted.count() == 100
    assert sharding.assign_batches(sharding.shard_strided(df, "k", 1), 10).count() == 100


def test_more_ranks_than_rows(spark):
    df = spark.range(3).withColumnRenamed("id", "k")
    assert epochs.plan_main(df, "k", 8, 1, 1).count() == 3
    assert epochs.plan_main(df, "k", 8, 2, 1).count() == 0


def test_buffer_shuffle_stays_near(spark):
    df = sharding.shard_strided(spark.range(1000).withColumnRenamed("id", "k"), "k", 1)
    got = sharding.buffer_shuffle(df, "k", 3, ["rank"], buffer=50).collect()
    assert sorted(r["ord"] for r in got) == list(range(1000))
    assert all(abs(r["ord"] - r["k"]) < 50 for r in got) and any(r["ord"] != r["k"] for r in got)


def test_pad_stride(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    got = rows(sharding.pad_stride_sample(df, "k", 4), "rank", "ord", "k")
    expected = sorted((i % 4, i, i % 10) for i in range(12))
    assert got == expected
    with pytest.raises(ValueError):
        sharding.pad_stride_sample(spark.range(2).withColumnRenamed("id", "k"), "k", 5)


def test_validation_plan(spark):
    plan = epochs.plan_validation(spark.range(7).withColumnRenamed("id", "k"), "k", 2)
    assert rows(plan, "k", "rank", "batch_id", "pos") == [(k, k % 2, k // 2, 0) for k in range(7)]


def test_broadcast_only_when_bounded(spark):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    small, big = spark.range(5), spark.range(9)
    assert "broadcast" in plan(big.join(bounded_broadcast(small, 5), "id"))
    assert "broadcast" not in plan(big.join(bounded_broadcast(small, C.BROADCAST_ROWS + 1), "id"))
    assert "broadcast" not in plan(big.join(bounded_broadcast(small, None), "id"))


def test_running_sums_with_a_hot_key(spark):
    data = [(i, 0 if i % 3 else i, float(i % 7)) for i in range(600)]
    df = spark.createDataFrame(data, "t long, k long, v double")
    got = {r["t"]: (r["s"], r["c"]) for r in running_sums(df, ["k"], "t", {"s": F.col("v"), "c": F.lit(1)}).collect()}
    totals: dict = {}
    for t, k, v in data:
        s, c = totals.get(k, (0.0, 0))
        totals[k] = (s + v, c + 1)
        assert got[t] == totals[k]


def test_meter_matches_a_plain_loop(spark):
    data = [(i, i % 2, float(i), i % 5 == 4) for i in range(50)]
    df = spark.createDataFrame(data, "t long, k long, v double, r boolean")
    got = {r["t"]: r for r in meters.meter_reset(df, ["k"], "t", F.col("v"), F.col("r")).collect()}
    state: dict = {}
    for t, k, v, r in data:
        s, c, seg = state.get(k, (0.0, 0, 0))
        s, c = s + v, c + 1
        row = got[t]
        assert (row["meter_val"], row["meter_sum"], row["meter_count"], row["meter_avg"], row["segment"]) == (v, s, c, s / c, seg)
        state[k] = (0.0, 0, seg + 1) if r else (s, c, seg)


def test_null_keys_are_groups_like_others(spark):
    data = [(i, None if i % 3 else 1, 1.0) for i in range(30)]
    df = spark.createDataFrame(data, "t long, k long, v double")
    for got in (
        meters.running_meter(df, ["k"], "t", F.col("v")),
        meters.meter_reset(df, ["k"], "t", F.col("v"), F.lit(False)),
    ):
        assert got.count() == 30
        assert {(r["k"], r["m"]) for r in got.groupBy("k").agg(F.max("meter_count").alias("m")).collect()} == {(None, 20), (1, 10)}
    shuffled = sharding.seeded_shuffle(df, "t", 1, ["k"])
    assert shuffled.filter("k IS NULL").count() == 20
    assert sharding.assign_batches(shuffled, 10, ["k"]).count() == 30
    runs = spark.createDataFrame([(None, f"c_0_{i}") for i in range(5)], "run string, path string")
    assert manifests.keep_last_k(runs, 2).count() == 3


def test_reset_meter_shares_its_exchange(spark):
    df = spark.range(100).select(F.col("id").alias("t"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    df = df.repartition(4)
    metered = meters.meter_reset(df, ["k"], "t", F.col("v"), F.col("t") % 7 == 0)
    plan = metered._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert metered.count() == 100 and len(windows) >= 4


def test_throughput_of_zero_time_is_null(spark):
    df = spark.createDataFrame([(0.0,), (2.0,)], "t double")
    got = meters.throughput(df, F.col("t"), 4, 8, 2).orderBy("t").collect()
    assert got[0]["samples_per_second"] is None
    assert (got[1]["samples_per_second"], got[1]["samples_per_second_per_gpu"]) == (32.0, 4.0)


def test_keep_last_k_with_a_hot_run(spark):
    data = [(0 if i % 3 else i, f"checkpoint_steps_0_{i}") for i in range(300)]
    df = spark.createDataFrame(data, "run long, path string")
    removed = manifests.keep_last_k(df, 2)
    kept = {}
    for run, path in data:
        kept.setdefault(run, []).append(path)
    expected = sorted((run, p) for run, paths in kept.items() for p in paths[:-2])
    assert rows(removed, "run", "path") == expected


def test_latest_entry(spark):
    df = spark.createDataFrame([("r", "out/checkpoint_steps_1_900"), ("r", "out/checkpoint_steps_2_1000")], "run string, path string")
    assert tuple(manifests.latest_entry(df).first()) == ("r", "out/checkpoint_steps_2_1000", 1001, 2)


def test_routing(spark):
    rules = routing.parse_rules(hq="cc3m,cc", lq="", text="cc3m", math="m")
    assert rules["lq"] == []
    df = spark.createDataFrame([(1, "cc3m_0"), (2, "ccx"), (3, "zzz"), (4, "m1")], "id long, source string")
    got = rows(routing.route_by_prefix(df, rules), "id", "category")
    assert got == [(1, "hq"), (1, "text"), (2, "hq"), (4, "math")]
    assert routing.route_by_prefix(df, {"hq": []}).count() == 0


def test_gate(spark):
    data = [(0, 0, 0, i, True) for i in range(3)] + [(0, 0, 1, i, i != 1) for i in range(3)]
    df = spark.createDataFrame(data, "epoch int, rank int, batch_id int, pos int, ok boolean")
    got = {(r["batch_id"], r["batch_has_images"]) for r in batching.batch_image_gate(df, F.col("ok")).collect()}
    assert got == {(0, True), (1, False)}


def test_pads_and_trim(spark):
    df = spark.createDataFrame([(0, 0, 0, [1, 2], [0, -1, -1]), (0, 0, 0, [3], [0, 1])], "epoch int, rank int, batch_id int, input_ids array<int>, p array<int>")
    right = rows(batching.pad_right(df, patches="p", pad_id=9), "input_ids", "attention_mask", "p")
    assert right == [([1, 2], [1, 1], [0, -1, -1]), ([3, 9], [1, 0], [0, 1, -1])]
    left = batching.pad_left(df, patches="p", pad_id=9)
    assert rows(left, "input_ids", "attention_mask", "p") == [([1, 2], [1, 1], [0, -1, -1]), ([9, 3], [0, 1], [-1, 0, 1])]
    trimmed = batching.generation_trim(left, ["input_ids", "p", "attention_mask"])
    assert rows(trimmed, "input_ids", "attention_mask", "p") == [([1], [1], [0, -1]), ([9], [0], [-1, 0])]


def test_drop_token(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, [5, 7, 5], [1, 2, 3], [1, 1, 1]), (0, 0, 0, [7, 7, 8], [4, 5, 6], [1, 1, 0])],
        "epoch int, rank int, batch_id int, input_ids array<int>, labels array<int>, attention_mask array<int>",
    )
    got = rows(batching.drop_token(df, 7, pad_id=0), "input_ids", "labels", "attention_mask")
    assert got == [([5, 5], [1, 3], [1, 1]), ([8, 0], [6, -100], [0, 0])]


def test_pairing(spark):
    prompts = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "batch_id int, pos int, prompt string")
    images = spark.createDataFrame([(0, 0, "x"), (0, 1, "y"), (0, 2, "z")], "batch_id int, pos int, image string")
    assert rows(batching.pair_inputs(prompts, images), "prompt", "image") == [("a", "x"), ("b", "y")]
    assert rows(batching.image_only_prompts(images), "prompt", "image") == [("", "x")]


def test_vocab_errors_and_empty_rows(spark):
    words = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "k int, tokens array<string>")
    table = spark.createDataFrame([("a", 10), ("b", 11)], "token string, id int")
    ids = vocab.vocab_lookup(words, "k", "tokens", table)
    assert rows(ids, "k", "ids") == [(1, [10, 11, 10]), (2, [])]
    assert rows(vocab.decode_tokens(ids, "k", "ids", table), "k", "text") == [(1, "a b a"), (2, "")]
    with pytest.raises(PySparkException):
        vocab.vocab_lookup(words, "k", "tokens", table.filter("id = 10")).collect()


def shuffled_rows(plan):
    """Rows that each exchange of an executed plan wrote."""
    found = [plan.metrics().apply("shuffleRecordsWritten").value()] if "ShuffleExchange" in plan.getClass().getSimpleName() else []
    children = plan.children()
    return found + [n for i in range(children.size()) for n in shuffled_rows(children.apply(i))]


@pytest.mark.parametrize("frequent", [0, 3, 8192])
def test_look_ups_move_distinct_tokens_once(spark, frequent):
    data = [(k, ["the", "a"] * 500 + [f"w{k}", None, f"w{k % 7}"] if k % 5 else []) for k in range(200)] + [(500, None)]
    words = spark.createDataFrame(data, "k int, tokens array<string>")
    distinct = sum(len({t for t in tokens or [] if t}) for _, tokens in data)
    coded = vocab.coded_rows(words, "k", "tokens")
    assert vocab.entry_rows(coded, "k", "token").count() == distinct
    stored = vocab.store_vocab(vocab.build_coded_vocab(coded, "k").table, frequent)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        looked = vocab.vocab_lookup(words, "k", "tokens", stored)
        ids = {r["k"]: r["ids"] for r in looked.collect()}
        moved = shuffled_rows(looked._jdf.queryExecution().executedPlan())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # Entries to the stored vocabulary (those not known as frequent) and back to their rows, and the rows themselves.
    assert len(moved) == 3 and max(moved) <= distinct and sum(moved) <= 2 * distinct + len(data)
    number = {r["token"]: r["id"] for r in stored.table.collect()}
    assert sorted(number.values()) == list(range(len(number)))
    assert ids == {k: [number.get(t) for t in tokens or []] for k, tokens in data}
    back = vocab.token_strings(looked, "k", "ids", stored)
    assert {r["k"]: r["tokens"] for r in back.collect()} == {k: tokens or [] for k, tokens in data}


def test_a_look_up_works_out_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    words = spark.createDataFrame([(k, ["the", f"w{k}", None, "the"]) for k in range(50)], "k int, tokens array<string>")
    stored = vocab.build_coded_vocab(vocab.coded_rows(words, "k", "tokens"), "k")
    number = {r["token"]: r["id"] for r in stored.table.collect()}
    ids = spark.createDataFrame([(k, [number["the"], None, number[f"w{k}"]]) for k in range(50)], "k int, ids array<int>")
    for held in (stored, vocab.store_vocab(stored.table, 1), stored.table):
        seen.value = 0
        found = vocab.decode_tokens(ids.mapInArrow(counted, ids.schema), "k", "ids", held)
        assert rows(found, "k", "text") == [(k, f"the w{k}") for k in range(50)]
        assert seen.value == 50


def test_partners_are_put_in_place(spark):
    words = spark.createDataFrame([(k, ["the"] * (k % 4) + [f"w{k % 9}", "a"]) for k in range(60)], "k int, tokens array<string>")
    stored = vocab.store_vocab(vocab.build_coded_vocab(vocab.coded_rows(words, "k", "tokens"), "k").table, 2)
    codes = pa.array([[0, 1, 0], [], [1, -1, 0, 2]], pa.list_(pa.int32())).slice(1)
    marked = vocab._marked_batch(codes, pa.array([["x", "y"], [], ["z", "x", "v"]]).slice(1), pa.array(["w", "x"]))
    assert [m.to_pylist() for m in marked[:3]] == [[[], [1, -1, -2, -3]], [0, 3], [0, 2]]
    found = pa.array([None, [9, 7]], pa.list_(pa.int64()))
    put = vocab._placed_batch(marked[0], marked[2], pa.array([None, [1, 0]], pa.list_(pa.int32())), found, pa.array([4, 5], pa.int64()))
    assert put.to_pylist() == [[], [5, None, 7, 9]]
    number = {r["token"]: r["id"] for r in stored.table.collect()}
    found = vocab.vocab_lookup(words, "k", "tokens", stored)
    assert {r["k"]: r["ids"] for r in found.collect()} == {r["k"]: [number[t] for t in r["tokens"]] for r in words.collect()}


def test_look_ups_want_unique_keys(spark):
    table = spark.createDataFrame([("a", 10), ("b", 11)], "token string, id int")
    for data in ([(1, ["a"]), (1, ["b"])], [(None, ["a"])]):
        with pytest.raises(PySparkException):
            vocab.vocab_lookup(spark.createDataFrame(data, "k int, tokens array<string>"), "k", "tokens", table).collect()


def test_look_ups_of_frequent_tokens_want_unique_keys_too(spark):
    stored = vocab.store_vocab(spark.createDataFrame([("a", 10, 2), ("b", 11, 2)], "token string, id int, uses long"))
    for data in ([(1, ["a"]), (1, ["b"])], [(None, ["a"])], [(1, ["a"]), (1, [])]):
        with pytest.raises(PySparkException):
            vocab.vocab_lookup(spark.createDataFrame(data, "k int, tokens array<string>"), "k", "tokens", stored).collect()
    alone = spark.createDataFrame([(1, []), (1, []), (None, []), (2, ["a", "b"])], "k int, tokens array<string>")
    assert [sorted(r["ids"]) for r in vocab.vocab_lookup(alone, "k", "tokens", stored).collect() if r["k"] == 2] == [[10, 11]]


def test_overlay(spark):
    words = spark.createDataFrame([(1, 0, [0.0], 1), (1, 1, [5.0], -1)], "sample_id int, pos int, vec array<double>, patch_idx int")
    patches = spark.createDataFrame([(1, 0, [8.0]), (1, 1, [9.0])], "sample_id int, patch_idx int, vec array<double>")
    assert rows(features.overlay_embeddings(words, patches), "pos", "vec") == [(0, [9.0]), (1, [5.0])]
    with pytest.raises(PySparkException):
        features.overlay_embeddings(words, patches.filter("patch_idx = 0")).collect()


def test_pooling_shape(spark):
    df = spark.range(2).select(F.col("id").alias("crop_id"), F.explode(F.sequence(F.lit(0), F.lit(576))).alias("pos"), F.lit(1).alias("image"))
    df = df.withColumn("vec", F.array(F.col("pos").cast("double")))
    got = features.grid_mean_pool(df, ["image"]).groupBy("crop_id").agg(F.count("*").alias("n"), F.max("pos").alias("m")).orderBy("crop_id").collect()
    assert [(r["n"], r["m"]) for r in got] == [(577, 576), (37, 36)]
    first = features.grid_mean_pool(df, ["image"]).filter("crop_id = 1 AND pos = 1").first()["vec"]
    cells = [1 + r * 24 + c for r in range(4) for c in range(4)]
    assert first == [sum(cells) / 16]
    with pytest.raises(ValueError):
        features.grid_mean_pool(df, ["image"], side=24, window=5)


def test_target_sizes(spark):
    outputs = spark.createDataFrame([(1,), (2,)], "k int")
    sizes = spark.createDataFrame([(1, 10, 20)], "k int, th int, tw int")
    assert rows(postprocess.with_target_sizes(outputs, None, "k", (3, 4)), "k", "th", "tw") == [(1, 3, 4), (2, 3, 4)]
    with pytest.raises(PySparkException):
        postprocess.with_target_sizes(outputs, sizes, "k", (3, 4)).collect()
    with pytest.raises(ValueError):
        postprocess.with_target_sizes(outputs, sizes.drop("tw"), "k", (3, 4))


# --- mixture ------------------------------------------------------------------------------------


def simulated_feed(world, main, text, math, total, text_every, math_every, epochs_, overlap):
    """Step a loader loop for one rank at a time; streams are numbers of batches."""
    out = set()
    for rank in range(world):
        start = 0
        for epoch in range(epochs_):
            draws = {"text": 0, "math": 0}
            step = start
            for i in range(main):
                step = start + i
                if step >= total:
                    break
                out.add((epoch, rank, step, "main", i))
                for kind, every, size in (("text", text_every, text), ("math", math_every, math)):
                    if size and (step + 1) % every == 0:
                        out.add((epoch, rank, step, kind, draws[kind] % size))
                        draws[kind] += 1
            start = step if overlap else start + main
    return out


@pytest.mark.parametrize("overlap", [False, True])
def test_feed_matches_a_simulated_loop(spark, overlap):
    world, epochs_ = 2, 3
    docs = lambda n: spark.range(n).withColumnRenamed("id", "k")
    main = epochs.main_plan(docs(52), "k", world, 2, 1, epochs_)
    text = epochs.side_plan(docs(9), "k", world, 2, 1, epochs_)
    math = epochs.side_plan(docs(13), "k", world, 2, 1, epochs_)
    planned = feed.ordered_feed(main, text, math, total_steps=30, text_every=3, math_every=5, overlap=overlap)
    got = {tuple(r) for r in planned.filter("pos = 0").select("epoch", "rank", "global_step", "kind", "batch_id").collect()}
    assert got == simulated_feed(world, 13, 2, 3, 30, 3, 5, epochs_, overlap)


def test_feed_without_side_streams(spark):
    docs = spark.range(20).withColumnRenamed("id", "k")
    main = epochs.main_plan(docs, "k", 1, 2, 1)
    empty = epochs.side_plan(docs.filter("k < 0"), "k", 1, 2, 1)
    assert feed.plan_feed(main, None, None).count() == 20
    assert feed.plan_feed(main, empty, None, text_every=2).count() == 20


def test_mixed_loss(spark):
    df = spark.createDataFrame([(4.0, None, None), (4.0, 2.0, None), (4.0, None, 2.0), (4.0, 2.0, 8.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(mixture.mixed_loss(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [4.0, 3.0, 3.0, 5.5]


def test_weighted_pick_follows_weights(spark):
    weights = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "source string, weight double")
    steps = spark.range(4000).withColumnRenamed("id", "step")
    counts = {r["source"]: r["count"] for r in mixture.weighted_pick(steps, weights, "source", 1, "step").groupBy("source").count().collect()}
    assert abs(counts["a"] / 4000 - 0.75) < 0.03 and sum(counts.values()) == 4000


# --- encoded batches ----------------------------------------------------------------------------


def test_encoded_batches_have_one_length(spark):
    samples = spark.range(40).select(
        F.col("id").alias("k"), F.repeat(F.lit("word "), F.col("id").cast("int")).alias("prompt"), (F.col("id") != 3).alias("ok")
    )
    plan = epochs.plan_main(samples, "k", 2, 4, 5)
    got = encode.encode_training_batches(samples, plan, "k", "prompt", F.col("ok"), 64).collect()
    assert len(got) == 40
    by_batch: dict = {}
    for r in got:
        by_batch.setdefault((r["rank"], r["batch_id"]), []).append(r)
    assert sum(not b[0]["has_images"] for b in by_batch.values()) == 1
    for batch in by_batch.values():
        assert len({(len(r["input_ids"]), len(r["attention_mask"]), len(r["labels"])) for r in batch}) == 1
        for r in batch:
            real = sum(r["attention_mask"])
            clip = min(r["k"] + 1, 31) + 1
            assert real == (2098 + clip if r["has_images"] else min(r["k"] + 2, 64))
            if r["has_images"]:
                assert len(r["image_patches_indices"]) == len(r["input_ids"]) + 10
            else:
                assert r["image_patches_indices"] is None


def test_serving_rows_drop_the_closing_id(spark):
    questions = spark.createDataFrame([(0, "a b c"), (1, "a")], "k long, prompt string")
    plan = epochs.plan_main(questions, "k", 1, 2, 5)
    got = {r["k"]: r for r in encode.encode_serving_batches(questions, plan, "k", "prompt", 64).collect()}
    assert len(got[0]["input_ids"]) == len(got[1]["input_ids"]) == 2098 + 4
    assert got[0]["input_ids"][-1] != C.EOS_ID
    assert sum(got[1]["attention_mask"]) == 2098 + 2 and got[1]["attention_mask"][0] == 0


# --- user functions -----------------------------------------------------------------------------


def test_map_batches_sizes(spark):
    import pandas as pd

    def sizes(frame, tag):
        return pd.DataFrame({"n": [len(frame)], "tag": [tag]})

    df = spark.range(0, 25, numPartitions=1)
    got = [r["n"] for r in batch_udfs.map_batches(df, sizes, "n long, tag string", 10, tag="x").collect()]
    assert got == [10, 10, 5]


def test_collating_crosses_to_python_by_blocks(spark):
    """Batches that straddle blocks of rows come whole; null keys are keys."""
    df = spark.range(3000, numPartitions=3).select((F.col("id") % 2).alias("epoch"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("rank"), F.floor(F.col("id") / 40).alias("batch_id"), F.col("id").alias("pos"))

    def summed(frame):
        assert frame["pos"].is_monotonic_increasing
        return frame.iloc[:1].assign(total=frame["pos"].sum(), n=len(frame)).drop(columns=["pos"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = batch_udfs.collate_batches(df, summed, "epoch long, rank long, batch_id long, total long, n long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = df.groupBy("epoch", "rank", "batch_id").agg(F.sum("pos").alias("total"), F.count("*").alias("n")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert batch_udfs.collate_batches(df.limit(0), summed, "epoch long, rank long, batch_id long, total long, n long").count() == 0


def test_draws_from_very_many_categories(spark):
    weights = spark.range(100_000).select(F.format_string("c%06d", F.col("id")).alias("source"), F.when(F.col("id") == 7, F.lit(0.5)).otherwise(F.lit(0.5 / 99_999)).alias("weight"))
    table, total, width = mixture.draw_table(weights, "source")
    cells = table.groupBy("_cell").count().agg(F.count("*").alias("cells"), F.sum("count").alias("rows"), F.max("count").alias("most")).first()
    assert cells["rows"] <= cells["cells"] + 100_000 and cells["most"] <= 4
    drawn = mixture.weighted_pick(spark.range(20_000).withColumnRenamed("id", "step"), weights, "source", 1, "step")
    assert drawn.count() == 20_000 and abs(drawn.filter("source = 'c000007'").count() - 10_000) < 400
    # Each draw lies among the units of its category.
    ranges = {r["source"]: (r["lo"], r["hi"]) for r in table.collect()}
    assert len(ranges) == 100_000 and sum(hi - lo for lo, hi in ranges.values()) == total
    assert mixture.weighted_pick(spark.range(5).withColumnRenamed("id", "step"), weights.limit(0), "source", 1, "step").count() == 0


@pytest.mark.parametrize("key", ["name", "day", "raw"])
def test_shards_by_any_type(spark, key):
    n = 5000
    forms = {"name": F.format_string("s3://bucket/part-%08d.jpg", (F.col("id") * 7919) % 100_003), "day": F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "raw": F.unhex(F.sha2(F.col("id").cast("string"), 256))}
    keys = spark.range(n).select(forms[key].alias("k"))
    cuts = order_cuts(keys, "k", 64)
    sizes = [r["count"] for r in cuts.bucket(keys, "k", "b").groupBy("b").count().collect()]
    assert cuts.rows == n and len(sizes) > 50 and max(sizes) < 5 * n / 64
    order = sorted(r["k"] for r in keys.collect())
    placed = {bytes(r["k"]) if key == "raw" else r["k"]: (r["ord"], r["rank"]) for r in sharding.shard_strided(keys, "k", 7).collect()}
    assert placed == {bytes(k) if key == "raw" else k: (i, i % 7) for i, k in enumerate(order)}
    blocks = [r["rank"] for r in sharding.shard_contiguous(keys, "k", 7).orderBy("k").collect()]
    assert blocks == sorted(blocks) and max(map(blocks.count, range(7))) - min(map(blocks.count, range(7))) <= 1
    assert sharding.pad_stride_sample(keys, "k", 7).count() == n + -n % 7


def test_a_dense_number_is_not_numbered_again(spark):
    rows = spark.range(100).withColumnRenamed("id", "row_order")
    again = epochs.plan_main(rows, "row_order", 4, 4, 42)
    ready = epochs.plan_main(rows, "row_order", 4, 4, 42, dense=True)
    assert sorted(map(tuple, ready.collect())) == sorted(map(tuple, again.collect()))
    assert sharding.contiguous(rows, "row_order", 4, dense=True)[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_collate_orders_rows(spark):
    def joined(frame, sep):
        head = frame.iloc[:1]
        return head[["epoch", "rank", "batch_id"]].assign(t=sep.join(frame["t"]))

    data = [(0, 0, 0, 1, "b"), (0, 0, 0, 0, "a"), (0, 0, 1, 0, "c")]
    df = spark.createDataFrame(data, "epoch long, rank long, batch_id long, pos long, t string")
    got = batch_udfs.collate_batches(df, joined, "epoch long, rank long, batch_id long, t string", sep="-")
    assert rows(got, "batch_id", "t") == [(0, "a-b"), (1, "c")]


def test_null_patch_index_keeps_the_word(spark):
    words = spark.createDataFrame([(1, 0, [1.0], None), (1, 1, [2.0], -1), (1, 2, [3.0], 0)], "sample_id int, pos int, vec array<double>, patch_idx int")
    patches = spark.createDataFrame([(1, 0, [9.0])], "sample_id int, patch_idx int, vec array<double>")
    got = features.overlay_embeddings(words, patches)
    assert rows(got, "pos", "vec") == [(0, [1.0]), (1, [2.0]), (2, [9.0])]


def test_null_turn_stays_in_the_chat(spark):
    from pixelquilt.plans.chats import render_chat

    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, None, "b")], "conv_id int, turn int, role string, text string")
    assert render_chat(turns).first()["conversations"].count(C.END_OF_TURN) == 3


@pytest.mark.parametrize("sizes", [[(1, 1, 1), (1, 2, 2), (2, 1, 1)], [(1, 1, 1), (2, 1, 1), (3, 1, 1)]])
def test_sizes_match_outputs_one_to_one(spark, sizes):
    outputs = spark.createDataFrame([(1,), (2,)], "k int")
    given = spark.createDataFrame(sizes, "k int, th int, tw int")
    with pytest.raises(Exception, match="one to one"):
        postprocess.with_target_sizes(outputs, given, "k", (3, 4)).collect()
