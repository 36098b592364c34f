"""Shard, shuffle, batch and mixture queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelquilt.catalog.base import BATCH_SIZE, SEED, WORLD, query, sql_h60, sql_plan_main, sql_plan_side, table
from pixelquilt.operators import mixture as M
from pixelquilt.operators import sharding as S
from pixelquilt.plans import epochs as E
from pixelquilt.plans import feed

_SHARD_PLAN = sql_plan_main("plan", "documents", "doc_id", epochs=2)


def _keys(spark, d):
    return table(spark, d, "documents").select("doc_id")


@query(
    "shard_contiguous",
    f"""WITH {sql_plan_main('plan', 'documents', 'doc_id', world=7)} SELECT doc_id, o AS ord, rank,
 count(*) OVER (PARTITION BY rank) AS shard_rows FROM plan_o JOIN plan_s USING (doc_id)""",
)
def _contiguous(spark, d):
    return S.shard_contiguous(_keys(spark, d), "doc_id", 7)


@query(
    "shard_strided",
    """SELECT doc_id, o AS ord, o % 7 AS rank, count(*) OVER (PARTITION BY o % 7) AS shard_rows
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents)""",
)
def _strided(spark, d):
    return S.shard_strided(_keys(spark, d), "doc_id", 7)


_NAMED = "(SELECT 'page-' || page_id AS name FROM pages)"


@query(
    "shard_by_name",
    f"""WITH o AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS o, count(*) OVER () AS n FROM {_NAMED}),
s AS (SELECT name, o, n, o % 7 AS strided, CASE WHEN o < (n % 7) * (n // 7 + 1) THEN o // (n // 7 + 1) ELSE n % 7 + (o - (n % 7) * (n // 7 + 1)) // greatest(n // 7, 1) END AS contiguous FROM o)
SELECT name, contiguous, strided, p.o + p.extra AS padded_ord FROM s JOIN (SELECT name, o, unnest([0, n]) AS extra, n FROM o) p USING (name) WHERE p.extra = 0 OR p.o < (7 - p.n % 7) % 7""",
)
def _by_name(spark, d):
    """The three ways of sharding by a name, which is no number."""
    names = table(spark, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"))
    blocks = S.shard_contiguous(names, "name", 7).select("name", F.col("rank").alias("contiguous"))
    strides = S.shard_strided(names, "name", 7).select("name", F.col("rank").alias("strided"))
    padded = S.pad_stride_sample(names, "name", 7).select("name", F.col("ord").alias("padded_ord"))
    return blocks.join(strides, "name").join(padded, "name")


@query("seeded_shuffle", f"WITH {_SHARD_PLAN} SELECT doc_id, epoch, rank, ord FROM plan_p")
def _seeded(spark, d):
    expanded = S.epoch_expand(S.shard_contiguous(_keys(spark, d), "doc_id", WORLD), 2)
    shuffled = S.seeded_shuffle(expanded, "doc_id", SEED, ["epoch", "rank"], "epoch", groups=2 * WORLD)
    return shuffled.select("doc_id", "epoch", "rank", "ord")


@query(
    "buffer_shuffle",
    f"WITH {sql_plan_side('plan', 'documents', 'doc_id', epochs=2, buffer=100)} SELECT doc_id, epoch, rank, ord FROM plan_p",
)
def _buffered(spark, d):
    sharded = S.shard_strided(_keys(spark, d), "doc_id", WORLD)
    local = S.epoch_expand(sharded.withColumn("ord", F.floor(F.col("ord") / WORLD)), 2)
    moved = S.buffer_shuffle(local, "doc_id", SEED, ["epoch", "rank"], "epoch", buffer=100)
    return moved.select("doc_id", "epoch", "rank", "ord")


@query("assign_batches", f"WITH {_SHARD_PLAN} SELECT doc_id, epoch, rank, batch_id, pos FROM plan")
def _assign(spark, d):
    return E.plan_main(_keys(spark, d), "doc_id", WORLD, BATCH_SIZE, SEED, 2)


@query("epoch_expand", "SELECT doc_id, range AS epoch FROM documents, range(3)")
def _epoch_expand(spark, d):
    return S.epoch_expand(_keys(spark, d), 3)


# --- mixture: English documents lead, French and Spanish are the text stream, German the math stream ----

EPOCHS = 3
TEXT_N, MATH_N = 3, 5
_MAIN = "(SELECT * FROM documents WHERE lang = 'en')"
_TEXT = "(SELECT * FROM documents WHERE lang IN ('fr', 'es'))"
_MATH = "(SELECT * FROM documents WHERE lang = 'de')"


def _stream(spark, d, make, *langs):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return make(docs.filter(F.col("lang").isin(*langs)), "doc_id", WORLD, BATCH_SIZE, SEED, EPOCHS)


def main_stream(spark, d):
    return _stream(spark, d, E.main_plan, "en")


def text_stream(spark, d):
    return _stream(spark, d, E.side_plan, "fr", "es")


def feed_plans(spark, d):
    return main_stream(spark, d), text_stream(spark, d), _stream(spark, d, E.side_plan, "de")


SQL_STEPS = f"""{sql_plan_main('main', _MAIN, 'doc_id', epochs=EPOCHS)},
steps AS (SELECT epoch, rank, batch_id, epoch * b AS epoch_start, epoch * b + batch_id AS global_step FROM
 (SELECT DISTINCT epoch, rank, batch_id, count(*) OVER (PARTITION BY epoch, rank) // {BATCH_SIZE} AS b FROM main))"""


def sql_schedule(text_n, math_n):
    return f"""schedule AS (SELECT epoch, rank, global_step, 'main' AS kind, 0 AS kind_order, batch_id AS k FROM steps
 UNION ALL SELECT epoch, rank, global_step, 'text', 1, (global_step + 1) // {text_n} - epoch_start // {text_n} - 1 FROM steps
  WHERE (global_step + 1) % {text_n} = 0
 UNION ALL SELECT epoch, rank, global_step, 'math', 2, (global_step + 1) // {math_n} - epoch_start // {math_n} - 1 FROM steps
  WHERE (global_step + 1) % {math_n} = 0)"""


SQL_SIDES = f"""{sql_plan_side('txt', _TEXT, 'doc_id', epochs=EPOCHS)}, {sql_plan_side('mth', _MATH, 'doc_id', epochs=EPOCHS)}"""


def sql_cycle(kind, plan):
    return f"""SELECT s.epoch, s.rank, s.global_step, s.kind, s.kind_order, p.batch_id, p.pos, p.doc_id FROM
 (SELECT *, k % (SELECT count(DISTINCT batch_id) FROM {plan} q WHERE q.epoch = schedule.epoch AND q.rank = schedule.rank) AS b FROM schedule
  WHERE kind = '{kind}') s JOIN {plan} p ON p.epoch = s.epoch AND p.rank = s.rank AND p.batch_id = s.b"""


SQL_FEED = f"""SELECT s.epoch, s.rank, s.global_step, s.kind, s.kind_order, m.batch_id, m.pos, m.doc_id FROM schedule s
 JOIN main m ON m.epoch = s.epoch AND m.rank = s.rank AND m.batch_id = s.k WHERE s.kind = 'main'
UNION ALL {sql_cycle('text', 'txt')} UNION ALL {sql_cycle('math', 'mth')}"""


@query("mixture_schedule", f"WITH {SQL_STEPS}, {sql_schedule(10, 50)} SELECT * FROM schedule")
def _schedule(spark, d):
    schedule = M.mixture_schedule(feed.training_steps(main_stream(spark, d)))
    return schedule.select("epoch", "rank", "global_step", "kind", "kind_order", "k")


@query(
    "step_budget",
    f"WITH {SQL_STEPS} SELECT epoch, rank, batch_id, epoch_start, global_step FROM steps WHERE global_step < 25",
)
def _step_budget(spark, d):
    return S.step_budget(feed.training_steps(main_stream(spark, d)), 25)


@query("cycle_batches", f"WITH {SQL_STEPS}, {sql_schedule(TEXT_N, MATH_N)}, {SQL_SIDES} {sql_cycle('text', 'txt')}")
def _cycle(spark, d):
    text = text_stream(spark, d)
    schedule = M.mixture_schedule(feed.training_steps(main_stream(spark, d)), TEXT_N, MATH_N)
    return M.cycle_batches(schedule, text.rows, "text", groups=WORLD * EPOCHS)


@query("interleave", f"WITH {SQL_STEPS}, {sql_schedule(TEXT_N, MATH_N)}, {SQL_SIDES} {SQL_FEED}")
def _interleave(spark, d):
    main, text, math = feed_plans(spark, d)
    return feed.ordered_feed(main, text, math, text_every=TEXT_N, math_every=MATH_N)


@query(
    "mixed_loss",
    """SELECT event_id, CASE WHEN math IS NOT NULL THEN (lt + math) / 2 ELSE lt END AS loss FROM
(SELECT *, CASE WHEN text IS NOT NULL THEN (main + text) / 2 ELSE main END AS lt FROM
 (SELECT event_id, value AS main, CASE WHEN (event_id + 1) % 10 = 0 THEN value * 0.5::DOUBLE + 1 END AS text,
  CASE WHEN (event_id + 1) % 50 = 0 THEN value * 0.25::DOUBLE + 2 END AS math FROM events))""",
)
def _mixed_loss(spark, d):
    step, value = F.col("event_id") + 1, F.col("value")
    text = F.when(step % 10 == 0, value * 0.5 + 1)
    math = F.when(step % 50 == 0, value * 0.25 + 2)
    return table(spark, d, "events").select("event_id", M.mixed_loss(value, text, math).alias("loss"))


@query(
    "pad_stride_sample",
    """WITH o AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS o, count(*) OVER () AS n FROM supplier),
p AS (SELECT s_suppkey, o AS ord FROM o UNION ALL SELECT s_suppkey, o + n FROM o WHERE o < (7 - n % 7) % 7)
SELECT s_suppkey, ord, ord % 7 AS rank FROM p""",
)
def _pad_stride(spark, d):
    return S.pad_stride_sample(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 7)


@query(
    "size_weights",
    "SELECT source, count(*) AS n_rows, count(*)::DOUBLE / sum(count(*)) OVER () AS weight FROM documents GROUP BY source",
)
def _size_weights(spark, d):
    return M.size_weights(table(spark, d, "documents"), "source")


@query(
    "weighted_pick",
    f"""WITH w AS (SELECT source, floor(count(*)::DOUBLE / sum(count(*)) OVER () * {float(M.WEIGHT_UNITS)})::BIGINT AS units FROM documents GROUP BY source),
c AS (SELECT source, sum(units) OVER (ORDER BY source) AS hi, coalesce(sum(units) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM w),
u AS (SELECT event_id, floor({sql_h60(SEED, 'event_id')}::DOUBLE / {float(1 << 60)}::DOUBLE * (SELECT sum(units) FROM w)::DOUBLE)::BIGINT AS u FROM events)
SELECT event_id, source FROM u JOIN c ON u >= lo AND u < hi""",
)
def _weighted_pick(spark, d):
    weights = M.size_weights(table(spark, d, "documents"), "source")
    return M.weighted_pick(table(spark, d, "events").select("event_id"), weights, "source", SEED, "event_id")
