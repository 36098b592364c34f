"""Whole jobs, composed from the single steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelquilt import config as C
from pixelquilt.catalog.base import (
    BATCH_SIZE,
    DOC_USABLE,
    MAX_LENGTH,
    PAGE_IMAGE_URL,
    SEED,
    SQL_PATCHES,
    SQL_TEMPLATE,
    WORLD,
    digest,
    doc_usable,
    length,
    page_image_url,
    query,
    sql_caption,
    sql_clip,
    sql_digest,
    sql_encode,
    sql_ids,
    sql_labels,
    sql_last_bos,
    sql_pad_left,
    sql_pad_right,
    sql_plan_main,
    table,
)
from pixelquilt.catalog.sharding import MATH_N, SQL_FEED, SQL_SIDES, SQL_STEPS, TEXT_N, feed_plans, sql_schedule
from pixelquilt.functions.prompts import caption_prompt, inference_prompt, resolve_image_ref
from pixelquilt.functions.tokens import text_tokens
from pixelquilt.operators.batching import BATCH
from pixelquilt.operators.vocab import build_coded_vocab, coded_rows, placed
from pixelquilt.plans import encode, feed
from pixelquilt.plans.epochs import plan_main, plan_validation
from pixelquilt.plans.ingest import ingest
from pixelquilt.plans.postprocess import clean_outputs
from pixelquilt.session import scratch_path
from pixelquilt.sources.tables import cached_scan, drop_columns, scan_file_list

_OVER = f"OVER (PARTITION BY {', '.join(BATCH)})"
_OVER_FEED = f"OVER (PARTITION BY {', '.join(feed.FEED_BATCH)})"


@query(
    "ingest_samples",
    f"""WITH s AS (SELECT page_id, {PAGE_IMAGE_URL} AS u, regexp_extract(url, '/(en|fr|de|es)/', 1) AS source FROM pages),
r AS (SELECT *, 'hq' AS category FROM s WHERE starts_with(source, 'e') UNION ALL SELECT *, 'text' FROM s WHERE starts_with(source, 'fr') OR starts_with(source, 'es')),
p AS (SELECT page_id, category, CASE WHEN category <> 'hq' THEN source END AS source, u IS NOT NULL AND trim(u, ' ' || chr(9)) <> '' AS has_image,
 CASE WHEN trim(u, ' ' || chr(9)) = '' THEN NULL WHEN u LIKE '/%' THEN u ELSE '/images/' || u END AS image_path FROM r)
SELECT *, CASE WHEN length(image_path) % 3 > 0 THEN 50 + length(image_path) * 37 ELSE -1 END AS width, CASE WHEN length(image_path) % 3 > 0 THEN 50 + length(image_path) * 91 ELSE -1 END AS height FROM p""",
)
def _ingest(spark, d):
    """Samples with the sizes of their images, from a table that has them for two of three paths."""
    pages = table(spark, d, "pages")
    source = F.regexp_extract("url", "/(en|fr|de|es)/", 1)
    samples = pages.select("page_id", page_image_url(F.col("url")).alias("image_url"), source.alias("source"))
    long = F.length("path").cast("bigint")
    paths = samples.select(resolve_image_ref(F.col("image_url"), "/images").alias("path")).filter("path IS NOT NULL").distinct()
    sizes = paths.filter(long % 3 > 0).select("path", (50 + long * 37).alias("width"), (50 + long * 91).alias("height"))
    return ingest(samples, {"hq": ["e"], "text": ["fr", "es"], "math": []}, "/images", sizes).drop("image_url").fillna(-1, ["width", "height"])


_MIXED_ROWS = f"""q AS (SELECT doc_id, {DOC_USABLE} AS usable, {sql_caption('text', 'doc_id')} AS prompt FROM documents),
g AS (SELECT p.*, prompt, bool_and(usable) {_OVER} AS img FROM plan p JOIN q USING (doc_id)),
e AS (SELECT *, CASE WHEN img THEN list_concat({SQL_TEMPLATE}, {sql_clip(sql_ids('prompt'), MAX_LENGTH)}) ELSE {sql_encode('prompt', MAX_LENGTH)} END AS ids FROM g),
m AS (SELECT *, max(len(ids)) {_OVER} AS m FROM e),
x AS (SELECT * EXCLUDE (ids), {sql_pad_right('ids', 'm', C.PAD_ID)} AS ids,
 CASE WHEN img THEN {sql_pad_right(SQL_PATCHES, f'least(m + 10, {C.MAX_POSITIONS})', -1)} END AS patches, len(ids) AS n_real FROM m),
l AS (SELECT *, {sql_labels('ids')} AS labels FROM x)
SELECT doc_id, epoch, rank, batch_id, pos, img AS has_images, m AS n, n_real, {sql_digest(sql_last_bos('ids', 'ids'))} AS ids_md5,
 {sql_digest(sql_last_bos('ids', 'labels'))} AS labels_md5, {sql_digest('patches')} AS patches_md5 FROM l"""


def image_rows(spark, d):
    """Captions to padded, labelled rows; batches keep their images where every row has one."""
    docs = table(spark, d, "documents")
    samples = docs.select("doc_id", "source", caption_prompt(F.col("text"), F.col("doc_id"), SEED).alias("prompt"))
    plan = plan_main(samples, "doc_id", WORLD, BATCH_SIZE, SEED)
    return encode.encode_training_batches(samples, plan, "doc_id", "prompt", doc_usable(), MAX_LENGTH)


@query("image_training_batches", f"WITH {sql_plan_main('plan', 'documents', 'doc_id')}, {_MIXED_ROWS}")
def _image_batches(spark, d):
    return _mixed_digests(image_rows(spark, d))


@query(
    "validation_batches",
    f"""WITH plan AS (SELECT doc_id, 0::BIGINT AS epoch, o % {WORLD} AS rank, o // {WORLD} AS batch_id, 0::BIGINT AS pos
 FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents)), {_MIXED_ROWS}""",
)
def _validation_batches(spark, d):
    """The validation path: a list of files, strided over the ranks in order, one row a batch, columns dropped."""
    files = scan_file_list(spark, f"{d}/documents.parquet", table(spark, d, "documents").schema)
    usable = files.withColumn("usable", doc_usable())
    samples = drop_columns(usable.withColumn("prompt", caption_prompt(F.col("text"), F.col("doc_id"), SEED)), "source", "text")
    plan = plan_validation(samples, "doc_id", WORLD)
    return _mixed_digests(encode.encode_training_batches(samples, plan, "doc_id", "prompt", F.col("usable"), MAX_LENGTH))


def _mixed_digests(rows):
    return rows.select(
        "doc_id",
        *BATCH,
        "pos",
        "has_images",
        length(F.col("input_ids")).alias("n"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("n_real"),
        digest(F.col("input_ids")).alias("ids_md5"),
        digest(F.col("labels")).alias("labels_md5"),
        digest(F.col("image_patches_indices")).alias("patches_md5"),
    )


def serving_rows(spark, d):
    """Questions to left-padded rows for generation."""
    docs = table(spark, d, "documents").select("doc_id", inference_prompt(F.col("text")).alias("prompt"))
    plan = plan_main(docs, "doc_id", WORLD, BATCH_SIZE, SEED)
    return encode.encode_serving_batches(docs, plan, "doc_id", "prompt", MAX_LENGTH)


_QUESTION = f"""'{C.START_HEADER}user{C.END_HEADER}' || chr(10) || chr(10) || text || '{C.END_OF_TURN}{C.START_HEADER}assistant{C.END_HEADER}'"""


@query(
    "serving_batches",
    f"""WITH {sql_plan_main('plan', 'documents', 'doc_id')},
e AS (SELECT p.*, list_concat({SQL_TEMPLATE}, {sql_clip(sql_ids(f'({_QUESTION})'), MAX_LENGTH)}) AS ids FROM plan p JOIN documents USING (doc_id)),
m AS (SELECT *, max(len(ids)) {_OVER} AS m, {sql_pad_right(SQL_PATCHES, 'len(ids) + 10', -1)} AS patches FROM e),
x AS (SELECT *, {sql_pad_left('ids', 'm', C.PAD_ID)} AS i, {sql_pad_left('patches', 'm + 10', -1)} AS pt,
 {sql_pad_left('list_transform(ids, lambda z: 1)', 'm', 0)} AS k FROM m)
SELECT doc_id, epoch, rank, batch_id, pos, m - 1 AS n, m + 9 AS n_patches, {sql_digest('i[1:m - 1]')} AS ids_md5,
 {sql_digest('pt[1:m + 9]')} AS patches_md5, {sql_digest('k[1:m - 1]')} AS mask_md5 FROM x""",
)
def _serving(spark, d):
    rows = serving_rows(spark, d)
    return rows.select(
        "doc_id",
        *BATCH,
        "pos",
        length(F.col("input_ids")).alias("n"),
        length(F.col("image_patches_indices")).alias("n_patches"),
        digest(F.col("input_ids")).alias("ids_md5"),
        digest(F.col("image_patches_indices")).alias("patches_md5"),
        digest(F.col("attention_mask")).alias("mask_md5"),
    )


def feed_rows(spark, d, arrange=None):
    """Three streams mixed by step, encoded: captions with their images where a whole main batch has them, the texts of
    the side streams as they are."""
    main, text, math = feed_plans(spark, d)
    rows = feed.plan_feed(main, text, math, text_every=TEXT_N, math_every=MATH_N)
    leads = F.col("lang") == "en"
    prompt = F.when(leads, caption_prompt(F.col("text"), F.col("doc_id"), SEED)).otherwise(F.col("text"))
    samples = table(spark, d, "documents").select("doc_id", "lang", "source", prompt.alias("prompt"))
    return encode.encode_training_batches(samples, rows, "doc_id", "prompt", leads & doc_usable(), MAX_LENGTH, feed.FEED_BATCH, arrange)


@query(
    "training_feed",
    f"""WITH {SQL_STEPS}, {sql_schedule(TEXT_N, MATH_N)}, {SQL_SIDES}, feed AS ({SQL_FEED}),
q AS (SELECT doc_id, lang = 'en' AND {DOC_USABLE} AS usable, CASE WHEN lang = 'en' THEN {sql_caption('text', 'doc_id')} ELSE text END AS prompt FROM documents),
g AS (SELECT f.*, prompt, bool_and(usable) {_OVER_FEED} AS img FROM feed f JOIN q USING (doc_id)),
e AS (SELECT *, CASE WHEN img THEN list_concat({SQL_TEMPLATE}, {sql_clip(sql_ids('prompt'), MAX_LENGTH)}) ELSE {sql_encode('prompt', MAX_LENGTH)} END AS ids FROM g),
m AS (SELECT *, max(len(ids)) {_OVER_FEED} AS m FROM e),
x AS (SELECT * EXCLUDE (ids), {sql_pad_right('ids', 'm', C.PAD_ID)} AS ids,
 CASE WHEN img THEN {sql_pad_right(SQL_PATCHES, f'least(m + 10, {C.MAX_POSITIONS})', -1)} END AS patches FROM m),
l AS (SELECT *, {sql_labels('ids')} AS labels FROM x)
SELECT epoch, rank, global_step, kind, batch_id, pos, doc_id, img AS has_images, m AS n, {sql_digest(sql_last_bos('ids', 'ids'))} AS ids_md5,
 {sql_digest(sql_last_bos('ids', 'labels'))} AS labels_md5, {sql_digest('patches')} AS patches_md5 FROM l""",
)
def _training_feed(spark, d):
    """Written by ranges of steps and read back from the first."""
    path = scratch_path(spark, "feed")
    feed.write_feed(feed_rows(spark, d, feed.arrange_feed), path)
    return feed.read_feed(spark, path).select(
        "epoch",
        "rank",
        "global_step",
        "kind",
        "batch_id",
        "pos",
        "doc_id",
        "has_images",
        length(F.col("input_ids")).alias("n"),
        digest(F.col("input_ids")).alias("ids_md5"),
        digest(F.col("labels")).alias("labels_md5"),
        digest(F.col("image_patches_indices")).alias("patches_md5"),
    )


@query(
    "clean_outputs",
    f"""WITH g AS (SELECT doc_id, regexp_extract_all(text, '{C.TOKEN_PATTERN}') AS words, CASE WHEN h <= th AND w <= tw THEN 1.0::DOUBLE
  ELSE least(th::DOUBLE / h, tw::DOUBLE / w) END AS s FROM (SELECT doc_id, text, 50 + doc_id * 91 % 1400 AS h, 50 + doc_id * 37 % 1900 AS w,
   200 + doc_id % 300 AS th, 300 + doc_id % 200 AS tw FROM documents))
SELECT doc_id, md5(array_to_string(list_concat([''], words[1:3], [' <box>' || concat_ws(', ', 2 * trunc((doc_id % 97) / s)::BIGINT,
 2 * trunc((doc_id % 61) / s)::BIGINT, 2 * trunc((doc_id % 89) / s)::BIGINT, 2 * trunc((doc_id % 53) / s)::BIGINT) || '</box>'], words[4:]), ' ')) AS text_md5 FROM g""",
)
def _clean_outputs(spark, d):
    k = F.col("doc_id")
    numbers = [(k % m).cast("string") for m in (97, 61, 89, 53)]
    span = F.array(F.lit(C.BOX_OPEN_TOKEN), *numbers, F.lit(C.BOX_CLOSE_TOKEN))
    words = text_tokens(F.col("text"))
    tokens = F.concat(F.array(F.lit(C.IMAGE_PLACEHOLDER)), F.slice(words, 1, 3), span, F.slice(words, 4, F.size(words)))
    outputs = table(spark, d, "documents").select(
        "doc_id", tokens.alias("tokens"), (50 + k * 91 % 1400).alias("height"), (50 + k * 37 % 1900).alias("width")
    )
    coded = cached_scan(coded_rows(outputs, "doc_id", "tokens"), scratch_path(spark, "coded"))
    vocab = build_coded_vocab(coded, "doc_id")
    ids = placed(coded, "doc_id", vocab, "token", "id", "Token is not in the vocabulary: ")
    generated = ids.join(outputs.drop("tokens"), "doc_id")
    sizes = outputs.select("doc_id", (200 + k % 300).alias("th"), (300 + k % 200).alias("tw"))
    cleaned = clean_outputs(generated, "doc_id", "ids", vocab, (336, 336), sizes)
    return cleaned.select("doc_id", F.md5("text").alias("text_md5"))
