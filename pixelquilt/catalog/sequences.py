"""Token-array queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelquilt import config as C
from pixelquilt.catalog.base import (
    BATCH_SIZE,
    DOC_SIZES,
    MAX_LENGTH,
    SEED,
    SQL_PATCHES,
    SQL_TEMPLATE,
    WORLD,
    digest,
    doc_sizes,
    doc_texts,
    length,
    query,
    sql_clip,
    sql_digest,
    sql_encode,
    sql_h60,
    sql_ids,
    sql_labels,
    sql_last_bos,
    sql_pad_left,
    sql_pad_right,
    sql_plan_main,
    sql_tokens,
    table,
)
from pixelquilt.functions import tokens as T
from pixelquilt.operators import batching as B
from pixelquilt.operators import vocab as V
from pixelquilt.operators.ordinals import keyed
from pixelquilt.plans.epochs import plan_main
from pixelquilt.session import scratch_path
from pixelquilt.sources.tables import cached_scan


def _docs(spark, d):
    return doc_texts(spark, d)


def _placed(spark, d, **lengths):
    """Texts at their places, with batch maxima of ``lengths``: these are found on narrow rows, and the text is the
    last to move. Arrays are made where it arrives."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    plan = plan_main(docs, "doc_id", WORLD, BATCH_SIZE, SEED)
    known = plan.join(docs.select("doc_id", *[n.alias(f"_own_{name}") for name, n in lengths.items()]), "doc_id")
    placed = B.with_batch_max(known, {name: F.col(f"_own_{name}") for name in lengths})
    return keyed(placed.drop(*[f"_own_{name}" for name in lengths]), "doc_id").join(docs, "doc_id")


def _placed_texts(spark, d):
    return _placed(spark, d, ids_len=T.text_length(F.col("text"), MAX_LENGTH)).withColumn("input_ids", T.encode_text(F.col("text"), MAX_LENGTH)).drop("text")


def _placed_images(spark, d):
    n = T.clipped_length(F.col("text"), MAX_LENGTH) + T.TEMPLATE_LENGTH
    return _image_rows(_placed(spark, d, ids_len=n, patch_len=T.reserved_length(n)))


_LENGTHS = {"ids_len": "ids_len", "patch_len": "patch_len", "patches": "image_patches_indices"}


_PLAN = sql_plan_main("plan", "documents", "doc_id")
_CLIP = sql_clip(sql_ids("text"), MAX_LENGTH)
_OVER = "OVER (PARTITION BY epoch, rank, batch_id)"
_INDEX = sql_pad_right(SQL_PATCHES, f"least(2098 + len(clip) + {C.RESERVED_GENERATION}, {C.MAX_POSITIONS})", -1)
_PAIR = f"SELECT *, list_concat({SQL_TEMPLATE}, clip) AS ids, {_INDEX} AS patches FROM (SELECT *, {_CLIP} AS clip FROM documents)"


@query("tokenize", f"SELECT doc_id, len(ids) AS n, {sql_digest('ids')} AS ids_md5 FROM (SELECT doc_id, {sql_ids('text')} AS ids FROM documents)")
def _tokenize(spark, d):
    rows = _docs(spark, d).select("doc_id", T.tokenize(F.col("text")).alias("ids"))
    return rows.select("doc_id", length(F.col("ids")).alias("n"), digest(F.col("ids")).alias("ids_md5"))


_VOCAB = f"""SELECT token, row_number() OVER (ORDER BY {sql_h60('token')}, token) - 1 AS id FROM
 (SELECT DISTINCT unnest({sql_tokens('text')}) AS token FROM documents)"""


def _coded(spark, d):
    """Texts tokenised and coded once, and the vocabulary that comes out of the codes."""
    words = _docs(spark, d).select("doc_id", T.text_tokens(F.col("text")).alias("tokens"))
    coded = cached_scan(V.coded_rows(words, "doc_id", "tokens"), scratch_path(spark, "coded"))
    return coded, V.build_coded_vocab(coded, "doc_id")


@query(
    "vocab_lookup",
    f"""WITH vocab AS ({_VOCAB}), words AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS token FROM
  (SELECT doc_id, {sql_tokens('text')} AS w FROM documents))
SELECT doc_id, count(*) AS n, md5(string_agg(id::VARCHAR, ' ' ORDER BY i)) AS ids_md5 FROM words JOIN vocab USING (token) GROUP BY doc_id""",
)
def _vocab_lookup(spark, d):
    coded, vocab = _coded(spark, d)
    found = V.placed(coded, "doc_id", vocab, "token", "id", "Token is not in the vocabulary: ")
    return found.select("doc_id", length(F.col("ids")).alias("n"), digest(F.col("ids")).alias("ids_md5"))


@query("decode_tokens", f"SELECT doc_id, md5(array_to_string({sql_tokens('text')}, ' ')) AS text_md5 FROM documents")
def _decode(spark, d):
    coded, vocab = _coded(spark, d)
    ids = V.placed(coded, "doc_id", vocab, "token", "id", "Token is not in the vocabulary: ")
    return V.decode_tokens(ids, "doc_id", "ids", vocab).select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "encode_text",
    f"""WITH {_PLAN}, enc AS (SELECT p.*, {sql_encode('text', MAX_LENGTH)} AS ids FROM plan p JOIN documents USING (doc_id)),
m AS (SELECT *, max(len(ids)) {_OVER} AS m FROM enc)
SELECT doc_id, m AS n, len(ids) AS n_real, {sql_digest(sql_pad_right('ids', 'm', C.PAD_ID))} AS ids_md5 FROM m""",
)
def _encode_text(spark, d):
    padded = B.pad_right(_placed_texts(spark, d), ids_len="ids_len")
    return padded.select(
        "doc_id",
        length(F.col("input_ids")).alias("n"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("n_real"),
        digest(F.col("input_ids")).alias("ids_md5"),
    )


@query(
    "clip_text",
    f"""SELECT doc_id, {sql_digest('a')} AS end_md5, {sql_digest('b')} AS answer_md5, len(a) AS n FROM
 (SELECT doc_id, {_CLIP} AS a, {sql_clip(sql_ids('text'), MAX_LENGTH, C.SPECIAL_IDS[C.END_HEADER])} AS b FROM documents)""",
)
def _clip_text(spark, d):
    ids = _docs(spark, d).select("doc_id", T.tokenize(F.col("text")).alias("ids"))
    both = ids.select("doc_id", T.clip_text(F.col("ids"), MAX_LENGTH).alias("a"), T.clip_text(F.col("ids"), MAX_LENGTH, True).alias("b"))
    return both.select("doc_id", digest(F.col("a")).alias("end_md5"), digest(F.col("b")).alias("answer_md5"), length(F.col("a")).alias("n"))


@query(
    "image_template",
    f"""SELECT doc_id, width, height, len(i) AS n, {sql_digest('i')} AS ids_md5, {sql_digest('p')} AS patches_md5
FROM ({DOC_SIZES}), (SELECT {SQL_TEMPLATE} AS i, {SQL_PATCHES} AS p)""",
)
def _image_template(spark, d):
    images = doc_sizes(table(spark, d, "documents"))
    return images.select(
        "*",
        length(T.template_ids()).alias("n"),
        digest(T.template_ids()).alias("ids_md5"),
        digest(T.template_patches()).alias("patches_md5"),
    )


@query(
    "sequence_plan",
    f"""SELECT doc_id, least(n + {C.RESERVED_GENERATION}, {C.MAX_POSITIONS}) AS target, n + {C.RESERVED_GENERATION} > {C.MAX_POSITIONS} AS over
FROM (SELECT doc_id, least(least(len({sql_tokens('text')}) + 2, {C.MAX_POSITIONS}) + 2098, {C.MAX_POSITIONS}) AS n FROM documents)""",
)
def _sequence_plan(spark, d):
    # Whole texts beside the image template, as far as the positions reach: the longest leave no room to generate.
    whole = T.text_length(F.col("text"), C.MAX_POSITIONS) + F.size(T.template_ids())
    lengths = _docs(spark, d).select("doc_id", F.least(whole, F.lit(C.MAX_POSITIONS)).alias("n"))
    plans = lengths.select("doc_id", T.sequence_plan(F.col("n")).alias("s"))
    return plans.select("doc_id", F.col("s.target").cast("bigint").alias("target"), "s.over")


@query(
    "encode_image_text",
    f"""SELECT doc_id, len(ids) AS n, len(patches) AS n_patches, {sql_digest('ids')} AS ids_md5, {sql_digest('patches')} AS patches_md5 FROM ({_PAIR})""",
)
def _encode_image_text(spark, d):
    return _arrays(_image_rows(_docs(spark, d)))


def _image_rows(rows):
    clipped = rows.withColumn("_clip", T.tokenize_clipped(F.col("text"), MAX_LENGTH)).drop("text")
    encoded = clipped.withColumn("input_ids", F.concat(T.template_ids(), F.col("_clip"))).drop("_clip")
    return encoded.withColumn("image_patches_indices", T.image_patch_indices(F.size("input_ids")))


def _arrays(rows, *extra):
    return rows.select(
        "doc_id",
        length(F.col("input_ids")).alias("n"),
        length(F.col("image_patches_indices")).alias("n_patches"),
        digest(F.col("input_ids")).alias("ids_md5"),
        digest(F.col("image_patches_indices")).alias("patches_md5"),
        *[digest(F.col(c)).alias(f"{c}_md5") for c in extra],
    )


_BATCHED = f"""WITH {_PLAN}, m AS (SELECT *, max(len(ids)) {_OVER} AS mi, max(len(patches)) {_OVER} AS mp
 FROM plan JOIN ({_PAIR}) USING (doc_id))"""
_ONES = "list_transform(ids, lambda x: 1)"


def padded_rows(spark, d):
    return B.pad_right(_placed_images(spark, d), **_LENGTHS)


@query(
    "pad_right",
    f"""{_BATCHED} SELECT doc_id, mi AS n, mp AS n_patches, {sql_digest(sql_pad_right('ids', 'mi', C.PAD_ID))} AS ids_md5,
 {sql_digest(sql_pad_right('patches', 'mp', -1))} AS patches_md5, {sql_digest(sql_pad_right(_ONES, 'mi', 0))} AS attention_mask_md5 FROM m""",
)
def _pad_right(spark, d):
    return _arrays(padded_rows(spark, d), "attention_mask")


_LEFT = f"""SELECT doc_id, {sql_pad_left('ids', 'mi', C.PAD_ID)} AS ids, {sql_pad_left('patches', 'mp', -1)} AS patches,
 {sql_pad_left(_ONES, 'mi', 0)} AS mask FROM m"""


@query(
    "pad_left",
    f"""{_BATCHED} SELECT doc_id, len(ids) AS n, len(patches) AS n_patches, {sql_digest('ids')} AS ids_md5,
 {sql_digest('patches')} AS patches_md5, {sql_digest('mask')} AS attention_mask_md5 FROM ({_LEFT})""",
)
def _pad_left(spark, d):
    padded = B.pad_left(_placed_images(spark, d), **_LENGTHS)
    return _arrays(padded, "attention_mask")


@query(
    "generation_trim",
    f"""{_BATCHED} SELECT doc_id, len(ids) - 1 AS n, len(patches) - 1 AS n_patches, {sql_digest('ids[1:len(ids) - 1]')} AS ids_md5,
 {sql_digest('patches[1:len(patches) - 1]')} AS patches_md5, {sql_digest('mask[1:len(mask) - 1]')} AS attention_mask_md5 FROM ({_LEFT})""",
)
def _generation_trim(spark, d):
    padded = B.pad_left(_placed_images(spark, d), **_LENGTHS)
    return _arrays(B.generation_trim(padded), "attention_mask")


@query(
    "label_mask",
    f"""SELECT conv_id, turn, {sql_digest(sql_labels('ids'))} AS labels_md5 FROM
 (SELECT conv_id, turn, {sql_ids('text')} AS ids FROM conversations)""",
)
def _label_mask(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.tokenize(F.col("text")).alias("ids"))
    return rows.select("conv_id", "turn", digest(T.label_mask(F.col("ids"))).alias("labels_md5"))


_DOUBLED = f"CASE WHEN lang = 'de' THEN text || ' {C.BEGIN_OF_TEXT} ' || lang ELSE text END"


@query(
    "replace_last_bos",
    f"""WITH e AS (SELECT doc_id, {sql_ids(_DOUBLED)} AS ids FROM documents), l AS (SELECT *, {sql_labels('ids')} AS labels FROM e)
SELECT doc_id, {sql_digest(sql_last_bos('ids', 'ids'))} AS ids_md5, {sql_digest(sql_last_bos('ids', 'labels'))} AS labels_md5 FROM l""",
)
def _replace_last_bos(spark, d):
    doubled = F.when(F.col("lang") == "de", F.concat("text", F.lit(f" {C.BEGIN_OF_TEXT} "), "lang")).otherwise(F.col("text"))
    rows = doc_texts(spark, d, "lang").select("doc_id", T.tokenize(doubled).alias("input_ids"))
    fixed = B.replace_last_bos(B.with_labels(rows))
    return fixed.select("doc_id", digest(F.col("input_ids")).alias("ids_md5"), digest(F.col("labels")).alias("labels_md5"))


_KEPT = "list_filter(ids, lambda x: x <> 128001)"


@query(
    "drop_token",
    f"""WITH {_PLAN}, e AS (SELECT p.*, {sql_encode('text', MAX_LENGTH)} AS ids FROM plan p JOIN documents USING (doc_id)),
k AS (SELECT *, {_KEPT} AS kept FROM e), m AS (SELECT *, max(len(kept)) {_OVER} AS m FROM k)
SELECT doc_id, m AS n, {sql_digest(sql_pad_right('kept', 'm', C.PAD_ID))} AS ids_md5,
 {sql_digest(sql_pad_right(f'list_prepend({C.IGNORED_LABEL}, kept[2:])', 'm', C.IGNORED_LABEL))} AS labels_md5,
 {sql_digest(sql_pad_right('list_transform(kept, lambda x: 1)', 'm', 0))} AS mask_md5 FROM m""",
)
def _drop_token(spark, d):
    ids = T.encode_text(F.col("text"), MAX_LENGTH)
    kept = F.size(F.filter(ids, lambda x: x != C.EOS_ID))
    rows = _placed(spark, d, ids_len=T.text_length(F.col("text"), MAX_LENGTH), kept_len=kept).withColumn("input_ids", ids).drop("text")
    dropped = B.drop_token(B.with_labels(B.pad_right(rows, ids_len="ids_len")), C.EOS_ID, kept_len="kept_len")
    return dropped.select(
        "doc_id",
        length(F.col("input_ids")).alias("n"),
        digest(F.col("input_ids")).alias("ids_md5"),
        digest(F.col("labels")).alias("labels_md5"),
        digest(F.col("attention_mask")).alias("mask_md5"),
    )


@query(
    "position_ids",
    f"""WITH {_PLAN}, e AS (SELECT p.*, {sql_encode('text', MAX_LENGTH)} AS ids FROM plan p JOIN documents USING (doc_id)),
m AS (SELECT *, max(len(ids)) {_OVER} AS m FROM e),
long AS (SELECT doc_id, unnest(range(m)) AS i, unnest({sql_pad_left(_ONES, 'm', 0)}) AS k FROM m),
c AS (SELECT doc_id, i, CASE WHEN k = 0 THEN 1 ELSE sum(k) OVER (PARTITION BY doc_id ORDER BY i) - 1 END AS p FROM long)
SELECT doc_id, md5(string_agg(p::BIGINT::VARCHAR, ' ' ORDER BY i)) AS positions_md5, max_by(p, i)::BIGINT AS last FROM c GROUP BY doc_id""",
)
def _position_ids(spark, d):
    masks = B.pad_left(_placed_texts(spark, d), ids_len="ids_len").select("doc_id", "attention_mask")
    last = F.element_at(T.position_ids(F.col("attention_mask"), True), 1).cast("bigint")
    return masks.select("doc_id", digest(T.position_ids(F.col("attention_mask"))).alias("positions_md5"), last.alias("last"))


@query(
    "pair_inputs",
    """SELECT batch_id, pos, doc_id, page_id FROM (SELECT doc_id, doc_id // 4 AS batch_id, doc_id % 4 AS pos FROM documents)
JOIN (SELECT page_id, page_id // 3 AS batch_id, page_id % 3 AS pos FROM pages) USING (batch_id, pos)""",
)
def _pair_inputs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("batch_id"), (F.col("doc_id") % 4).alias("pos"))
    pages = table(spark, d, "pages").select("page_id", F.floor(F.col("page_id") / 3).alias("batch_id"), (F.col("page_id") % 3).alias("pos"))
    return B.pair_inputs(docs, pages)


@query(
    "batch_max_len",
    f"""WITH {_PLAN} SELECT epoch, rank, batch_id, max(least(len({sql_tokens('text')}) + 2, {MAX_LENGTH})) AS batch_len
FROM plan JOIN documents USING (doc_id) GROUP BY ALL""",
)
def _batch_max_len(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    lengths = docs.select("doc_id", T.text_length(F.col("text"), MAX_LENGTH).cast("bigint").alias("n"))
    return B.batch_max_len(plan_main(docs, "doc_id", WORLD, BATCH_SIZE, SEED).join(lengths, "doc_id"), F.col("n"))
