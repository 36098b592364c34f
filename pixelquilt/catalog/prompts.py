"""Prompt, chat, string and tag queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelquilt import config as C
from pixelquilt.catalog.base import (
    SEED,
    SQL_CHATS,
    digest,
    doc_texts,
    query,
    sql_caption,
    sql_digest,
    sql_ids,
    sql_token_id,
    sql_tokens,
    table,
)
from pixelquilt.functions import geometry, prompts, tags, tokens
from pixelquilt.plans import postprocess
from pixelquilt.plans.chats import render_chat


def _docs(spark, d, *columns):
    return table(spark, d, "documents").select("doc_id", *columns)


@query(
    "caption_prompt",
    f"SELECT doc_id, md5(p) AS prompt_md5, length(p) AS n FROM (SELECT doc_id, {sql_caption('text', 'doc_id')} AS p FROM documents)",
)
def _caption(spark, d):
    docs = _docs(spark, d, prompts.caption_prompt(F.col("text"), F.col("doc_id"), SEED).alias("p"))
    return docs.select("doc_id", F.md5("p").alias("prompt_md5"), F.length("p").cast("bigint").alias("n"))


@query(
    "conversation_prompt",
    f"""SELECT 'doc' AS kind, doc_id AS id, md5({sql_caption('text', 'doc_id')}) AS prompt_md5 FROM documents
UNION ALL SELECT 'chat', conv_id, md5(conversations) FROM ({SQL_CHATS})""",
)
def _conversation(spark, d):
    docs = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    chats = render_chat(table(spark, d, "conversations"))
    chats = chats.select(F.lit("chat").alias("kind"), F.col("conv_id").alias("id"), "conversations")
    both = docs.unionByName(chats, allowMissingColumns=True)
    prompt = prompts.conversation_prompt(F.col("text"), F.col("conversations"), F.col("id"), SEED)
    return both.select("kind", "id", F.md5(prompt).alias("prompt_md5"))


@query("render_chat", f"SELECT conv_id, md5(conversations) AS chat_md5, length(conversations) AS n FROM ({SQL_CHATS})")
def _render_chat(spark, d):
    chats = render_chat(table(spark, d, "conversations"))
    return chats.select(
        "conv_id", F.md5("conversations").alias("chat_md5"), F.length("conversations").cast("bigint").alias("n")
    )


@query(
    "inference_prompt",
    f"""SELECT item_id, '{C.START_HEADER}user{C.END_HEADER}' || chr(10) || chr(10) ||
 CASE WHEN length(text) % 2 = 0 THEN 'Answer briefly. ' ELSE '' END || text ||
 '{C.END_OF_TURN}{C.START_HEADER}assistant{C.END_HEADER}' AS prompt FROM benchmark""",
)
def _inference(spark, d):
    system = F.when(F.length("text") % 2 == 0, F.lit("Answer briefly."))
    return table(spark, d, "benchmark").select("item_id", prompts.inference_prompt(F.col("text"), system).alias("prompt"))


@query("append_end", f"SELECT doc_id, md5(text || '{C.END_OF_TEXT}') AS text_md5 FROM documents")
def _append_end(spark, d):
    return _docs(spark, d, F.md5(prompts.append_end(F.col("text"))).alias("text_md5"))


@query("strip_placeholders", "SELECT item_id, text FROM benchmark")
def _strip(spark, d):
    seeded = F.concat(
        F.lit(C.IMAGE_PLACEHOLDER * 3 + C.IMAGE_NEWLINE),
        F.replace("text", F.lit(" "), F.lit(C.IMAGE_NEWLINE + " ")),
        F.lit(C.IMAGE_PLACEHOLDER),
    )
    return table(spark, d, "benchmark").select("item_id", prompts.strip_placeholders(seeded).alias("text"))


@query(
    "truncate_middle",
    "SELECT page_id, CASE WHEN length(url) > 23 THEN substr(url, 1, 10) || '...' || right(url, 10) ELSE url END AS short FROM pages",
)
def _truncate(spark, d):
    return table(spark, d, "pages").select("page_id", prompts.truncate_middle(F.col("url")).alias("short"))


# --- tags --------------------------------------------------------------------------------------


def _tagged(spark, d):
    k = F.col("doc_id")
    box = F.concat_ws(", ", k % 97, k % 61, k % 389 + 100, k % 211 + 100)
    text = F.concat(
        F.lit("Find <box>"), box, F.lit("</box> and <point>"), k % 89, F.lit(", "), k % 53, F.lit("</point> in "), "text"
    )
    return doc_texts(spark, d).select("doc_id", text.alias("tagged"))


_TAGGED = """SELECT doc_id, 'Find <box>' || concat_ws(', ', doc_id % 97, doc_id % 61, doc_id % 389 + 100, doc_id % 211 + 100)
 || '</box> and <point>' || (doc_id % 89) || ', ' || (doc_id % 53) || '</point> in ' || text AS tagged FROM documents"""


def _sql_tags(text):
    for tag, token in tags.TAG_TOKENS.items():
        text = f"replace({text}, '{tag}', '{token}')"
    return text


_DELIMITERS = "[" + ", ".join(f"'{t}'" for t in tags.DELIMITERS) + "]"
_OPENING = "[" + ", ".join(f"'{t}'" for t in tags.OPENING) + "]"


def _sql_pieces(text):
    for token in tags.DELIMITERS:
        text = f"replace({text}, '{token}', chr(1) || '{token}' || chr(1))"
    return f"list_filter(string_split({text}, chr(1)), lambda p: p <> '')"


_SEGMENTS = f"""seg AS (SELECT doc_id, i, pieces[i] AS text, coalesce(list_contains({_OPENING}, pieces[i - 1]), false) AS is_location
 FROM (SELECT doc_id, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM
  (SELECT doc_id, {_sql_pieces(_sql_tags('tagged'))} AS pieces FROM ({_TAGGED})))
 WHERE NOT list_contains({_DELIMITERS}, pieces[i]))"""


@query("tags_to_tokens", f"SELECT doc_id, md5({_sql_tags('tagged')}) AS text_md5 FROM ({_TAGGED})")
def _tags_to_tokens(spark, d):
    return _tagged(spark, d).select("doc_id", F.md5(tags.tags_to_tokens(F.col("tagged"))).alias("text_md5"))


@query(
    "segment_tags",
    f"""WITH {_SEGMENTS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place,
 md5(text) AS text_md5, is_location FROM seg""",
)
def _segment(spark, d):
    segments = tags.segment_tags(tags.tags_to_tokens(F.col("tagged")))
    rows = _tagged(spark, d).select("doc_id", F.posexplode(segments).alias("place", "s"))
    return rows.select("doc_id", F.col("place").cast("bigint").alias("place"), F.md5("s.text").alias("text_md5"), "s.is_location")


def _sql_scaled(text, scale):
    numbers = f"list_transform(string_split({text}, ','), lambda x: round_even(trim(x)::DOUBLE / 2 * {scale}, 0)::BIGINT::VARCHAR)"
    return (
        f"CASE len(string_split({text}, ',')) "
        f"WHEN 2 THEN list_append(list_prepend('{C.POINT_OPEN_TOKEN}', {numbers}), '{C.POINT_CLOSE_TOKEN}') "
        f"WHEN 4 THEN list_append(list_prepend('{C.BOX_OPEN_TOKEN}', {numbers}), '{C.BOX_CLOSE_TOKEN}') END"
    )


@query(
    "scale_tags",
    f"""WITH {_SEGMENTS} SELECT doc_id, i - 1 AS place, array_to_string({_sql_scaled('text', 1.0)}, ' ') AS tokens
FROM seg WHERE is_location""",
)
def _scale(spark, d):
    rows = _tagged(spark, d).withColumn("parts", tags.segment_tags(tags.tags_to_tokens(F.col("tagged"))))
    # Places count the delimiters too, as in a split that keeps them: two for each location before, and its own first.
    before = lambda i: F.size(F.filter(F.slice("parts", 1, i), lambda s: s["is_location"]))
    numbered = F.transform("parts", lambda s, i: F.struct(s["text"].alias("text"), s["is_location"].alias("is_location"), (i + 2 * before(i) + 1).cast("bigint").alias("place")))
    rows = rows.select("doc_id", F.explode(numbered).alias("s")).filter("s.is_location")
    place = F.col("s.place")
    scaled = F.array_join(tags.scale_tags(F.col("s.text"), 1.0), " ")
    return rows.select("doc_id", place.alias("place"), scaled.alias("tokens"))


@query(
    "tokenize_tagged",
    f"""WITH {_SEGMENTS}, parts AS (SELECT doc_id, i, CASE WHEN is_location
  THEN list_transform({_sql_scaled('text', 0.75)}, lambda t: {sql_token_id('t')}) ELSE {sql_ids('text')} END AS ids FROM seg)
SELECT doc_id, len(ids) AS n, {sql_digest('ids')} AS ids_md5
FROM (SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids FROM parts GROUP BY doc_id)""",
)
def _tokenize_tagged(spark, d):
    rows = _tagged(spark, d).select("doc_id", tags.tokenize_tagged(F.col("tagged"), 0.75).alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n"), digest(F.col("ids")).alias("ids_md5"))


def _parts(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") * 20).alias("h"), (F.col("p_size") * 27).alias("w"), F.lit(512).alias("th"), F.lit(640).alias("tw")
    )


_PARTS = "SELECT p_partkey, p_size * 20 AS h, p_size * 27 AS w, 512 AS th, 640 AS tw FROM part"
_FIT = "CASE WHEN h <= th AND w <= tw THEN 1.0::DOUBLE ELSE least(th::DOUBLE / h, tw::DOUBLE / w) END"


@query("fit_scale", f"SELECT p_partkey, {_FIT} AS scale FROM ({_PARTS})")
def _fit_scale(spark, d):
    scale = geometry.fit_scale(*[F.col(c) for c in ("h", "w", "th", "tw")])
    return _parts(spark, d).select("p_partkey", scale.alias("scale"))


def _generated(spark, d, n, opening, closing):
    """Token arrays of every document with one good span behind its first words and broken ones at both ends."""
    k = F.col("doc_id")
    numbers = [k % 97, k % 61, k % 389 + 100, k % 211 + 100][:n]
    span = F.array(F.lit(opening), *[x.cast("string") for x in numbers], F.lit(closing))
    words = tokens.text_tokens(F.col("text"))
    spans = F.concat(
        F.array(F.lit(opening), F.lit("7"), F.lit(closing)),
        F.slice(words, 1, 3),
        span,
        F.slice(words, 4, F.size(words)),
        F.array(F.lit(opening), F.lit("5")),
    )
    return doc_texts(spark, d).select(
        "doc_id", spans.alias("tokens"), (50 + k * 91 % 1400).alias("h"), (50 + k * 37 % 1900).alias("w"), F.lit(336).alias("th"), F.lit(336).alias("tw")
    )


def _sql_generated(n, opening, closing, tag):
    numbers = ["doc_id % 97", "doc_id % 61", "doc_id % 389 + 100", "doc_id % 211 + 100"][:n]
    scaled = ", ".join(f"2 * trunc(({x})::DOUBLE / s)::BIGINT" for x in numbers)
    return f"""WITH g AS (SELECT doc_id, {sql_tokens('text')} AS words, {_FIT} AS s FROM
 (SELECT doc_id, text, 50 + doc_id * 91 % 1400 AS h, 50 + doc_id * 37 % 1900 AS w, 336 AS th, 336 AS tw FROM documents))
SELECT doc_id, md5(array_to_string(list_concat(['{opening}', '7', '{closing}'], words[1:3],
 [' <{tag}>' || concat_ws(', ', {scaled}) || '</{tag}>'], words[4:], ['{opening}', '5']), ' ')) AS tokens_md5 FROM g"""


@query("restore_boxes", _sql_generated(4, C.BOX_OPEN_TOKEN, C.BOX_CLOSE_TOKEN, "box"))
def _restore_boxes(spark, d):
    rows = _generated(spark, d, 4, C.BOX_OPEN_TOKEN, C.BOX_CLOSE_TOKEN)
    return rows.select("doc_id", digest(tags.restore_boxes(*[F.col(c) for c in ("tokens", "h", "w", "th", "tw")])).alias("tokens_md5"))


@query("restore_points", _sql_generated(2, C.POINT_OPEN_TOKEN, C.POINT_CLOSE_TOKEN, "point"))
def _restore_points(spark, d):
    rows = _generated(spark, d, 2, C.POINT_OPEN_TOKEN, C.POINT_CLOSE_TOKEN)
    return rows.select("doc_id", digest(tags.restore_points(*[F.col(c) for c in ("tokens", "h", "w", "th", "tw")])).alias("tokens_md5"))


@query("check_target_sizes", "SELECT p_partkey, p_size * 20 AS th, p_size * 27 AS tw FROM part")
def _check_target_sizes(spark, d):
    outputs = table(spark, d, "part").select("p_partkey")
    sizes = _parts(spark, d).select("p_partkey", F.col("h").alias("th"), F.col("w").alias("tw"))
    return postprocess.with_target_sizes(outputs, sizes, "p_partkey", (336, 336))
