"""The registry, the inputs the test tables stand in for, and SQL fragments shared by the twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquilt import config as C
from pixelquilt.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORLD = 4
BATCH_SIZE = 4
SEED = 42
MAX_LENGTH = 4096


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def doc_texts(spark: SparkSession, directory: str, *columns: str) -> DataFrame:
    """Documents for work that is heavy per row."""
    return spread(table(spark, directory, "documents").select("doc_id", "text", *columns), "doc_id")


# --- derived inputs ----------------------------------------------------------------------------


def doc_sizes(docs: DataFrame) -> DataFrame:
    """Image sizes from the row key."""
    return docs.select("doc_id", (50 + F.col("doc_id") * 37 % 1900).alias("width"), (50 + F.col("doc_id") * 91 % 1400).alias("height"))


DOC_SIZES = "SELECT doc_id, 50 + doc_id * 37 % 1900 AS width, 50 + doc_id * 91 % 1400 AS height FROM documents"


def page_image_url(url: Column) -> Column:
    """Image references of every shape from page addresses: null, blank, rooted, absolute, relative."""
    path = F.regexp_replace(url, "^https?://[^/]+/", "")
    return (
        F.when(url.contains("?"), F.lit(None).cast("string"))
        .when(url.contains("#"), F.lit(" \t"))
        .when(url.endswith("/"), F.concat(F.lit("/data/"), path))
        .when(url.endswith(".html"), F.concat(F.lit("/mnt/"), path))
        .otherwise(path)
    )


PAGE_IMAGE_URL = """CASE WHEN contains(url, '?') THEN NULL WHEN contains(url, '#') THEN ' ' || chr(9)
 WHEN url LIKE '%/' THEN '/data/' || regexp_replace(url, '^https?://[^/]+/', '')
 WHEN url LIKE '%.html' THEN '/mnt/' || regexp_replace(url, '^https?://[^/]+/', '')
 ELSE regexp_replace(url, '^https?://[^/]+/', '') END"""


def doc_usable() -> Column:
    """One source of the documents has no images."""
    return F.col("source") != "src7"


DOC_USABLE = "(source <> 'src7')"


# --- SQL fragments -----------------------------------------------------------------------------


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_h60(*parts) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(str(p) for p in parts)})), 1, 15))::BIGINT"


def sql_tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{C.TOKEN_PATTERN}')"


def sql_token_id(token: str) -> str:
    known = " ".join(f"WHEN {sql_text(t)} THEN {i}" for t, i in C.SPECIAL_IDS.items())
    return f"CASE {token} {known} ELSE ('0x' || substr(md5({token}), 1, 8))::BIGINT % {C.HASHED_IDS} END"


def sql_ids(text: str) -> str:
    return f"list_prepend({C.BOS_ID}, list_transform({sql_tokens(text)}, lambda t: {sql_token_id('t')}))"


def sql_encode(text: str, max_length: int) -> str:
    return f"({sql_ids(f'({text} || {sql_text(C.END_OF_TEXT)})')})[1:{max_length}]"


def sql_clip(ids: str, max_length: int, closing: int = C.EOS_ID) -> str:
    return f"list_append(({ids})[1:{max_length // 2 - 1}], {closing})"


SQL_TEMPLATE = f"""list_transform(range(2098), lambda p: CASE WHEN p = 577 OR (p >= 578 AND (p - 578) % 38 = 37)
 THEN {C.SPECIAL_IDS[C.IMAGE_NEWLINE]} ELSE {C.SPECIAL_IDS[C.IMAGE_PLACEHOLDER]} END)"""
SQL_PATCHES = """list_transform(range(2098), lambda p: CASE WHEN p < 577 THEN p WHEN p = 577 THEN -1
 WHEN (p - 578) % 38 = 37 THEN -1 ELSE 577 + ((p - 578) // 38) * 37 + (p - 578) % 38 END)"""


def sql_fill(count: str, value) -> str:
    return f"list_transform(range(greatest({count}, 0)::BIGINT), lambda z: {value})"


def sql_pad_right(array: str, length: str, value) -> str:
    return f"list_concat({array}, {sql_fill(f'{length} - len({array})', value)})"


def sql_pad_left(array: str, length: str, value) -> str:
    return f"list_concat({sql_fill(f'{length} - len({array})', value)}, {array})"


def sql_digest(array: str) -> str:
    return f"md5(array_to_string({array}, ' '))"


def digest(array: Column) -> Column:
    return F.md5(F.array_join(array, " "))


def length(array: Column) -> Column:
    return F.size(array).cast("bigint")


def sql_labels(ids: str) -> str:
    at = f"list_position({ids}, {C.BOS_ID})"
    return f"list_concat({sql_fill(at, C.IGNORED_LABEL)}, {ids}[{at} + 1:])"


def sql_last_bos(ids: str, array: str) -> str:
    last = f"(len({ids}) - list_position(list_reverse({ids}), {C.BOS_ID}) + 1)"
    return (
        f"CASE WHEN {last} > list_position({ids}, {C.BOS_ID}) "
        f"THEN list_concat(list_append({array}[1:{last} - 1], {C.EOS_ID}), {array}[{last} + 1:]) ELSE {array} END"
    )


def sql_plan_main(name: str, source: str, key: str, world=WORLD, batch=BATCH_SIZE, seed=SEED, epochs=1) -> str:
    """CTEs ending in ``name``: contiguous shards, full shuffle, full batches."""
    return f"""{name}_o AS (SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS o, count(*) OVER () AS n FROM {source}),
{name}_s AS (SELECT {key}, CASE WHEN o < (n % {world}) * (n // {world} + 1) THEN o // (n // {world} + 1)
   ELSE n % {world} + (o - (n % {world}) * (n // {world} + 1)) // greatest(n // {world}, 1) END AS rank FROM {name}_o),
{name}_e AS (SELECT {key}, rank, range AS epoch, {sql_h60(f'{seed} + range', key)} AS h FROM {name}_s, range({epochs})),
{name}_p AS (SELECT {key}, rank, epoch, row_number() OVER (PARTITION BY epoch, rank ORDER BY h, {key}) - 1 AS ord,
   count(*) OVER (PARTITION BY epoch, rank) AS sn FROM {name}_e),
{name} AS (SELECT {key}, epoch, rank, ord // {batch} AS batch_id, ord % {batch} AS pos FROM {name}_p
   WHERE ord < (sn // {batch}) * {batch})"""


def sql_plan_side(name: str, source: str, key: str, world=WORLD, batch=BATCH_SIZE, seed=SEED, epochs=1, buffer=1000) -> str:
    """CTEs ending in ``name``: strided shards, bounded shuffle, full batches."""
    return f"""{name}_o AS (SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS o FROM {source}),
{name}_e AS (SELECT {key}, o % {world} AS rank, o // {world} AS i, range AS epoch, {sql_h60(f'{seed} + range', key)} AS h
   FROM {name}_o, range({epochs})),
{name}_p AS (SELECT {key}, rank, epoch, (i // {buffer}) * {buffer}
   + row_number() OVER (PARTITION BY epoch, rank, i // {buffer} ORDER BY h, {key}) - 1 AS ord,
   count(*) OVER (PARTITION BY epoch, rank) AS sn FROM {name}_e),
{name} AS (SELECT {key}, epoch, rank, ord // {batch} AS batch_id, ord % {batch} AS pos FROM {name}_p
   WHERE ord < (sn // {batch}) * {batch})"""


SQL_CHATS = f"""SELECT conv_id, string_agg('{C.START_HEADER}' || coalesce(role, '') || '{C.END_HEADER}' || chr(10) || chr(10) || coalesce(text, '')
 || '{C.END_OF_TURN}', '' ORDER BY turn) AS conversations FROM conversations GROUP BY conv_id"""


def sql_caption(text: str, key: str, seed=SEED) -> str:
    choices = "[" + ", ".join(sql_text(line) for line in C.CAPTION_INSTRUCTIONS) + "]"
    pick = f"({sql_h60(seed, key)} % {len(C.CAPTION_INSTRUCTIONS)})"
    user = f"'{C.START_HEADER}user{C.END_HEADER}' || chr(10) || chr(10)"
    answer = f"'{C.END_OF_TURN}{C.START_HEADER}assistant{C.END_HEADER}' || chr(10) || chr(10)"
    return f"({user} || {choices}[{pick} + 1] || {answer} || {text} || '{C.END_OF_TURN}')"
