"""Look-ups between token strings and vocabulary ids over whole tables.

Rows are dictionary coded first: each row keeps its distinct elements once, and for every element the place of its
entry in that list. Only the entries look for their partners; what occurs a thousand times in a row is looked up once,
and what is frequent in the whole table is known to every task and looked up in place.
The row itself, codes in hand, waits where its key lies and puts the partners in place when they come back. No element
of an array is ever a row of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelquilt import config as C
from pixelquilt.functions.hashing import hash60
from pixelquilt.functions.tokens import text_tokens
from pixelquilt.operators.ordinals import BUCKET, default_buckets, hash_bucket, ordinal
from pixelquilt.session import scratch_path
from pixelquilt.sources.buckets import stored_by
from pixelquilt.sources.tables import cached_scan

CODES, ENTRIES = "codes", "entries"


def _code_batch(arrays: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Codes and distinct elements of every array of a batch. A null element has the code -1, a null array none."""
    lengths = np.where(arrays.is_valid().to_numpy(zero_copy_only=False), arrays.value_lengths().fill_null(0).to_numpy(), 0).astype(np.int64)
    coded = arrays.flatten().dictionary_encode()
    known = coded.indices.is_valid().to_numpy(zero_copy_only=False)
    number = coded.indices.fill_null(0).to_numpy().astype(np.int64)
    size = max(1, len(coded.dictionary))
    row = np.repeat(np.arange(len(arrays)), lengths)
    distinct, at = np.unique(row[known] * size + number[known], return_inverse=True)
    owner = distinct // size
    counts = np.bincount(owner, minlength=len(arrays))
    starts = np.concatenate([[0], np.cumsum(counts)])
    codes = np.full(len(row), -1, dtype=np.int32)
    codes[known] = at - starts[owner[at]] if len(at) else 0
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return (
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes)),
        pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), coded.dictionary.take(pa.array(distinct % size))),
    )


def coded_rows(df: DataFrame, key: str, array: str) -> DataFrame:
    """``(key, codes, entries)``: distinct elements of each row and, per element, its place among them (from 0)."""
    element = df.schema[array].dataType.elementType
    schema = T.StructType([df.schema[key], T.StructField(CODES, T.ArrayType(T.IntegerType())), T.StructField(ENTRIES, T.ArrayType(element))])

    def code(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_code_batch(batch.column(1))], schema.names)

    return df.select(key, array).mapInArrow(code, schema)


def entry_rows(coded: DataFrame, key: str, name: str) -> DataFrame:
    """``(key, _slot, name)``: one row for each distinct element of a row."""
    return coded.select(key, F.posexplode(ENTRIES).alias("_slot", name))


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary at rest, bucketed by token; bucketed by id as well once decoding asks for it."""

    table: DataFrame
    frequent: DataFrame

    @property
    def by_token(self) -> DataFrame:
        return self.table

    @cached_property
    def by_id(self) -> DataFrame:
        return stored_by(self.table, ["id"], "vocab_by_id")


def _numbered(tokens: DataFrame, first_id: int) -> DataFrame:
    """``(token, id, ...)`` of distinct tokens, numbered in the order of their hash."""
    buckets = default_buckets(tokens.sparkSession)
    hashed = tokens.withColumn("_h", hash60(F.col("token")))
    hashed = hashed.withColumn(BUCKET, hash_bucket(F.col("_h"), buckets))
    numbered = ordinal(hashed, [], ["_h", "token"], "id", buckets=buckets)
    return numbered.withColumn("id", (F.col("id") + first_id).cast("int")).drop("_h")


def build_vocab(texts: DataFrame, text: str, first_id: int = 0) -> DataFrame:
    """``(token, id)`` for the distinct tokens of a column, numbered in the order of their hash."""
    tokens = texts.select(F.explode(text_tokens(F.col(text))).alias("token")).distinct()
    return _numbered(tokens, first_id).select("token", "id")


def build_coded_vocab(coded: DataFrame, key: str, first_id: int = 0) -> Vocabulary:
    """The vocabulary of coded rows, stored. Counts of rows per token come with it: tokens that are in most rows are
    known as such, and there is no second look at any text."""
    spark = coded.sparkSession
    counted = entry_rows(coded, key, "token").filter("token IS NOT NULL").groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    # Written before it is numbered: the numbering reads it twice.
    return store_vocab(_numbered(cached_scan(counted, scratch_path(spark, "tokens")), first_id))


def store_vocab(vocab: DataFrame, frequent: int = C.FREQUENT_TOKENS) -> Vocabulary:
    """Store ``(token, id)`` and, where it is counted, ``uses``. The ``frequent`` most used tokens are kept aside: as many
    rows at most, they go to the entries instead of meeting all of them in a few tasks."""
    kept = vocab.select("token", "id", *(["uses"] if "uses" in vocab.columns else []))
    by_token = stored_by(kept, ["token"], "vocab_by_token")
    if "uses" not in kept.columns:
        return Vocabulary(by_token, by_token.limit(0))
    top = cached_scan(by_token.orderBy(F.desc("uses"), "token").limit(frequent), scratch_path(vocab.sparkSession, "frequent"))
    return Vocabulary(by_token, top)


def _known(vocab: Vocabulary | DataFrame, element: T.DataType, source: str, target: str) -> pa.Table:
    """``(source, target)`` of the frequent tokens, as many rows at most as ``store_vocab`` keeps aside; none of a plain table."""
    frequent = vocab.frequent if isinstance(vocab, Vocabulary) else vocab.limit(0)
    alike = F.col(source) if frequent.schema[source].dataType == element else F.col(source).try_cast(element)
    return frequent.select(alike.alias(source), target).filter(F.col(source).isNotNull() & F.col(target).isNotNull()).toArrow()


def _lengths(arrays: pa.Array) -> np.ndarray:
    return arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _among(entries: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each entry among the known ones, -1 for the others."""
    return pc.index_in(entries, value_set=known.cast(entries.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _marked_batch(codes: pa.Array, entries: pa.Array, held: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """For every element the place of its entry among the known ones, -1 for a null and -2 - i for the i-th other entry of
    the row; numbers of entries and of other entries; where these stand, and whose they are."""
    lengths, n = _lengths(entries), _lengths(codes)
    starts, row = _starts(lengths), np.repeat(np.arange(len(lengths)), lengths)
    mark = _among(entries.flatten(), held)
    rare = np.flatnonzero(mark < 0)
    owner = row[rare]
    counts = np.bincount(owner, minlength=len(lengths))
    mark[rare] = -2 - (np.arange(len(rare)) - _starts(counts)[owner])
    code = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    real = code >= 0
    element = np.full(len(code), -1, np.int32)
    element[real] = mark[(np.repeat(starts[:-1], n) + code)[real]]
    elements = pa.ListArray.from_arrays(pa.array(_starts(n).astype(np.int32)), pa.array(element))
    return elements, pa.array(lengths.astype(np.int32)), pa.array(counts.astype(np.int32)), rare, owner


def _marked_rows(coded: DataFrame, key: str, known) -> DataFrame:
    """``(key, _elements, _entries, _rare)``: rows as numbers alone."""
    schema = T.StructType([coded.schema[key], T.StructField("_elements", T.ArrayType(T.IntegerType())), T.StructField("_entries", T.IntegerType()), T.StructField("_rare", T.IntegerType())])

    def mark(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_marked_batch(batch.column(1), batch.column(2), known.value[0])[:3]], schema.names)

    return coded.select(key, CODES, ENTRIES).mapInArrow(mark, schema)


def _rare_rows(coded: DataFrame, key: str, name: str, known) -> DataFrame:
    """``(key, _slot, name)`` of the entries that are not known, numbered in each row."""
    schema = T.StructType([coded.schema[key], T.StructField("_slot", T.IntegerType()), T.StructField(name, coded.schema[ENTRIES].dataType.elementType)])

    def rare(batches):
        for batch in batches:
            *_, counts, at, owner = _marked_batch(pa.nulls(batch.num_rows, pa.list_(pa.int32())), batch.column(1), known.value[0])
            slot = (np.arange(len(at)) - _starts(counts.to_numpy())[owner]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(slot), batch.column(1).flatten().take(pa.array(at))], schema.names)

    return coded.select(key, ENTRIES).mapInArrow(rare, schema)


def _partners(entries: DataFrame, key: str, vocab: Vocabulary | DataFrame, source: str, target: str, error: str) -> DataFrame:
    """``(key, _slot, target)`` of entries; one without a partner is an error."""
    table = (vocab.by_token if source == "token" else vocab.by_id) if isinstance(vocab, Vocabulary) else vocab
    unknown = F.raise_error(F.concat(F.lit(error), F.col(source).cast("string"))).cast(table.schema[target].dataType)
    return entries.join(table.select(source, target), source, "left").select(key, "_slot", F.coalesce(target, unknown).alias(target))


def _placed_batch(elements: pa.Array, rare: pa.Array, slots: pa.Array, found: pa.Array, values: pa.Array) -> pa.Array:
    """The partner of every element: of a known entry from ``values``, of the others from ``found`` by slot."""
    counts, n = rare.to_numpy(zero_copy_only=False).astype(np.int64), _lengths(elements)
    if not np.array_equal(counts, _lengths(slots)):
        raise ValueError("Keys of looked-up rows must be unique and not null")
    starts, slot = _starts(counts), slots.flatten().to_numpy(zero_copy_only=False)
    partner = np.zeros(len(slot), np.int64)
    partner[np.repeat(starts[:-1], counts) + slot] = len(values) + np.arange(len(slot))
    at = elements.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    other = np.flatnonzero(at < -1)
    at[other] = partner[np.repeat(starts[:-1], n)[other] - 2 - at[other]]
    flat = found.flatten()
    both = pa.concat_arrays([values.cast(flat.type), flat])
    return pa.ListArray.from_arrays(pa.array(_starts(n).astype(np.int32)), both.take(pa.array(at, mask=at < 0)))


def placed(coded: DataFrame, key: str, vocab: Vocabulary | DataFrame, source: str, target: str, error: str) -> DataFrame:
    """``(key, <target>s)``: coded rows with the partner of every element, in order.

    ``coded`` is read twice. Frequent tokens are told where the row lies; only the other entries meet the vocabulary, and
    the row itself travels as one number for each element. The result lies by key.
    """
    frequent = _known(vocab, coded.schema[ENTRIES].dataType.elementType, source, target)
    known = coded.sparkSession.sparkContext.broadcast([c.combine_chunks() for c in frequent.columns])
    found = _partners(_rare_rows(coded, key, source, known), key, vocab, source, target, error)
    # The rare entries of one row; there are as many as the row has distinct elements, at most.
    values = found.groupBy(key).agg(F.collect_list(F.struct("_slot", target)).alias("_found"))
    alone = (F.sum("_entries").over(Window.partitionBy(key)) == F.col("_entries")) & (F.col(key).isNotNull() | (F.col("_entries") == 0))
    rows = _marked_rows(coded, key, known).withColumn("_alone", alone)
    wrong = F.raise_error(F.lit("Keys of looked-up rows must be unique and not null")).cast("array<int>")
    elements = F.when(F.col("_alone"), F.col("_elements")).otherwise(wrong)

    @F.arrow_udf(T.ArrayType(found.schema[target].dataType))
    def put(elements: pa.Array, rare: pa.Array, slots: pa.Array, partners: pa.Array) -> pa.Array:
        return _placed_batch(elements, rare, slots, partners, known.value[1])

    joined = rows.join(values, key, "left")
    return joined.select(key, put(elements, F.col("_rare"), F.col("_found._slot"), F.col(f"_found.{target}")).alias(target + "s"))


def _coded_once(df: DataFrame, key: str, array: str) -> DataFrame:
    """Coded rows, written: what they come from is worked out once."""
    return cached_scan(coded_rows(df, key, array), scratch_path(df.sparkSession, "coded"))


def vocab_lookup(df: DataFrame, key: str, tokens: str, vocab: Vocabulary | DataFrame) -> DataFrame:
    """``(key, ids)``: exact vocabulary match per token; an unknown token is an error. ``key`` is unique. A null token has
    a null id, a null array no ids."""
    return placed(_coded_once(df, key, tokens), key, vocab, "token", "id", "Token is not in the vocabulary: ")


def token_strings(df: DataFrame, key: str, ids: str, vocab: Vocabulary | DataFrame) -> DataFrame:
    """``(key, tokens)``: ids as token strings; an unknown id is an error."""
    return placed(_coded_once(df, key, ids), key, vocab, "id", "token", "Id is not in the vocabulary: ")


def decode_tokens(df: DataFrame, key: str, ids: str, vocab: Vocabulary | DataFrame, separator: str = " ") -> DataFrame:
    """``(key, text)``: ids back to text."""
    return token_strings(df, key, ids, vocab).select(key, F.array_join("tokens", separator).alias("text"))
