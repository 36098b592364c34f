"""Encoding and decoding of whole texts with the streaming machines, as table steps."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquilt.llm.common import importable, table
from pixelquilt.llm.registry import query
from pixelquilt.llm.transducer import BpeDecoder, BpeEncoder

TOKENIZER = "word_bpe_49k.json"
#: Ids that the decoder takes at a time.
PIECE_IDS = 1 << 16


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each row of ``df``: the key and ``ids`` (binary, little-endian unsigned 32-bit).

    A null text encodes as an empty one; keys may be null or repeat; other columns are not read; an empty table gives
    an empty result. Nothing is shuffled, and a task holds one batch of texts.
    """
    importable(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def encode(batches):
        machine = BpeEncoder.of(tokenizer)
        for batch in batches:
            ids = [b"".join(machine.stream(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["key", "ids"])

    return rows.mapInArrow(encode, f"key {kind}, ids binary").withColumnRenamed("key", key)


def pieces(ids: bytes, size: int = PIECE_IDS):
    """The ids as lists of at most ``size``."""
    for at in range(0, len(ids), 4 * size):
        yield np.frombuffer(ids[at : at + 4 * size], dtype="<u4").tolist()


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = TOKENIZER, digest: bool = False) -> DataFrame:
    """The decoded text of every row (``decoded``), or with ``digest`` its SHA-256 and the number of ids, which keeps
    no text in memory. Null ids decode as none."""
    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()

    def decode(batches):
        token_of = BpeEncoder.of(tokenizer).token_of
        for batch in batches:
            packed = [x or b"" for x in batch.column(1).to_pylist()]
            out = []
            for each in packed:
                machine = BpeDecoder(token_of)
                parts = map(machine.feed, pieces(each))
                if digest:
                    summed = hashlib.sha256()
                    for part in parts:
                        summed.update(part.encode("utf-8"))
                    out.append(summed.hexdigest())
                else:
                    out.append("".join(parts) + machine.end())
            columns = [batch.column(0), pa.array(out, pa.string())]
            if digest:
                columns += [pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "decoded", "n_tokens", "ids_sha256"][: len(columns)])

    extra = ", n_tokens long, ids_sha256 string" if digest else ""
    return rows.mapInArrow(decode, f"key {kind}, decoded string{extra}").withColumnRenamed("key", key)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``: every text encoded and its ids decoded as they come. Besides the
    text a task holds one window of ids. Nulls and keys as in ``encode_texts``."""
    importable(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def measure(batches):
        machine = BpeEncoder.of(tokenizer)
        for batch in batches:
            out = [measured(machine, t.as_py()) for t in batch.column(1)]
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))]], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(measure, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def measured(machine: BpeEncoder, text: str | None) -> tuple[int, str, str]:
    """The number of ids of a text, and the digests of its ids and of what they decode to."""
    decoder, count, of_ids, of_text = BpeDecoder(machine.token_of), 0, hashlib.sha256(), hashlib.sha256()
    for ids in machine.stream(text):
        of_ids.update(ids)
        count += len(ids) // 4
        for piece in pieces(ids):
            of_text.update(decoder.feed(piece).encode("utf-8"))
    of_text.update(decoder.end().encode("utf-8"))
    return count, of_ids.hexdigest(), of_text.hexdigest()


@query("op3_bpe_transducer")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
