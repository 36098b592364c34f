"""Token counts: Arrow batches in, lengths out. Batches are balanced by bytes, long texts are cut at safe places."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquilt.llm.common import importable, table
from pixelquilt.llm.encoding import Encoder, segments, windows
from pixelquilt.llm.registry import query

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: UTF-8 bytes that are encoded as one batch.
BATCH_BYTES = 1 << 18


def balanced(texts: list[str | None], size: int = BATCH_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Batches of (row, piece) of about ``size`` UTF-8 bytes each, whatever the lengths of the texts."""
    batch, filled = [], 0
    for row, text in enumerate(texts):
        text = text or ""
        plain = text.isascii()
        for piece in windows(text, size if plain else size // 4):
            batch.append((row, piece))
            filled += len(piece) if plain else len(piece.encode())
            if filled >= size:
                yield batch
                batch, filled = [], 0
    if batch:
        yield batch


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """A row for each row of ``df``: the key, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Whole texts are counted, without begin, end or other added tokens; special strings in a text count as the
    tokenizer has them. A null text counts as empty (0 bytes, 0 tokens). Keys may be null or repeat; other columns are
    not read, and an empty table gives an empty result. Nothing is shuffled.
    """
    importable(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["key"].dataType.simpleString()

    def lengths(batches):
        memory = Encoder.of(tokenizer, lengths_only=True).memory
        for batch in batches:
            counts = [0] * batch.num_rows
            for pieces in balanced(batch.column(1).to_pylist()):
                split = [segments(piece) for _, piece in pieces]
                found = iter(memory.of([s for parts in split for s in parts]))
                for (row, _), parts in zip(pieces, split, strict=True):
                    counts[row] += sum(next(found) for _ in parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(lengths, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
