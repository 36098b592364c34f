"""Packing documents into training sequences: shortest pack first over the histogram of lengths.

Documents are cut into full sequences and a rest. The histogram of the rests has at most one entry for each length, so
planning on it costs the same for any number of documents. Lengths are placed longest first; each goes to the packs
that are the shortest so far, many alike at a time, and packs that are filled alike stay one pattern with a count.
Pieces of one length are then numbered, and the number says which slot of which pattern a piece takes.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelquilt.llm.common import importable, stage, table
from pixelquilt.llm.encoding import Encoder
from pixelquilt.llm.registry import query
from pixelquilt.operators.ordinals import bounded_broadcast

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 1


def cut_documents(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: ``key, start, length, ids_crc32, doc_tokens, ids`` (binary, unsigned 32-bit).

    Null and empty texts are the end id alone. Keys may be null or repeat.
    """
    importable(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches):
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            row, start, size, crc, whole, cut = [], [], [], [], [], []
            for i, words in enumerate(encoder.column(batch.column(1))):
                ids = words + end
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at : at + 4 * capacity]
                    row.append(i)
                    start.append(at // 4)
                    size.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    whole.append(len(ids) // 4)
                    cut.append(piece)
            numbers = [pa.array(x, pa.int64()) for x in (start, size, crc, whole)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *numbers, pa.array(cut, pa.binary())], ["key", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return rows.mapInArrow(pieces, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns, each a list of (length, how often) with the number of packs that follow it.

    Lengths go longest first to the shortest packs. Several of one length go to a pack at once, as many as would
    arrive there one after the other.
    """
    open_packs: list[tuple[int, int, tuple[tuple[int, int], ...], int]] = []  # used, age, pattern, packs
    done, age = [], 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            used, _, pattern, packs = open_packs[0] if open_packs else (capacity, 0, (), 0)
            if used + length > capacity:  # not even the shortest pack has room: new ones, one filled after the other
                each = min(capacity // length, left)
                pattern, used, packs = (), 0, left // each
            else:
                heapq.heappop(open_packs)
                each = 1
            taken = min(packs, left // each)
            if packs > taken:
                age += 1
                if pattern:
                    heapq.heappush(open_packs, (used, age, pattern, packs - taken))
            left -= taken * each
            grown = (*pattern[:-1], (length, pattern[-1][1] + each)) if pattern and pattern[-1][0] == length else (*pattern, (length, each))
            used += length * each
            if used == capacity:
                done.append((grown, taken))
            else:
                age += 1
                heapq.heappush(open_packs, (used, age, grown, taken))
    return done + [(pattern, packs) for _, _, pattern, packs in open_packs]


def _slots(patterns) -> np.ndarray:
    """Rows of (length, first rank, packs, first sequence, offset), one for each length of a pattern, by rank."""
    rows, next_rank, sequence = [], {}, 0
    for pattern, packs in patterns:
        offset = 0
        for length, times in pattern:
            first = next_rank.get(length, 0)
            next_rank[length] = first + times * packs
            rows.append((length, first, packs, sequence, offset))
            offset += length * times
        sequence += packs
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _ranked(pieces: DataFrame, capacity: int) -> DataFrame:
    """Number the pieces of each length from 0. A frequent length is numbered in buckets and these are added up."""
    buckets = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "start", "ids_crc32", "doc_tokens"]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1
    offsets = bounded_broadcast(offsets, capacity * buckets)
    return dealt.withColumn("_within", within).join(offsets, ["length", "_bucket"]).withColumn("_rank", (F.col("_within") + F.col("_offset")).cast("long")).drop("_bucket", "_within", "_offset")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """A row for each piece: key, ``start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids``.

    Every id lies in one piece, pieces follow each other in a sequence without a gap, and no sequence is longer than
    ``capacity``. Null texts are empty documents (their end id alone), repeated rows are documents of their own, an
    empty table gives no pieces, other columns are not read. What the driver holds is the histogram and the patterns,
    whose size depends on ``capacity`` alone.
    """
    cut = cut_documents(df, key, text, tokenizer, capacity, end_id)
    pieces = stage(cut if ids else cut.drop("ids"), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = _slots(plan_patterns(histogram, capacity))
    ranked = _ranked(pieces, capacity)
    length_at, rank_at = ranked.columns.index("length"), ranked.columns.index("_rank")

    def place(batches):
        names = ["length", "first"]
        lookup = np.rec.fromarrays([slots[:, 0], slots[:, 1]], names=names)
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (length_at, rank_at))
            row = np.searchsorted(lookup, np.rec.fromarrays([length, rank], names=names), side="right") - 1
            _, first, packs, sequence, offset = slots[row].T
            turn, pack = np.divmod(rank - first, packs)
            added = [pa.array(sequence + pack, pa.int64()), pa.array(offset + turn * length, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id long, offset long"
    placed = ranked.mapInArrow(place, schema)
    return placed.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else []))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
