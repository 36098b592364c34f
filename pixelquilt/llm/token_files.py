"""Token files of directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level k holds the k-th chunk of the ids that have one, and a
bitmap that says which of them go on to level k+1; the position there is the number of set bits before, which a
directory of counts (one for each block of 512 bits) and one count within the block give. Any id is read by touching
one byte and one block of each level, without decoding its neighbours.

A file is a Parquet file of segments, in ascending order of the keys; Spark's committer writes it, so a lost executor
leaves no half file. A segment holds whole documents and the directory of where each begins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelquilt.llm.common import importable, stage, table
from pixelquilt.llm.encoding import REMEMBERED, Encoder
from pixelquilt.llm.registry import query
from pixelquilt.operators.ordinals import bounded_broadcast
from pixelquilt.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: A segment is closed once it has so many ids; a longer document has a segment of its own.
SEGMENT_IDS = 1 << 18
BLOCK_BITS = 512

_FIELDS = "part int, segment int, local_start long, n_ids long, docs array<long>, doc_starts array<long>, chunks array<binary>, marks array<binary>, ranks array<binary>"


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """The levels of some ids: chunk bytes, continuation bitmaps, rank directories."""
    chunks, marks, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        chunks.append((rest & 0xFF).astype(np.uint8).tobytes())
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK_BITS // 8)))
        set_bits = np.bitwise_count(bits).reshape(-1, BLOCK_BITS // 8).sum(axis=1, dtype=np.uint64)
        marks.append(bits.tobytes())
        ranks.append(np.concatenate([[0], np.cumsum(set_bits)[:-1]]).astype("<u8").tobytes() if len(set_bits) else b"")
        rest = rest[more] >> 8
        if not len(rest):
            return chunks, marks, ranks


class Codes:
    """Random access to the ids of a segment."""

    def __init__(self, chunks: list[bytes], marks: list[bytes], ranks: list[bytes]):
        self.chunks = [np.frombuffer(c, np.uint8) for c in chunks]
        self.marks = [np.frombuffer(m, np.uint8) for m in marks]
        self.ranks = [np.frombuffer(r, "<u8") for r in ranks]

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each position: the block's count and those before it in the block."""
        width = BLOCK_BITS // 8
        block = at // BLOCK_BITS
        rows = self.marks[level].reshape(-1, width)[block]
        inside = (at % BLOCK_BITS)[:, None] - 8 * np.arange(width)[None, :]
        kept = np.where(inside >= 8, 0xFF, np.where(inside <= 0, 0, (1 << np.clip(inside, 0, 8)) - 1)).astype(np.uint8)
        return self.ranks[level][block].astype(np.int64) + np.bitwise_count(rows & kept).sum(axis=1, dtype=np.int64)

    def at(self, positions) -> np.ndarray:
        """The ids at some positions, each found on its own."""
        at = np.asarray(positions, dtype=np.int64)
        found, alive, level = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
        while len(alive):
            found[alive] |= self.chunks[level][at].astype(np.uint32) << np.uint32(8 * level)
            more = (self.marks[level][at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1
            at, alive = at[more], alive[more]
            if len(alive):
                at = self._rank(level, at)
            level += 1
        return found

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to ``end``: one rank for each level, then neighbours follow each other."""
        found, alive, level = np.zeros(max(0, end - start), np.uint32), np.arange(max(0, end - start)), 0
        while len(alive):
            found[alive] |= self.chunks[level][start : start + len(alive)].astype(np.uint32) << np.uint32(8 * level)
            low = start // 8
            bits = np.unpackbits(self.marks[level][low : (start + len(alive)) // 8 + 1], bitorder="little")
            more = bits[start - 8 * low :][: len(alive)] == 1
            alive = alive[more]
            if len(alive):
                start = int(self._rank(level, np.array([start]))[0])
            level += 1
        return found


#: Characters of a text by which rows of one key are ranged.
RANGE_CHARS = 64


def write_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Encode whole texts and write their ids in ascending order of an integer key.

    Null texts are empty documents (their end id alone). Rows with a null key come first, equal keys stay separate
    documents next to each other, in the order of their texts. An empty table gives files without segments. Other
    columns are not read.
    """
    importable(df.sparkSession)
    ordered = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    # What is sampled to set the ranges is the key and the beginning of a text, which orders it among equal keys.
    ordered = ordered.repartitionByRange(F.col("key").asc_nulls_first(), F.substring("text", 1, RANGE_CHARS).asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("key").asc_nulls_first(), F.col("text").asc_nulls_first())
    end = np.array([end_id], dtype="<u4").tobytes()

    def segments(batches):
        encoder, part = Encoder.of(tokenizer, remembered=2 * REMEMBERED), TaskContext.get().partitionId()
        number, start, filled, docs, starts, held = 0, 0, 0, [], [], []

        def close():
            row = [[part], [number], [start], [filled], [docs], [starts], *[[x] for x in pack(np.frombuffer(b"".join(held), "<u4"))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 3]
            names = [f.split(" ")[0] for f in _FIELDS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc, words in zip(batch.column(0).to_pylist(), encoder.column(batch.column(1)), strict=True):
                ids = words + end
                docs.append(doc)
                starts.append(filled)
                held.append(ids)
                filled += len(ids) // 4
                if filled >= SEGMENT_IDS:
                    yield close()
                    number, start, filled, docs, starts, held = number + 1, start + filled, 0, [], [], []
        if docs:
            yield close()

    ordered.mapInArrow(segments, _FIELDS).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``first_id``, the place of their first id in the whole sequence of files."""
    found = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each file.
    files = found.groupBy("part").agg(F.sum("n_ids").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    totals = stage(files.select("part", "_before"), "file-totals")
    return found.join(bounded_broadcast(totals, totals.count()), "part").withColumn("first_id", F.col("_before") + F.col("local_start")).drop("_before")


def read_documents(spark: SparkSession, path: str, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """A row for each document: key, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, the ``ids`` themselves."""

    def documents(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                codes = Codes(row["chunks"], row["marks"], row["ranks"])
                bounds = [*row["doc_starts"], row["n_ids"]]
                read = [codes.slice(a, b).astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:])]
                columns = [pa.array(row["docs"], pa.int64()), pa.array([row["first_id"] + a for a in bounds[:-1]], pa.int64()), pa.array([len(r) // 4 for r in read], pa.int64()), pa.array(map(zlib.crc32, read), pa.int64())]
                names = ["key", "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns, names = [*columns, pa.array(read, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    importable(spark)
    schema = "key long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")
    return read_segments(spark, path).mapInArrow(documents, schema).withColumnRenamed("key", key)


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """The ids at a few places of the whole sequence: segments without one are not opened."""
    wanted = sorted(set(positions))
    touched = read_segments(spark, path).filter(F.exists(F.array(*[F.lit(p).cast("long") for p in wanted]), lambda p: (p >= F.col("first_id")) & (p < F.col("first_id") + F.col("n_ids"))))

    def look_up(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = [p for p in wanted if row["first_id"] <= p < row["first_id"] + row["n_ids"]]
                found = Codes(row["chunks"], row["marks"], row["ranks"]).at([p - row["first_id"] for p in at])
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found.tolist(), pa.int64())], ["position", "id"])

    return touched.mapInArrow(look_up, "position long, id long")


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)
