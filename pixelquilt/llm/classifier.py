"""A quality score from compression.

One zstandard dictionary is trained on good and one on bad labelled text. A text is compressed with both, in blocks
short enough that the dictionary matters more than the block itself; the difference of the sizes for each byte of the
text tells which kind it resembles. A logistic curve, fitted on labelled texts that are in neither dictionary, turns it
into a probability.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquilt.llm.common import fresh, importable, table
from pixelquilt.llm.registry import query

#: Labelled rows that the fit takes at most: for each dictionary, and for the curve. They are those with the smallest
#: hashes of their keys and texts. A text gives a dictionary SAMPLE_BYTES at most, in pieces of SAMPLE_PIECE bytes that a
#: hash chooses from all of it. The curve and the scores read whole texts.
DICTIONARY_ROWS, CURVE_ROWS = 3000, 8000
SAMPLE_BYTES, SAMPLE_PIECE = 4096, 2048
DICTIONARY_BYTES = 1 << 16
BLOCK = 512
THRESHOLD = 0.7


class Scale:
    """Compressed sizes with both dictionaries, as one number for a text."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        make = lambda raw: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
        self.good, self.bad = make(good), make(bad)

    def difference(self, text: str | None) -> float:
        """(size with bad - size with good) / bytes, positive for good text and 0 for none. Blocks are taken one after
        the other, so a long text needs no more memory than itself."""
        data = memoryview((text or "").encode("utf-8"))
        total = 0
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            total += len(self.bad.compress(block)) - len(self.good.compress(block))
        return total / max(len(data), 1)


def sample_of(text: str) -> bytes:
    """All of a short text; else pieces from anywhere in it, in order, only the last of which may be shorter."""
    data = text.encode("utf-8")
    starts = range(0, len(data), SAMPLE_PIECE)
    chosen = sorted(starts, key=lambda i: xxhash.xxh64_intdigest(data[i : i + SAMPLE_PIECE], i))[: SAMPLE_BYTES // SAMPLE_PIECE]
    return b"".join(data[i : i + SAMPLE_PIECE] for i in sorted(chosen))


def _dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    pieces = [d[i : i + SAMPLE_PIECE] for d in samples for i in range(0, len(d), SAMPLE_PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few or too even samples to train on: their text itself is the dictionary
        return (b"\n".join(pieces) or b"-" * 16)[-DICTIONARY_BYTES:]


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, offset) of a logistic curve, by Newton's steps with a small penalty."""
    scale = max(float(x.std()), 1e-6) if len(x) else 1.0
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    weights = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (y - p) - 1e-2 * weights
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        weights = weights + np.linalg.solve(curve, gradient)
    return float(weights[0] / scale), float(weights[1])


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[bytes, bytes, float, float]:
    """Dictionaries and curve from bounded samples of the labelled rows that are not held out.

    Rows with a null key, text or label teach nothing. Of a key with several labels, the smallest counts.
    """
    fold = F.crc32(F.col("k").cast("string").cast("binary")) % 4
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)").groupBy("k").agg(F.min("y").alias("y")).filter(fold != 2)
    order = F.xxhash64("k", F.lit(7))
    # Keys are chosen first, on narrow rows; only their texts are then looked up.
    parts = [known.filter((F.col("y") == y) & (fold != 3)).orderBy(order).limit(DICTIONARY_ROWS) for y in (0, 1)]
    parts.append(known.filter(fold == 3).orderBy(order).limit(CURVE_ROWS))
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("fold", fold)
    # At most 2 x DICTIONARY_ROWS + CURVE_ROWS keys. Keys may repeat in the documents, so the rows are bounded again.
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL").join(F.broadcast(chosen), "k")
    rows = rows.select("y", "fold", "t", F.xxhash64("k", "t").alias("h"))
    importable(docs.sparkSession)

    def sample(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sample_of(t) for t in batch.column(2).to_pylist()], pa.binary())], ["y", "h", "s"])

    samples = rows.filter("fold <> 3").select("y", "h", "t").mapInArrow(sample, "y int, h long, s binary").groupBy("y", "s").agg(F.min("h").alias("h"))
    # At most DICTIONARY_ROWS x SAMPLE_BYTES for each.
    taken = ([bytes(r["s"]) for r in samples.filter(F.col("y") == y).orderBy("h", "s").limit(DICTIONARY_ROWS).collect()] for y in (1, 0))
    good, bad = (_dictionary(sorted(t)) for t in taken)

    def measure(batches):
        scale = Scale(good, bad)
        for batch in batches:
            x = [scale.difference(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.float64())], ["y", "h", "x"])

    # Rows are bounded once they are numbers, so whole texts stay where they are.
    measured = rows.filter("fold = 3").select("y", "h", "t").mapInArrow(measure, "y int, h long, x double")
    pairs = sorted(measured.orderBy("h", "y", "x").limit(CURVE_ROWS).select("y", "x").collect())
    slope, offset = fit_curve(np.array([p["x"] for p in pairs], dtype=float), np.array([p["y"] for p in pairs], dtype=float))
    return good, bad, slope, offset


def score(df: DataFrame, model: tuple[bytes, bytes, float, float], key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``df``: key, ``held_out``, ``score`` in [0, 1] and ``predicted``.

    The score sees the text alone; null counts as empty. Keys may be null (not held out) or repeat, other columns are
    not read, an empty table gives an empty result. Nothing is shuffled.
    """
    good, bad, slope, offset = model
    importable(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def scores(batches):
        scale = Scale(good, bad)
        for batch in batches:
            x = [max(-30.0, min(30.0, slope * scale.difference(t) + offset)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([1 / (1 + math.exp(-v)) for v in x], pa.float64())], ["key", "score"])

    found = rows.mapInArrow(scores, f"key {kind}, score double")
    out = fresh(found, "out")
    return found.withColumn(out, F.coalesce(held_out(F.col("key")), F.lit(False))).select(F.col("key").alias(key), F.col(out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op10_compression_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
