"""What the steps share: staged tables, fresh column names, bounded bitmaps, words as columns."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquilt.session import scratch_path

#: The white space that separates words in the quality and shingle contracts.
WORD_GAPS = r"[\x20\x09-\x0D]+"

#: 64-bit words of a bitmap that is gathered on the driver and shipped to tasks (2 MB). More members than it has
#: room for only make it let more rows pass.
BITMAP_WORDS = 1 << 18


#: While a staged table is written, shuffle files go as soon as its job is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The folders of the open scratch blocks, innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratch", default=())


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts the lineage, and survives lost executors.

    The folder stays until the ``scratch`` block ends in which it was written.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if _open.get():
        _open.get()[-1].append(path)
    found = spark.read.schema(schema).parquet(path)
    found.staged_at = path
    return found


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders, in whatever store they lie."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """A block whose staged tables are deleted at its end, but for those passed to what it yields.

    What leaves the block must not read the others any more: it is itself a staged table that was kept.
    """
    made: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.staged_at)
        return df

    outer = _open.get()
    token = _open.set((*outer, made))
    try:
        yield keep
    finally:
        _open.reset(token)
        delete(spark, [path for path in made if path not in kept])
        if outer:
            outer[-1].extend(kept)


@contextmanager
def left_over(made: list[str]):
    """A block whose staged tables are listed in ``made`` and stay, for a result that still reads them."""
    token = _open.set((*_open.get(), made))
    try:
        yield
    finally:
        _open.reset(token)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have."""
    name = f"_{stem}"
    taken = {c.lower() for c in df.columns}
    return name if name.lower() not in taken else f"_{stem}_{uuid.uuid4().hex[:8]}"


def words_of(text: Column) -> Column:
    """The words of a whole text: runs without blank, tab, line or page breaks. Null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAPS), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bitmap_of(df: DataFrame, key: Column, words: int = BITMAP_WORDS, hashed: bool = False) -> np.ndarray:
    """A bitmap over the hashes of ``key``, or over ``key`` itself where it is a hash: ``words`` numbers reach the
    driver however many rows there are."""
    marked = (
        df.select((key if hashed else F.xxhash64(key)).alias("h"))
        .select(F.pmod(F.col("h"), F.lit(words)).alias("w"), F.shiftrightunsigned(F.col("h"), 58).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits"))
        .toArrow()  # two columns of numbers: a row object for each word would take far more of the driver's memory
    )
    found = np.zeros(words, dtype=np.int64)
    found[marked["w"].to_numpy()] = marked["bits"].to_numpy()
    return found.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which hashes (as ``xxhash64`` gives them, int64) are marked."""
    word = np.mod(hashed, np.int64(len(bitmap)))
    bit = hashed.view(np.uint64) >> np.uint64(58)
    return (bitmap[word] >> bit) & np.uint64(1) == 1


def importable(spark: SparkSession) -> None:
    """Let workers on this machine import the package from where the driver has it. Their Arrow batches are bounded in
    bytes by Spark's own setting, which stays as it is."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
