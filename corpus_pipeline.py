"""The corpus pipeline: quality rules, near duplicates, repeated passages, pseudonyms, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all that the one before kept, and is written as Parquet and read
back before the next. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquilt.llm.chunk_dedup import remove_repeats
from pixelquilt.llm.common import delete, left_over, stage, table
from pixelquilt.llm.jaccard_join import keep_one
from pixelquilt.llm.packing import pack_documents
from pixelquilt.llm.pii import pseudonymise
from pixelquilt.llm.quality_rules import keep_good


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


_left: list[str] = []


def _staged_apart(step):
    """A stage whose input is a written table: what the stage before staged for its result is not needed any more."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, _left)
        _left.clear()
        with left_over(_left):
            return step(spark, docs, sf_dir)

    return run_step


@_staged_apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


@_staged_apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the one with the smallest id."""
    return keep_one(docs)


@_staged_apart
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur in an earlier document are cut."""
    return _measured(remove_repeats(docs))


@_staged_apart
def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced within its format."""
    return _measured(pseudonymise(docs))


@_staged_apart
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("pseudonyms", pseudonyms), ("packing", packed)]

#: Not expressible: tokenizers, rolling hashes and keyed digests. Tests compare single steps with plain versions, not the whole pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        delete(spark, written)
        written = [docs.staged_at]
    return STAGES[-1][1](spark, docs, sf_dir)
