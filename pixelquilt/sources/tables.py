"""Parquet samples in, batches and records out."""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("image_url", T.StringType()),
        T.StructField("conversations", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)


def scan_samples(
    spark: SparkSession, directory: str, schema: T.StructType | None = SAMPLE_SCHEMA, glob: str = "*.parquet"
) -> DataFrame:
    """The parquet entries directly in a directory. Columns a file lacks read as null."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{directory.rstrip('/')}/{glob}")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give heavy row-by-row work all cores when a small input comes in fewer splits than there are cores.

    ``df`` is a plain scan with its columns chosen. Inputs with enough splits are returned as they are, so no
    exchange is added where there is much to move.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def scan_file_list(spark: SparkSession, files: str, schema: T.StructType | None = SAMPLE_SCHEMA) -> DataFrame:
    """A comma-separated list of files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*files.split(","))


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def _name_pattern(prefixes: list[str]) -> str:
    """A file name pattern for parquet files that begin with one of the prefixes."""
    plain = [re.sub(r"([\\*?\[\]{},])", r"\\\1", p) for p in prefixes]
    return "{" + ",".join(plain) + "}*.parquet"


def scan_routed(
    spark: SparkSession, directory: str, rules: dict[str, list[str]], schema: T.StructType = SAMPLE_SCHEMA
) -> dict[str, DataFrame]:
    """One table per category from the files directly in a directory whose names match it; a category without files
    is empty.

    The scan itself filters the names, so a file is read once per category, however many of the category's prefixes
    it matches, and no path is collected.
    """
    return {
        category: spark.read.schema(schema).option("pathGlobFilter", _name_pattern(prefixes)).parquet(directory)
        if prefixes
        else spark.createDataFrame([], schema)
        for category, prefixes in rules.items()
    }


def with_row_order(df: DataFrame, out: str = "row_order") -> DataFrame:
    """Number the rows of a parquet scan in file order: files by path, rows by their place in the file.

    Gives samples without an id the unique numeric key that shards, shuffles and batches need. Numbers begin at 0 and
    have no gaps; of a filtered scan they keep order and stay unique. Nothing is sorted but the table of files.
    """
    names = {c.lower() for c in df.columns}
    path, place, before = (next(n for n in (f"_{stem}{'_' * i}" for i in range(len(names) + 1)) if n not in names) for stem in ("file", "place", "before"))
    where = F.col("_metadata.file_path").alias(path)
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns], where, F.col("_metadata.row_index").alias(place))
    files = df.select(where, F.col("_metadata.row_index").alias(place)).groupBy(path).agg((F.max(place) + 1).alias("_rows"))
    # One row for each file.
    earlier = Window.orderBy(path).rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select(path, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias(before))
    return rows.join(offsets, path).withColumn(out, F.col(place) + F.col(before)).drop(path, place, before)


def cached_scan(df: DataFrame, path: str | None = None) -> DataFrame:
    """Keep a scan for reuse: a written table where a path is given (it survives lost executors), else on disk."""
    if path is None:
        return df.persist(StorageLevel.DISK_ONLY)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def arrange_batches(df: DataFrame, batches_per_file: int = 4096) -> DataFrame:
    """Rows where ``write_samples`` writes them: by epoch, rank and run of consecutive batches, in order.

    A rank is split into runs of batches, so that no task writes a whole rank. Small runs may share a file.
    """
    run = F.floor(F.col("batch_id") / batches_per_file)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, "epoch", "rank", run).sortWithinPartitions("epoch", "rank", "batch_id", "pos")


def write_samples(df: DataFrame, path: str, batches_per_file: int = 4096, arranged: bool = False) -> None:
    """Batched rows by epoch and rank; files hold runs of consecutive batches, in order.

    ``arranged``: the rows went through ``arrange_batches`` while they were narrow and are written where they are.
    """
    rows = df if arranged else arrange_batches(df, batches_per_file)
    rows.write.partitionBy("epoch", "rank").mode("overwrite").parquet(path)


def metric_log(records: DataFrame, path: str, trigger: int) -> None:
    """Put the metric records of one trigger (a logging interval, a micro-batch) into the log.

    A trigger is a partition that is written as a whole: one that is put again, because its first writing failed or its
    caller did not hear of it, replaces itself. The log of all others is not touched.
    """
    numbered = records.withColumn("trigger", F.lit(trigger).cast("bigint"))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trigger").parquet(path)


def stream_metric_log(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same for a stream of records, each micro-batch under its own number: every record is in the log once."""
    query = (
        records.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: metric_log(batch, path, number))
        .start()
    )
    query.awaitTermination()
    return query
