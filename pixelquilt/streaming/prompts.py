"""Prompt rows of newly arrived files; the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pixelquilt.functions import tokens as K
from pixelquilt.functions.prompts import caption_prompt
from pixelquilt.operators.routing import matching_categories


def prompt_rows(samples: DataFrame, rules: dict[str, list[str]], key: str, text: str, max_length: int, seed: int) -> DataFrame:
    """Render, tokenise, clip and label each row that has a category, then route it. Works on batch and streaming
    tables; a row of several categories is tokenised once."""
    wanted = samples.withColumn("_categories", matching_categories(F.col("source"), rules)).filter(F.size("_categories") > 0)
    prompted = wanted.withColumn("_prompt", caption_prompt(F.col(text), F.col(key), seed))
    clipped = prompted.withColumn("input_ids", K.tokenize_clipped(F.col("_prompt"), max_length))
    labelled = clipped.withColumn("labels", K.label_mask(F.col("input_ids")))
    return labelled.select(key, F.explode("_categories").alias("category"), "input_ids", "labels")


def read_arrivals(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process all files that are there and stop; a later call continues with the new ones."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return query
