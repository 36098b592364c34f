"""Generated ids to clean text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquilt.functions.prompts import strip_placeholders
from pixelquilt.functions.tags import restore_boxes, restore_points
from pixelquilt.operators.vocab import Vocabulary, token_strings


def with_target_sizes(outputs: DataFrame, sizes: DataFrame | None, key: str, default: tuple[int, int]) -> DataFrame:
    """Attach ``(th, tw)`` per output: the default for all of them, or one row of ``sizes`` each.

    An output without its size, with two, or a size without an output is an error.
    """
    if sizes is None:
        return outputs.withColumn("th", F.lit(default[0])).withColumn("tw", F.lit(default[1]))
    if set(sizes.columns) != {key, "th", "tw"}:
        raise ValueError("Target sizes need exactly a height and a width per output")
    wrong = F.raise_error(F.lit("Outputs and target sizes do not match one to one")).cast("int")
    single = sizes.groupBy(key).agg(F.count(F.lit(1)).alias("_sizes"), F.first("th").alias("th"), F.first("tw").alias("tw"))
    joined = outputs.withColumn("_output", F.lit(True)).join(single, key, "full")
    matched = F.col("_output").isNotNull() & (F.coalesce("_sizes", F.lit(0)) == 1)
    return joined.withColumns({c: F.when(matched, F.col(c)).otherwise(wrong) for c in ("th", "tw")}).drop("_sizes", "_output")


def clean_outputs(outputs: DataFrame, key: str, ids: str, vocab: Vocabulary | DataFrame, default: tuple[int, int], sizes: DataFrame | None = None) -> DataFrame:
    """``(key, text)``: tokens looked up, boxes and points back in image coordinates, placeholders removed.

    ``outputs`` carries ``height`` and ``width`` of each image; ``sizes`` the target size of each output, else all of
    them have the default.
    """
    sized = with_target_sizes(outputs.drop(ids), sizes, key, default)
    tokens = token_strings(outputs, key, ids, vocab).join(sized, key)
    args = [F.col(c) for c in ("height", "width", "th", "tw")]
    boxed = tokens.withColumn("tokens", restore_boxes(F.col("tokens"), *args))
    pointed = boxed.withColumn("tokens", restore_points(F.col("tokens"), *args))
    return pointed.select(key, strip_placeholders(F.array_join("tokens", " ")).alias("text"))
