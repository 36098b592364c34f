"""Patch vectors: grid pooling and overlay onto a sequence."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquilt import config as C


def pool_block(pos: Column, side: int, window: int) -> Column:
    """0 for the leading position of a crop, then the row-major block of a ``side`` x ``side`` grid."""
    cell = pos - 1
    row = F.floor(F.floor(cell / side) / window)
    column = F.floor((cell % side) / window)
    return F.when(pos == 0, F.lit(0)).otherwise(1 + row * (side // window) + column).cast("bigint")


def grid_mean_pool(
    df: DataFrame,
    keys: list[str],
    crop: str = "crop_id",
    pos: str = "pos",
    vec: str = "vec",
    side: int = C.POOL_SIDE,
    window: int = C.POOL_WINDOW,
) -> DataFrame:
    """Mean-pool each crop's grid in blocks; the first crop and every crop's leading vector pass unchanged.

    One pass over the vectors. The mean is a mergeable aggregate, so blocks shrink before the exchange; what
    passes unchanged is a block of its own.
    """
    if side % window:
        raise ValueError("The grid must divide into pooling blocks")
    block = F.when(F.col(crop) == 0, F.col(pos).cast("bigint")).otherwise(pool_block(F.col(pos), side, window))
    vectors = df.select(*keys, crop, block.alias(pos), array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    pooled = vectors.groupBy(*keys, crop, pos).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return pooled.select(*keys, crop, pos, vector_to_array("_m").alias(vec))


def overlay_embeddings(
    words: DataFrame,
    patches: DataFrame,
    sample: str = "sample_id",
    index: str = "patch_idx",
    vec: str = "vec",
) -> DataFrame:
    """Put patch vector ``patch_idx`` over the word vector wherever the index is not negative.

    ``words`` is (sample, pos, vec, patch_idx), ``patches`` is (sample, patch_idx, vec). Unused patches are
    fine, an index without a patch is an error. A null index means none. Rows without an index skip the join. Tables that
    are stored by (sample, index) in equal numbers of buckets (``sources.buckets.stored_by``) are joined where they lie;
    otherwise the vectors of both sides move.
    """
    plain = words.filter(F.coalesce(F.col(index), F.lit(-1)) < 0)
    placed = words.filter(F.col(index) >= 0).withColumnRenamed(vec, "_word")
    found = placed.join(patches.withColumn("_found", F.lit(True)), [sample, index], "left")
    missing = F.raise_error(F.lit("A patch index has no patch vector")).cast(patches.schema[vec].dataType)
    over = F.when(F.col("_found").isNull(), missing).otherwise(F.col(vec))
    replaced = found.withColumn(vec, over).select(*words.columns)
    return plain.unionByName(replaced)
