"""Patch-vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelquilt.catalog.base import query, table
from pixelquilt.operators.features import grid_mean_pool, overlay_embeddings
from pixelquilt.sources.buckets import stored_by


def _long(df, *keys):
    rows = df.select(*keys, F.posexplode("vec").alias("dim", "x"))
    return rows.select(*keys, F.col("dim").cast("bigint").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("x"))


# Images of three crops with a leading vector and a 4 x 4 grid each, taken from the vectors in key order.
@query(
    "grid_mean_pool",
    """WITH v AS (SELECT vec_id // 51 AS image_id, vec_id % 51 // 17 AS crop_id, vec_id % 17 AS p, unnest(range(64)) AS dim, unnest(embedding) AS x FROM embeddings)
SELECT image_id, crop_id, CASE WHEN crop_id = 0 THEN p WHEN p = 0 THEN 0 ELSE 1 + ((p - 1) // 4 // 2) * 2 + (p - 1) % 4 // 2 END AS pos, dim,
 round(avg(x::DOUBLE), 6) AS x FROM v GROUP BY ALL""",
)
def _pool(spark, d):
    vec = F.col("vec_id")
    grids = table(spark, d, "embeddings").select(
        F.floor(vec / 51).alias("image_id"),
        F.floor(vec % 51 / 17).alias("crop_id"),
        (vec % 17).alias("pos"),
        F.col("embedding").alias("vec"),
    )
    return _long(grid_mean_pool(grids, ["image_id"], side=4, window=2), "image_id", "crop_id", "pos")


@query(
    "overlay_embeddings",
    """WITH w AS (SELECT vec_id // 20 AS sample_id, vec_id % 20 AS pos, CASE WHEN vec_id % 2 = 0 THEN vec_id % 20 // 2 ELSE -1 END AS patch_idx, embedding AS vec FROM embeddings),
p AS (SELECT vec_id // 20 AS sample_id, vec_id % 20 AS patch_idx, list_transform(embedding, lambda x: -x) AS vec FROM embeddings),
o AS (SELECT w.sample_id, w.pos, coalesce(p.vec, w.vec) AS vec FROM w LEFT JOIN p USING (sample_id, patch_idx))
SELECT sample_id, pos, unnest(range(64)) AS dim, round(unnest(vec)::DOUBLE, 6) AS x FROM o""",
)
def _overlay(spark, d):
    vec = F.col("vec_id")
    table_ = table(spark, d, "embeddings")
    words = table_.select(
        F.floor(vec / 20).alias("sample_id"),
        (vec % 20).alias("pos"),
        F.col("embedding").alias("vec"),
        F.when(vec % 2 == 0, F.floor(vec % 20 / 2)).otherwise(F.lit(-1)).cast("bigint").alias("patch_idx"),
    )
    patches = table_.select(
        F.floor(vec / 20).alias("sample_id"), (vec % 20).alias("patch_idx"), F.transform("embedding", lambda x: -x).alias("vec")
    )
    # Both lie by sample and place; the overlay moves neither.
    keys = ["sample_id", "patch_idx"]
    return _long(overlay_embeddings(stored_by(words, keys, "words"), stored_by(patches, keys, "patches")), "sample_id", "pos")
