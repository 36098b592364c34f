"""Routed samples with resolved images and their sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquilt.functions.prompts import has_image, resolve_image_ref
from pixelquilt.operators.routing import route_by_prefix
from pixelquilt.sources.images import with_image_size


def ingest(samples: DataFrame, rules: dict[str, list[str]], image_dir: str, sizes: DataFrame | None = None) -> DataFrame:
    """Route by source, resolve image references, attach sizes; hq rows lose their source."""
    routed = route_by_prefix(samples, rules)
    resolved = routed.withColumn("has_image", has_image(F.col("image_url"))).withColumn(
        "image_path", resolve_image_ref(F.col("image_url"), image_dir)
    )
    sourced = resolved.withColumn("source", F.when(F.col("category") != "hq", F.col("source")))
    return with_image_size(sourced, sizes) if sizes is not None else sourced
