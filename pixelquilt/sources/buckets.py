"""Tables stored by key: written once in buckets, joined on these keys ever after without moving."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from pixelquilt.session import scratch_path


def default_bucket_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stored_by(df: DataFrame, keys: list[str], label: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """``df`` as a table of ``buckets`` buckets by ``keys``, rows sorted by them, read back.

    A join or grouping on all of ``keys`` takes the buckets as they lie: only the other side moves, and not even that
    where it is stored alike. ``path`` is where the table stays (by default a scratch folder); its catalog entry lasts
    as long as the session's catalog.
    """
    spark = df.sparkSession
    buckets = buckets or default_bucket_count(df)
    name = f"{label}_{uuid.uuid4().hex}"
    # One task fills one bucket, so that a table has as many files as buckets.
    arranged = df.repartition(buckets, *keys)
    arranged.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path or scratch_path(spark, label)).saveAsTable(name)
    return spark.table(name)
