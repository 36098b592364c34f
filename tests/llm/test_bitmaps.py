"""Bitmaps of hashes: what the driver holds."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquilt.llm import common


def test_bitmaps_arrive_as_columns(spark, monkeypatch):
    """No row objects: a full bitmap has 2^18 words, of which each would be one."""
    kind = type(spark.range(1))
    for at in (kind, DataFrame):
        monkeypatch.setattr(at, "collect", lambda self: (_ for _ in ()).throw(AssertionError("rows on the driver")))
    df = spark.range(3000).select(F.xxhash64("id").alias("h"))
    found = common.bitmap_of(df, F.col("h"), words=64, hashed=True)
    own = np.array([r for r in df.toArrow()["h"].to_pylist()], np.int64)
    assert found.dtype == np.uint64 and common.in_bitmap(found, own).all()
    want = np.zeros(64, np.uint64)
    for h in own.tolist():
        want[h % 64] |= np.uint64(1 << ((h & (1 << 64) - 1) >> 58))
    assert (found == want).all() and not common.bitmap_of(df.limit(0), F.col("h")).any()
