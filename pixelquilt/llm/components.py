"""Connected components of a table of links, by alternating stars.

Every round each node sends its neighbours to the smallest of them (first the larger ones, then the smaller ones),
which halves distances; it ends with a star around the smallest node of every component. A round is two grouped
minima, summed where the links lie, and two joins; nothing is gathered, and every round is written to the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquilt.llm.common import delete, stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of a link; ``root`` is the smallest node of its component. Links may repeat, be
    given in any direction, or lead to themselves; null ends are ignored."""
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    loops = edges.filter("a = b").select(F.col("a").alias("node"))
    edges = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    spark, before = links.sparkSession, None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        last, edges = edges, stage(small.distinct(), "stars")
        delete(spark, [last.staged_at])
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")))
    lone = loops.distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    return roots.distinct().unionByName(lone)
