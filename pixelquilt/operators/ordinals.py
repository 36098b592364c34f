"""Row numbers and running sums over an order, without sending a group through one task.

A plain window over a key puts the whole key into one task. Here the order is first cut into buckets that
respect it: every (key, bucket) is numbered on its own, a small table of bucket totals gives each bucket its
offset, and the two are added. A key that holds a third of the rows is spread over all buckets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelquilt import config as C
from pixelquilt.functions.binding import let
from pixelquilt.functions.hashing import HASH_BITS

BUCKET = "_bucket"
#: Sampled values for each cut of a column that is no number.
SAMPLED_PER_CUT = 16
_OFFSET = "_offset"


def default_buckets(spark: SparkSession) -> int:
    """A few buckets per shuffle partition. The number only shapes tasks, results do not depend on it."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(64, 4 * partitions)


def keyed(df: DataFrame, key: str) -> DataFrame:
    """Partition by key in as many tasks as the session asks for.

    Narrow rows that each start heavy work must not be merged by their size: a fixed number of partitions is
    left alone by adaptive coalescing. A following join on the key reuses the partitioning.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def hash_bucket(hashed: Column, buckets: int) -> Column:
    """The leading bits of a 60-bit hash: uniform, and in the order of the hash."""
    bits = max(1, math.ceil(math.log2(buckets)))
    # Never null, so that the joins on it do not add a null test that hashes every row once more.
    return F.coalesce(F.shiftright(hashed, HASH_BITS - bits), F.lit(0))


@dataclass(frozen=True)
class OrderCuts:
    """Where an order column is cut into even buckets, and how many rows it has."""

    cuts: list
    rows: int

    def bucket(self, df: DataFrame, order: str, out: str = BUCKET) -> DataFrame:
        if not self.cuts:
            return df.withColumn(out, F.lit(0))
        if not _numeric(df, order):
            return df.withColumn(out, F.coalesce(_cuts_passed(F.col(order), self.cuts), F.lit(0)))
        splits = [-float("inf"), *self.cuts, float("inf")]
        numeric = f"{out}_v"
        cut = Bucketizer(splits=splits, inputCol=numeric, outputCol=out)
        placed = cut.transform(df.withColumn(numeric, F.col(order).cast("double"))).drop(numeric)
        return placed.withColumn(out, F.coalesce(F.col(out).cast("int"), F.lit(0)))


def _numeric(df: DataFrame, order: str) -> bool:
    return isinstance(df.schema[order].dataType, T.NumericType)


def _cuts_passed(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts are not above a value: first among the heads of runs of cuts, then in one run."""
    run = math.isqrt(len(cuts) - 1) + 1
    runs = [cuts[i : i + run] for i in range(0, len(cuts), run)]
    listed = F.array(*[F.array(*map(F.lit, r)) for r in runs])
    heads = F.array(*[F.lit(r[0]) for r in runs])

    def passed(among: Column) -> Column:
        return F.size(F.filter(among, lambda c: c <= value))

    return let(passed(heads), lambda n: F.when(n == 0, F.lit(0)).otherwise((n - 1) * run + passed(F.get(listed, n - 1))))


def order_cuts(df: DataFrame, order: str, buckets: int | None = None) -> OrderCuts:
    """Cut an order column at its quantiles, so that clustered or sparse keys still give even buckets.

    Reads that column alone, whole. At most ``buckets`` values and the row count reach the driver and become constants
    of the plan: any cuts are correct, only evenness depends on them, and a recomputed task sees the same. Numbers are
    cut at approximate quantiles; values of other types (strings, dates, binaries) at those of a sample of
    ``SAMPLED_PER_CUT`` values for each cut, the ones of the smallest hashes.
    """
    buckets = buckets or default_buckets(df.sparkSession)
    if not _numeric(df, order):
        return _sampled_cuts(df.select(order), order, buckets)
    narrow = df.select(F.col(order).cast("double").alias("v"))
    probabilities = [i / buckets for i in range(1, buckets)]
    # The sketch is merged where the rows lie, and the count comes with it: one pass.
    found = narrow.agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("v", probabilities, 2 * buckets).alias("cuts")).first()
    return OrderCuts(sorted(set(found["cuts"] or [])), found["rows"])


def _sampled_cuts(narrow: DataFrame, order: str, buckets: int) -> OrderCuts:
    """Cuts for any type that Spark orders; Spark itself orders the sample."""
    known = narrow.filter(F.col(order).isNotNull())
    sample = known.orderBy(F.xxhash64(order), order).limit(SAMPLED_PER_CUT * buckets)
    values = [r[0] for r in sample.orderBy(order).collect()]
    step = max(1, len(values) // buckets)
    return OrderCuts(list(dict.fromkeys(values[step::step])), narrow.count())


def bounded_broadcast(small: DataFrame, rows: int | None) -> DataFrame:
    """Hint a broadcast only where parameters bound the rows; otherwise leave the choice to Spark's size check."""
    if rows is not None and rows <= C.BROADCAST_ROWS:
        return F.broadcast(small)
    return small


def whole_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Group keys that are never null, so that joining on them loses no group.

    A nullable key is wrapped in a struct, which compares equal on a null inside and keeps the join an ordinary
    equality that can reuse the group's partitioning. Returns the table, the names to group by and the added ones.
    """
    wrapped = {f"_key_{k}": F.struct(k) for k in keys if df.schema[k].nullable}
    names = [f"_key_{k}" if f"_key_{k}" in wrapped else k for k in keys]
    return (df.withColumns(wrapped) if wrapped else df), names, list(wrapped)


def _group_count(keys: list[str], groups: int | None, buckets: int) -> int | None:
    if not keys:
        return buckets
    return None if groups is None else groups * buckets


def ordinal(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    out: str = "ord",
    bucket: str = BUCKET,
    buckets: int | None = None,
    groups: int | None = None,
) -> DataFrame:
    """Zero-based place of each row in its group. ``df`` carries ``bucket``, which must follow ``order``.

    ``groups`` is the number of key combinations where the caller knows it from parameters.
    """
    df, keys, added = whole_keys(df, keys)
    cells = [*keys, bucket]
    buckets = buckets or default_buckets(df.sparkSession)
    within = F.row_number().over(Window.partitionBy(*cells).orderBy(*order)) - 1
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*cells)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*cells, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias(_OFFSET))
    )
    offsets = bounded_broadcast(offsets, _group_count(keys, groups, buckets))
    return (
        df.withColumn(out, within)
        .join(offsets, cells)
        .withColumn(out, (F.col(out) + F.col(_OFFSET)).cast("bigint"))
        .drop(bucket, _OFFSET, *added)
    )


def id_ordinal(df: DataFrame, order: str, out: str = "ord", buckets: int | None = None, dense: bool = False) -> tuple[DataFrame, int]:
    """Zero-based place of each row of the table by a unique column of any type that has an order, and the table's row
    count. A column that already numbers the rows from 0 without gaps (``dense``) is taken as it is."""
    if dense:
        return df.withColumn(out, F.col(order).cast("bigint")), df.select(order).count()
    buckets = buckets or default_buckets(df.sparkSession)
    cuts = order_cuts(df, order, buckets)
    return ordinal(cuts.bucket(df, order), [], [order], out, buckets=buckets), cuts.rows


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: str,
    measures: dict[str, Column],
    inclusive: bool = True,
    buckets: int | None = None,
    bucket: str | None = None,
) -> DataFrame:
    """Add running sums per key along a numeric order column that is unique within the key.

    ``bucket`` names a column that already cuts the order; it is kept, so that a following step can use the same
    partitioning.
    """
    buckets = buckets or default_buckets(df.sparkSession)
    df, keys, added = whole_keys(df, keys)
    inputs = {name: f"_in_{name}" for name in measures}
    cut = df.withColumns({inputs[n]: c for n, c in measures.items()})
    if bucket is None:
        bucket = BUCKET
        added = [*added, BUCKET]
        cut = order_cuts(df, order, buckets).bucket(cut, order)
    cells = [*keys, bucket]
    upto = Window.partitionBy(*cells).orderBy(order)
    upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*cells).agg(*[F.sum(inputs[n]).alias(f"_all_{n}") for n in measures])
    offsets = totals.select(*cells, *[F.sum(f"_all_{n}").over(before).alias(f"_off_{n}") for n in measures])
    local = cut.withColumns({n: F.sum(inputs[n]).over(upto) for n in measures})
    zero = F.lit(0)
    joined = local.join(bounded_broadcast(offsets, _group_count(keys, None, buckets)), cells)
    return joined.withColumns(
        {n: F.coalesce(F.col(n), zero) + F.coalesce(F.col(f"_off_{n}"), zero) for n in measures}
    ).drop(*added, *inputs.values(), *[f"_off_{n}" for n in measures])
