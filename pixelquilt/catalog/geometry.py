"""Image geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelquilt.catalog.base import DOC_SIZES, doc_sizes, query, table
from pixelquilt.functions import geometry
from pixelquilt.plans.crops import crop_plan

def _sql_best(candidates, source=DOC_SIZES):
    values = ", ".join(f"({i}, {w}, {h})" for i, (w, h) in enumerate(candidates))
    return f"""SELECT doc_id, width, height, tw, th FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY eff DESC, tw * th - eff, i) AS rn FROM (
  SELECT *, least(trunc(width * s)::BIGINT * trunc(height * s)::BIGINT, width * height) AS eff FROM (
   SELECT *, least(tw::DOUBLE / width, th::DOUBLE / height) AS s
   FROM ({source}), (VALUES {values}) AS c(i, tw, th)))) WHERE rn = 1"""


_CANDIDATES = geometry.middle_candidates()


@query("best_resolution", f"SELECT doc_id, tw::BIGINT AS tw, th::BIGINT AS th FROM ({_sql_best(_CANDIDATES)})")
def _best(spark, d):
    sizes = doc_sizes(table(spark, d, "documents"))
    return sizes.select("doc_id", geometry.best_resolution(F.col("width"), F.col("height"), _CANDIDATES).alias("b")).select("doc_id", "b.*")


@query(
    "crop_plan",
    f"""WITH best AS ({_sql_best(_CANDIDATES)}),
levels AS (SELECT doc_id, 'middle' AS level, tw AS rw, th AS rh, 1 AS first FROM best
 UNION ALL SELECT doc_id, 'high', tw * 3, th * 3, 5 FROM best)
SELECT doc_id, 0::BIGINT AS crop_id, 'whole' AS level, 336::BIGINT AS resize_w, 336::BIGINT AS resize_h, 0::BIGINT AS x0, 0::BIGINT AS y0,
 336::BIGINT AS x1, 336::BIGINT AS y1 FROM best
UNION ALL SELECT doc_id, (first + y.range // 336 * (rw // 336) + x.range // 336)::BIGINT, level, rw::BIGINT, rh::BIGINT, x.range, y.range,
 x.range + 336, y.range + 336 FROM levels, range(0, 4032, 336) x, range(0, 4032, 336) y WHERE x.range < rw AND y.range < rh""",
)
def _crops(spark, d):
    return crop_plan(doc_sizes(table(spark, d, "documents")), "doc_id")


@query(
    "patch_grid",
    """SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY y0, x0) - 1 AS patch, x0, y0, x0 + 64 AS x1, y0 + 64 AS y1
FROM (SELECT p_partkey, unnest(range(0, p_size * 13, 64)) AS x0, p_size FROM part) a, LATERAL (SELECT unnest(range(0, a.p_size * 9, 64)) AS y0)""",
)
def _patch_grid(spark, d):
    boxes = geometry.patch_boxes(F.col("p_size") * 13, F.col("p_size") * 9, 64)
    return table(spark, d, "part").select("p_partkey", F.explode(boxes).alias("b")).select("p_partkey", "b.*")


@query(
    "fit_and_pad",
    f"""SELECT doc_id, nw, nh, (672 - nw) // 2 AS px, (336 - nh) // 2 AS py FROM (
SELECT doc_id, CASE WHEN sw < sh THEN 672 ELSE least(ceil(width * sh)::BIGINT, 672) END AS nw,
 CASE WHEN sw < sh THEN least(ceil(height * sw)::BIGINT, 336) ELSE 336 END AS nh
FROM (SELECT *, 672::DOUBLE / width AS sw, 336::DOUBLE / height AS sh FROM ({DOC_SIZES})))""",
)
def _fit_and_pad(spark, d):
    sizes = doc_sizes(table(spark, d, "documents"))
    return sizes.select("doc_id", geometry.fit_and_pad(F.col("width"), F.col("height"), 672, 336).alias("g")).select("doc_id", "g.*")


_PINPOINTS = [(336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008)]


@query("grid_shape", f"SELECT doc_id, (tw // 336)::BIGINT AS across, (th // 336)::BIGINT AS down FROM ({_sql_best(_PINPOINTS)})")
def _grid_shape(spark, d):
    sizes = doc_sizes(table(spark, d, "documents"))
    return sizes.select("doc_id", geometry.grid_shape(F.col("width"), F.col("height"), str(_PINPOINTS), 336).alias("g")).select("doc_id", "g.*")
