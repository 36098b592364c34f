"""Exact top-k inner products by pivot elimination.

With e = |q|^2 + |x|^2 - 2 q.x, the squared distance, a score is known from the distance. The distances of every vector
to the pivots are computed once and kept; |d(q, p) - d(x, p)| is a lower bound of d(q, x) for every pivot p, the largest
of them the best, and gives an upper bound of the score. Candidates are scored in the order of that bound, and a query
is finished when the next bound is below its k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelquilt.llm.common import importable, stage, table
from pixelquilt.llm.registry import query

K = 5
PIVOTS = 24
QUERY_EVERY = 50
SCALE = 256
#: Queries that a pass over the table answers; their vectors are all that a pass ships to the tasks.
QUERIES_PER_PASS = 4096
#: Candidates that a task bounds at once.
BLOCK = 4096
#: Room for rounding in bounds: they may only be too large.
SLACK = 1e-9


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``id, x``: components as floor(scale * x). Null vectors, and those with a null or non-finite component, go."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    return df.filter(fine).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("x")).filter(F.col("id").isNotNull())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros, which adds nothing to a product."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.float64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (rows**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squared, 0))


def choose_pivots(vectors: DataFrame, width: int, count: int = PIVOTS, pool: int = 1024) -> np.ndarray:
    """Pivots far from each other, from a pool of ``pool`` vectors with the smallest hashes. Any choice is correct."""
    held = [r["x"] for r in vectors.orderBy(F.xxhash64("id", "x")).limit(pool).collect()]
    rows = np.array([x + [0] * (width - len(x)) for x in held], dtype=np.float64).reshape(-1, width)
    if not len(rows):
        return rows
    chosen, nearest = [0], _distances(rows, rows[:1])[:, 0]
    while len(chosen) < min(count, len(rows)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id, x, to_pivots``."""
    width = pivots.shape[1]

    def measure(batches):
        for batch in batches:
            found = _distances(_matrix(batch.column(1), width), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.tolist(), pa.list_(pa.float64()))], ["id", "x", "to_pivots"])

    return vectors.mapInArrow(measure, "id long, x array<long>, to_pivots array<double>")


class Searcher:
    """The best candidates so far of a set of queries, in one task."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, to_pivots: np.ndarray, k: int):
        self.ids, self.rows, self.to_pivots, self.k = ids, rows, to_pivots, k
        self.norms = (rows**2).sum(1)
        self.best = [[] for _ in ids]  # of (-score, id), in order
        self.scored = 0

    def offer(self, ids: np.ndarray, rows: np.ndarray, to_pivots: np.ndarray) -> None:
        norms = (rows**2).sum(1)
        for q in range(len(self.ids)):
            lower = np.abs(to_pivots - self.to_pivots[q]).max(axis=1)
            lower = np.maximum(lower - SLACK * (np.abs(to_pivots).max(axis=1) + np.abs(self.to_pivots[q]).max() + 1), 0)
            upper = (norms + self.norms[q]) * (1 + SLACK) / 2 - lower**2 / 2
            self._search(q, ids, rows, upper)

    def _search(self, q: int, ids, rows, upper) -> None:
        best = self.best[q]
        step = 64
        alive = np.arange(len(ids)) if len(best) < self.k else np.flatnonzero(upper >= -best[-1][0])
        if not len(alive):
            return
        # The first candidates by bound are found without sorting the rest, which they mostly rule out.
        if len(alive) > step:
            first = np.argpartition(-upper[alive], step)[:step]
            self._score(q, ids, rows, alive[first])
            alive = np.delete(alive, first)
            if len(best) >= self.k:
                alive = alive[upper[alive] >= -best[-1][0]]
        alive = alive[np.argsort(-upper[alive], kind="stable")]
        at = 0
        while at < len(alive) and (len(best) < self.k or upper[alive[at]] >= -best[-1][0]):
            self._score(q, ids, rows, alive[at : at + step])
            at, step = at + step, 2 * step

    def _score(self, q: int, ids, rows, at) -> None:
        scores = rows[at] @ self.rows[q]
        self.scored += len(at)
        best = self.best[q]
        if len(best) >= self.k:
            keep = scores >= -best[-1][0]
            at, scores = at[keep], scores[keep]
        best += [(-int(s), int(i)) for s, i in zip(scores, ids[at]) if i != self.ids[q]]
        best.sort()
        del best[self.k :]


def top_k(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K, pivots: int = PIVOTS, scale: int = SCALE) -> DataFrame:
    """The ``k`` highest integer inner products of every query with all other rows: ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition on the column ``id``. Ties go to the smaller id; with fewer candidates all are
    returned. A row whose id is null takes no part, nor do rows without a finite vector. Vectors of unequal length are
    compared over the components they share. Repeated rows are candidates of their own, except for rows that repeat
    the query's id; a query that repeats is answered once. Squared lengths of 2^53 and more are an error.
    """
    spark = df.sparkSession
    importable(spark)
    vectors = whole_vectors(df, key, vector, scale)
    squared = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    longest, most = vectors.agg(F.max(F.size("x")), F.max(squared)).first()
    if most is not None and most >= 2**53:
        raise ValueError("Vectors are too long for exact products")
    width = max(1, longest or 0)
    chosen = choose_pivots(vectors, width, pivots)
    schema = "query_id long, neg_score long, vec_id long"
    if not len(chosen):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    held = stage(pivot_table(vectors, chosen), "pivot-table")
    # Query sets are cut by their ids' hashes into passes of a bounded size; each pass bounds all rows of the table.
    queries = held.filter(is_query).dropDuplicates(["id"])
    passes = max(1, -(-queries.count() // (QUERIES_PER_PASS // 2)))
    results = None
    for turn in range(passes):
        asked = queries.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == turn).collect()
        if not asked:
            continue
        ids = np.array([r["id"] for r in asked], dtype=np.int64)
        rows = np.array([r["x"] + [0] * (width - len(r["x"])) for r in asked], dtype=np.float64)
        near = np.array([r["to_pivots"] for r in asked], dtype=np.float64)

        def search(batches, ids=ids, rows=rows, near=near):
            searcher = Searcher(ids, rows, near, k)
            for batch in batches:
                searcher.offer(batch.column(0).to_numpy(), _matrix(batch.column(1), width), _matrix(batch.column(2), near.shape[1]))
            found = [(int(q), s, i) for q, best in zip(ids, searcher.best, strict=True) for s, i in best]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), (), ()))], ["query_id", "neg_score", "vec_id"])

        found = held.mapInArrow(search, schema)
        found = stage(found, "top-k") if passes > 1 else found
        results = found if results is None else results.unionByName(found)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("neg_score", "vec_id"))
    return results.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", (-F.col("neg_score")).alias("score"))


SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""


@query("op7_top_k", SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % QUERY_EVERY == 0)
