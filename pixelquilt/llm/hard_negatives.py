"""Hard negatives over an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own (k-means on a bounded sample; every row is indexed). A
pair of codes is a cell. The half score of an anchor with all members of a code is at most its product with the centre
plus the code's radius times the length of the anchor's half, and at least their difference; two half bounds add up to
the bound of a cell.

An anchor asks for the first k scores inside windows. It visits cells by falling bounds, which a heap over the two
sorted half lists yields (multi-sequence), until they hold a certain number of rows: what is found there gives each
window a score that its k-th answer cannot be below. The second visit takes all cells whose bound reaches that score and
whose lower bound does not lie above the windows; with the next cell's bound below it, the windows are certified. So
each search is two passes over the index, however much it prunes.

Rows lie by their first code, large codes in segments; anchors are sent in blocks to the segments they visit.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelquilt.llm.common import importable, scratch, stage, table
from pixelquilt.llm.registry import query

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # of 100 parts of the positive's score
SCALE = 256
ANCHOR_EVERY, MOVED_EVERY, LABELS = 50, 7, 10

#: Rows that a cell should hold, the most codes of a half, and the rows on which codebooks are fitted.
CELL, MOST_CODES, SAMPLE, STEPS = 16, 256, 8192, 8
#: Rows of the cells that an anchor visits first.
PROBE = 4096
#: Rows of a segment, and anchors that meet it at once.
SEGMENT, ASKING = 8192, 2048
#: Room for rounding in bounds: they may only be too wide.
SLACK = 1e-9


def labelled_vectors(df: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """``row, id, label, x``: components as floor(scale * x). Rows without an id, a label or a finite vector go."""
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf"))) & F.col(label).isNotNull() & F.col(key).isNotNull()
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    return df.filter(fine).select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("x"))


@dataclass(frozen=True)
class Codebooks:
    """Two codebooks, the radii of their codes over all rows, and the rows of every cell."""

    cut: int
    width: int
    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] | None = None
    rows: np.ndarray | None = None

    @property
    def codes(self) -> int:
        return len(self.centres[0])

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    def half_bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Upper and lower bounds of the half scores, per anchor and code."""
        upper, lower = [], []
        for part, centres, radii in zip(self.halves(x), self.centres, self.radii):
            length = np.sqrt((part * part).sum(axis=1))[:, None]
            middle, reach = part @ centres.T, length * radii[None, :]
            room = SLACK * (np.abs(middle) + reach + 1)
            upper.append(middle + reach + room)
            lower.append(middle - reach - room)
        return upper, lower


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squared = (centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T
    code = squared.argmin(axis=1)
    return code, np.sqrt(((rows - centres[code]) ** 2).sum(axis=1))


def _fit_half(rows: np.ndarray, codes: int) -> np.ndarray:
    rows = np.unique(rows, axis=0)
    draw = np.random.default_rng(13)
    centres = rows[draw.permutation(len(rows))[:codes]].astype(float)
    for _ in range(STEPS):
        code, _ = _nearest(rows, centres)
        counts = np.bincount(code, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, code, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def fit_codebooks(sample: np.ndarray, rows: int) -> Codebooks:
    """Codes so many that cells hold about ``CELL`` rows, at most ``MOST_CODES`` a half. Any codes give right results."""
    width = sample.shape[1]
    cut = width // 2
    codes = min(MOST_CODES, max(1, round(math.sqrt(rows / CELL))))
    halves = [_fit_half(part, codes) for part in (sample[:, :cut], sample[:, cut:])]
    # Both halves get as many codes; a far centre is never the nearest, and no row has it.
    most = max(map(len, halves))
    halves = [np.concatenate([h, np.full((most - len(h), h.shape[1]), 0.0)]) if len(h) < most else h for h in halves]
    return Codebooks(cut, width, tuple(halves))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _unpack(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), width).astype(float)


def _slots(column) -> np.ndarray:
    """Numbers of each anchor's windows; NaN, which no score fits, where an anchor has fewer than others."""
    found = column.to_pylist()
    out = np.full((len(found), max(map(len, found), default=0)), np.nan)
    for row, values in zip(out, found):
        row[: len(values)] = values
    return out


def build_index(vectors: DataFrame, books: Codebooks) -> tuple[DataFrame, Codebooks]:
    """``row, id, label, x, c1, c2`` of all rows, written once, and the codebooks with radii and sizes."""

    def encode(batches):
        for batch in batches:
            x = _rows(batch.column(3), books.width)
            found = [_nearest(part, centres) for part, centres in zip(books.halves(x), books.centres)]
            packed = pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())
            columns = [*batch.columns[:3], packed, *[pa.array(code.astype(np.int32)) for code, _ in found], *[pa.array(far) for _, far in found]]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "label", "x", "c1", "c2", "far1", "far2"])

    index = stage(vectors.mapInArrow(encode, "row long, id long, label long, x binary, c1 int, c2 int, far1 double, far2 double"), "multi-index")
    k = books.codes
    radii, rows = np.zeros((2, k)), np.zeros((k, k), dtype=np.int64)
    # One row for each cell.
    for c1, c2, n, far1, far2 in index.groupBy("c1", "c2").agg(F.count(F.lit(1)), F.max("far1"), F.max("far2")).collect():
        rows[c1, c2], radii[0, c1], radii[1, c2] = n, max(radii[0, c1], far1), max(radii[1, c2], far2)
    return index.drop("far1", "far2"), Codebooks(books.cut, books.width, books.centres, (radii[0], radii[1]), rows)


def multi_sequence(first: np.ndarray, second: np.ndarray):
    """``bound, i, j`` of all cells by falling sums of their half bounds."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, seen = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, a[i], b[j]
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (-(first[a[p]] + second[b[q]]), p, q))


def probe_floor(first: np.ndarray, second: np.ndarray, rows: np.ndarray, low: float = -np.inf, below: np.ndarray | None = None, high: float = np.inf) -> float:
    """The bound at which the cells visited so far hold ``PROBE`` rows; ``low`` where they never do.

    ``below`` holds the cells' lower bounds: cells that lie above ``high`` as a whole are passed over.
    """
    held = 0
    for bound, i, j in multi_sequence(first, second):
        if bound < low:
            return low
        if below is None or below[i, j] <= high:
            held += rows[i, j]
        if held >= PROBE:
            return bound
    return low


ASKED = "c1 int, segment int, block int, row long, label long, x binary, low array<double>, high array<double>, floor double"


def send(anchors: DataFrame, books: Codebooks, segments: list[int], probe: bool) -> DataFrame:
    """Anchors at the segments that they visit. ``low`` and ``high`` hold a window for each slot, ``floor`` the bound
    below which no cell is visited; a probe sets it by going through its cells."""

    def plan(batches):
        for batch in batches:
            x = _unpack(batch.column(2), books.width)
            upper, lower = books.half_bounds(x)
            low, high = (batch.column(i).to_pylist() for i in (3, 4))
            block, floors = batch.column(6).to_pylist(), batch.column(5).to_pylist()
            out = [[] for _ in range(9)]
            for n in range(len(x)):
                least, most = min(low[n], default=np.inf), max(high[n], default=-np.inf)
                floor = floors[n]
                if probe:
                    floor = probe_floor(upper[0][n], upper[1][n], books.rows, least, lower[0][n][:, None] + lower[1][n][None, :], most)
                visited = (upper[0][n] + upper[1][n].max() >= floor) & (lower[0][n] + lower[1][n].min() <= most) & (books.rows.sum(axis=1) > 0)
                for c1 in np.flatnonzero(visited).tolist():
                    for segment in range(segments[c1]):
                        for column, value in zip(out, (c1, segment, block[n], batch.column(0)[n], batch.column(1)[n], batch.column(2)[n], low[n], high[n], floor)):
                            column.append(value)
            types = [pa.int32()] * 3 + [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            plain = [[v.as_py() if isinstance(v, pa.Scalar) else v for v in column] for column in out]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(plain, types)], [field.split()[0] for field in ASKED.split(", ")])

    return anchors.select("row", "label", "x", "low", "high", "floor", "block").mapInArrow(plan, ASKED)


def first_scores(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (anchor, row) of the first ``k`` allowed scores of each anchor, ties to smaller ids."""
    held = np.where(allowed, scores, -np.inf)
    if held.shape[1] > k:
        kth = np.partition(held, held.shape[1] - k, axis=1)[:, -k]
        allowed = allowed & (held >= kth[:, None])
    a, r = np.nonzero(allowed)
    order = np.lexsort((ids[r], -scores[a, r], a))
    a, r = a[order], r[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], r[place < k]


FOUND = "row long, slot int, id long, score long"


def search(index: DataFrame, asked: DataFrame, books: Codebooks, segments: list[int], blocks: int, same: bool, k: int) -> DataFrame:
    """``row, slot, id, score``: of each segment the first ``k`` of every window, among rows of the anchor's label
    (``same``) or of other labels."""
    width = books.width

    def meet(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if rows.num_rows and anchors.num_rows:
            get = lambda t, name: t.column(name).combine_chunks()
            x, asking = _unpack(get(rows, "x"), width), _unpack(get(anchors, "x"), width)
            ids, labels, places, codes = (get(rows, c).to_numpy() for c in ("id", "label", "row", "c2"))
            own, own_labels, floor = (get(anchors, c).to_numpy() for c in ("row", "label", "floor"))
            low, high = (_slots(get(anchors, c)) for c in ("low", "high"))
            most = np.fmax.reduce(high, axis=1, initial=-np.inf)
            upper, lower = books.half_bounds(asking)
            c1 = int(rows.column("c1")[0].as_py())
            best: list[tuple] = []
            order = np.argsort(codes, kind="stable")
            for cell in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                c2 = codes[cell[0]]
                come = np.flatnonzero((upper[0][:, c1] + upper[1][:, c2] >= floor) & (lower[0][:, c1] + lower[1][:, c2] <= most))
                if not len(come):
                    continue
                scores = asking[come] @ x[cell].T
                fits = (own_labels[come][:, None] == labels[cell][None, :]) == same
                fits &= own[come][:, None] != places[cell][None, :]
                for slot in range(low.shape[1]):
                    inside = fits & (scores >= low[come, slot][:, None]) & (scores <= high[come, slot][:, None])
                    a, r = first_scores(scores, ids[cell], inside, k)
                    best.append((come[a], np.full(len(a), slot), ids[cell][r], scores[a, r].astype(np.int64)))
            if best:
                a, slot, i, s = (np.concatenate(v) for v in zip(*best))
                order = np.lexsort((i, -s, slot, a))
                a, slot, i, s = a[order], slot[order], i[order], s[order]
                group = a * low.shape[1] + slot
                keep = np.arange(len(a)) - np.searchsorted(group, group) < k
                out = [own[a[keep]], slot[keep].astype(np.int32), i[keep], s[keep]]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(v, t) for v, t in zip(out, types)], [field.split()[0] for field in FOUND.split(", ")])

    keys = ["c1", "segment", "block"]
    parts = F.element_at(F.array(*[F.lit(s) for s in segments]), F.col("c1") + 1)
    spread = index.withColumn("segment", F.pmod(F.xxhash64("row"), parts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.select(*keys, "c2", "row", "id", "label", "x").groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each slot, with their ``rank``."""
    place = F.row_number().over(Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def certified(index: DataFrame, anchors: DataFrame, books: Codebooks, same: bool, k: int, blocks: int, label: str) -> DataFrame:
    """``row, slot, rank, id, score`` for anchors ``row, label, x, low, high``: the first ``k`` of every window."""
    segments = [max(1, -(-int(n) // SEGMENT)) for n in books.rows.sum(axis=1)]
    asked = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("floor", F.lit(0.0))
    probed = stage(best_of(search(index, send(asked, books, segments, True), books, segments, blocks, same, k), k), f"{label}-probe")
    # A window's k-th score so far: its answers are not below it, and neither are the cells that can hold them.
    least = probed.filter(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.col("score").cast("double")))).alias("_least"))
    known = asked.join(least, "row", "left")
    raised = F.transform(F.col("low"), lambda v, i: F.coalesce(F.get(F.transform(F.array("_least"), lambda m: m[i]), F.lit(0)), v))
    sure = known.withColumn("low", F.when(F.col("_least").isNull(), F.col("low")).otherwise(raised)).drop("_least")
    sure = sure.withColumn("floor", F.array_min("low"))
    return stage(best_of(search(index, send(sure, books, segments, False), books, segments, blocks, same, k), k), label)


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``id``. An anchor's positives are its first rows of the same label, itself left out;
    for each of them come the first rows of another label whose score lies between 50 and 95 hundredths of the
    positive's. First means a higher score, then a smaller id. A positive whose window is empty (also where its score is
    negative) gives no row. Rows without an id, a label or a finite vector take no part; shorter vectors are read as
    filled up with zeros. Rows that repeat an id are rows of their own, as anchors too. Squared lengths of 2^53 and more
    are an error.
    """
    spark = df.sparkSession
    importable(spark)
    vectors = labelled_vectors(df, key, vector, label, scale)
    squared = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    rows, width, longest = vectors.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(squared)).first()
    if not rows:
        return spark.createDataFrame([], OUT)
    if longest >= 2**53:
        raise ValueError("Vectors are too long for exact products")
    with scratch(spark) as keep:
        return keep(stage(_mined(vectors, is_anchor, rows, max(2, width), positives, negatives), "hard-negatives"))


def _mined(vectors: DataFrame, is_anchor: Column, rows: int, width: int, positives: int, negatives: int) -> DataFrame:
    sample = [r["x"] for r in vectors.orderBy(F.xxhash64("id", "x")).select("x").limit(SAMPLE).collect()]
    index, books = build_index(vectors, fit_codebooks(np.array([x + [0.0] * (width - len(x)) for x in sample]), rows))
    anchors = index.filter(is_anchor).select("row", "id", "label", "x")
    blocks = max(1, -(-anchors.count() // ASKING))
    open_window = anchors.withColumns({"low": F.array(F.lit(float("-inf"))), "high": F.array(F.lit(float("inf")))})
    found = certified(index, open_window, books, True, positives, blocks, "positives").select("row", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    score = F.col("positive_score")
    low, high = F.ceil(score * LOW / 100.0).cast("double"), F.floor(score * HIGH / 100.0).cast("double")
    # At most ``positives`` windows an anchor, by the positive's place.
    windows = found.filter(low <= high).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", low.alias("low"), high.alias("high"), "positive_id", "positive_score"))).alias("w"))
    windows = windows.select("row", F.col("w.low").alias("low"), F.col("w.high").alias("high"), F.col("w.positive_id").alias("p_id"), F.col("w.positive_score").alias("p_score"))
    asking = stage(anchors.join(windows, "row"), "windows")
    hard = certified(index, asking, books, False, negatives, blocks, "negatives")
    named = hard.join(asking.select("row", F.col("id").alias("anchor_id"), "p_id", "p_score"), "row")
    slot = F.col("slot") + 1
    return named.select(
        "anchor_id", F.element_at("p_id", slot).alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.element_at("p_score", slot).alias("positive_score"), F.col("score").alias("negative_score")
    )


SQL = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % {MOVED_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
  list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
 FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""


@query("op13_hard_negatives", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % ANCHOR_EVERY == 0)
