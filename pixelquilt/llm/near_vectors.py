"""Near duplicates among vectors, by collisions of one-dimensional projections.

Unit vectors at a cosine of at least t lie within d = sqrt(2 - 2t) of each other, so their projections onto a random
direction differ by about N(0, d^2 / width) whatever the vectors are. Every vector is a query: with its projections as
the middles of windows, a pair collides in a direction if the other's projection falls into the window. Pairs that
collide in at least as many directions as a pair at the threshold does in all but one case in 10 000 are verified by
their cosine in double precision.

Windows over a whole table hold a fixed share of it, so sortings are cut first: in each of several tables a few
half-spaces through the middle of the data name a block, blocks keep their size as the table grows (there are more
half-spaces), and the number of tables is what a pair at the threshold needs to share a block with near certainty,
measured on a bounded sample. A block of vectors that no half-space parts is sorted by the table's own direction and
cut into slabs as wide as a window, these into chunks, and only chunks of one slab or of neighbours meet.

Equal vectors are one class from the start. Links are counted where they are found, in the first table that their ends
share; what leaves a task is a number for each vector and a spanning forest, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelquilt.llm.common import importable, scratch, stage, table
from pixelquilt.llm.components import components
from pixelquilt.llm.registry import query
from pixelquilt.operators.ordinals import bounded_broadcast

LEAST_COSINE = 0.95
DIRECTIONS = 24
#: Half the width of a window, in deviations of a pair at the threshold; of the windows that cut a sorting, too.
WINDOW, SORT_WINDOW = 2.0, 4.0
#: Chances of a pair at the threshold to be counted often enough, and to share a block in some table.
COUNT_RECALL, TABLE_RECALL = 0.9999, 0.9998
#: Vectors of the sample on which half-spaces and the number of tables are set, and the most tables.
SAMPLE, MOST_TABLES = 4096, 64
#: Vectors that a block should hold, that a block may hold before it is cut, and those of a chunk of a cut block.
BLOCK, MOST_IN_BLOCK, CHUNK = 1024, 4096, 2048
#: Query rows whose windows are counted at a time.
ROWS = 256
SEED = 20


def vector_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, cls, v``: a digest of the vector and its bytes, both null where the vector cannot link."""
    v = F.col(vector)
    single = df.schema[vector].dataType.elementType == T.FloatType()
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = df.select(F.col(key).cast("long").alias("id"), F.when(fine, v if single else v.cast("array<double>")).alias("v"))
    item = 4 if single else 8

    def digest(batches):
        for batch in batches:
            found = batch.column(1)
            raw = found.flatten().to_numpy(zero_copy_only=False).astype(f"<f{item}").tobytes()
            ends = np.cumsum(np.where(found.is_valid().to_numpy(zero_copy_only=False), found.value_lengths().fill_null(0).to_numpy(), 0)) * item
            values, at = [], 0
            for valid, end in zip(found.is_valid().to_pylist(), ends.tolist()):
                values.append(raw[at:end] if valid else None)
                at = end
            classes = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes, pa.binary()), pa.array(values, pa.binary())], ["id", "cls", "v"])

    return kept.mapInArrow(digest, "id long, cls binary, v binary")


def _matrix(values: list[bytes], width: int, item: int) -> np.ndarray:
    """Vectors as rows, scaled by their largest component; shorter ones are filled up with zeros."""
    out = np.zeros((len(values), width))
    for row, raw in zip(out, values):
        found = np.frombuffer(raw, f"<f{item}")
        row[: len(found)] = found
    return out / np.abs(out).max(axis=1, keepdims=True) if len(out) else out


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


_erf = np.vectorize(math.erf, otypes=[float])


@dataclass(frozen=True)
class Sortings:
    """Directions, windows, and the half-spaces of each table."""

    directions: np.ndarray  # width x DIRECTIONS, unit columns
    planes: np.ndarray  # tables x width x bits
    middles: np.ndarray  # tables x bits
    window: float
    sort_window: float
    needed: int

    @property
    def tables(self) -> int:
        return len(self.planes)

    def places(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Projections (float32) and the block of each table."""
        bits = np.einsum("nw,twk->ntk", units, self.planes) > self.middles
        return (units @ self.directions).astype(np.float32), (bits * (1 << np.arange(bits.shape[2]))).sum(axis=2).astype(np.int32)


def collisions_needed(chance: float, directions: int = DIRECTIONS, recall: float = COUNT_RECALL) -> int:
    """The largest count that a pair reaches with probability ``recall`` if each direction collides with ``chance``."""
    tail = 0.0
    for count in range(directions, -1, -1):
        tail += math.comb(directions, count) * chance**count * (1 - chance) ** (directions - count)
        if tail >= recall:
            return count
    return 0


def calibrate(sample: np.ndarray, rows: int, least: float = LEAST_COSINE, block: int = BLOCK) -> Sortings:
    """Half-spaces enough for blocks of about ``block`` vectors, tables enough for the recall on the sample.

    Where even the most tables would lose too many pairs, fewer half-spaces are used, down to none: then all vectors
    share one block.
    """
    draw = np.random.default_rng(SEED)
    width = sample.shape[1]
    sample = sample if len(sample) else np.zeros((1, width))
    directions = draw.normal(size=(width, DIRECTIONS))
    directions /= np.linalg.norm(directions, axis=0)
    spread = math.sqrt(max(2 - 2 * least, 1e-12) / width)
    needed = collisions_needed(math.erf(WINDOW / math.sqrt(2)))
    in_sorting = math.erf(SORT_WINDOW / math.sqrt(2))
    for bits in range(max(0, math.ceil(math.log2(max(rows, 1) / block))), -1, -1):
        planes, middles, missed = [], [], np.ones(len(sample))
        while len(planes) < MOST_TABLES and missed.mean() > 1 - TABLE_RECALL:
            normals = draw.normal(size=(width, bits))
            normals /= np.linalg.norm(normals, axis=0)
            at = sample @ normals
            middle = np.median(at, axis=0)
            together = (0.5 + 0.5 * _erf(np.abs(at - middle) / (spread * math.sqrt(2)))).prod(axis=1) if bits else np.ones(len(sample))
            missed = missed * (1 - together * in_sorting)
            planes.append(normals)
            middles.append(middle)
        if missed.mean() <= 1 - TABLE_RECALL or not bits:
            break
    return Sortings(directions, np.array(planes), np.array(middles).reshape(len(planes), bits), WINDOW * spread, SORT_WINDOW * spread, needed)


def place_in_tables(classes: DataFrame, sortings: Sortings, width: int, item: int) -> DataFrame:
    """One row for each class and table: ``table, block, slab, cls, v, copies, at, blocks``.

    Projections and blocks are computed here alone, so that all tasks agree on them.
    """

    def place(batches):
        for batch in batches:
            values = batch.column(1).to_pylist()
            if not values:
                continue
            at, blocks = sortings.places(_units(_matrix(values, width, item)))
            own_at, own_blocks = (pa.array([row.tobytes() for row in x], pa.binary()) for x in (at, blocks))
            for t in range(sortings.tables):
                slab = np.floor(at[:, t % DIRECTIONS].astype(float) / sortings.sort_window).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), t, np.int32)), pa.array(blocks[:, t]), pa.array(slab), *batch.columns, own_at, own_blocks], ["table", "block", "slab", "cls", "v", "copies", "at", "blocks"]
                )

    return classes.select("cls", "v", "copies").mapInArrow(place, "table int, block int, slab int, cls binary, v binary, copies long, at binary, blocks binary")


TILE = ["table", "block", "low", "high", "i", "j"]


def tiles(placed: DataFrame) -> DataFrame:
    """Rows at the tiles in which they are compared, with their ``side``: 0 and 1 meet each other, 2 meet among themselves.

    A block of bounded size is one tile. A larger one has a tile for each two chunks of one slab or of neighbouring slabs.
    """
    cell = ["table", "block", "slab"]
    sizes = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("rows"))
    large = sizes.groupBy("table", "block").agg(F.sum("rows").alias("all")).filter(F.col("all") > MOST_IN_BLOCK)
    chunks = stage(sizes.join(large.drop("all"), ["table", "block"]).select(*cell, F.ceil(F.col("rows") / CHUNK).cast("int").alias("own")), "chunks")
    # A row for each slab of a large block; few unless much of the table lies close together.
    known = chunks.count()
    near = chunks
    for step, name in ((1, "after"), (-1, "before")):
        near = near.join(chunks.select("table", "block", (F.col("slab") - step).alias("slab"), F.col("own").alias(name)), cell, "left")
    joined = placed.join(bounded_broadcast(near, known), cell, "left")
    mine = F.pmod(F.xxhash64("cls"), F.col("own")).cast("int")

    def others(count, tile):
        return F.transform(F.sequence(F.lit(0), count - 1), tile)

    def tile(low, high, i, j, side):
        return F.struct(*[x.cast("int").alias(n) for n, x in zip([*TILE[2:], "side"], (low, high, i, j, side))])

    slab, none = F.col("slab"), F.lit(0)
    whole = F.array(tile(none, none, none, none, F.lit(2)))
    within = others(F.col("own"), lambda o: tile(slab, slab, F.least(o, F.col("_i")), F.greatest(o, F.col("_i")), F.when(o == F.col("_i"), 2).otherwise((o < F.col("_i")).cast("int"))))
    after = F.when(F.col("after").isNotNull(), others(F.col("after"), lambda o: tile(slab, slab + 1, F.col("_i"), o, none))).otherwise(F.slice(whole, 1, 0))
    before = F.when(F.col("before").isNotNull(), others(F.col("before"), lambda o: tile(slab - 1, slab, o, F.col("_i"), none + 1))).otherwise(F.slice(whole, 1, 0))
    spread = joined.withColumn("_i", mine).withColumn("_t", F.explode(F.when(F.col("own").isNull(), whole).otherwise(F.concat(within, after, before))))
    return spread.select("table", "block", *[F.col(f"_t.{c}").alias(c) for c in [*TILE[2:], "side"]], "cls", "v", "copies", "at", "blocks")


def forest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches by the pairs ``a, b``."""
    label = np.arange(nodes)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    return label


class Tile:
    """Vectors of one tile, and the pairs among them that are linked."""

    def __init__(self, sortings: Sortings, turn: int, values: list[bytes], at: np.ndarray, blocks: np.ndarray, width: int, item: int, least: float):
        self.sortings, self.turn, self.at, self.blocks, self.least = sortings, turn, at, blocks, least
        self.rows = _matrix(values, width, item)
        self.norms = np.sqrt((self.rows**2).sum(axis=1))
        self.counted = self.verified = 0

    def candidates(self, asking: np.ndarray, others: np.ndarray, diagonal: bool):
        """Pairs of rows that collide often enough. Both sides are sorted by the table's direction."""
        own = self.turn % DIRECTIONS
        others = others[np.argsort(self.at[others, own], kind="stable")]
        asking = others if diagonal else asking[np.argsort(self.at[asking, own], kind="stable")]
        sorted_at = self.at[others, own]
        for start in range(0, len(asking), ROWS):
            asks = asking[start : start + ROWS]
            x = self.at[asks]
            low = start + 1 if diagonal else np.searchsorted(sorted_at, x[0, own] - np.float32(self.sortings.sort_window) * np.float32(1.001))
            high = np.searchsorted(sorted_at, x[-1, own] + np.float32(self.sortings.sort_window) * np.float32(1.001), "right")
            if low >= high:
                continue
            y = self.at[others[low:high]]
            self.counted += len(x) * len(y)
            window, half = np.float32(self.sortings.window), DIRECTIONS // 2
            hits = np.zeros((len(x), len(y)), dtype=np.int8)
            for d in range(half):
                hits += np.abs(x[:, d, None] - y[None, :, d]) <= window
            # The rest of the directions are counted for pairs that can still get there.
            i, j = np.nonzero(hits >= self.sortings.needed - (DIRECTIONS - half))
            if diagonal:
                later = low + j > start + i
                i, j = i[later], j[later]
            count = hits[i, j] + (np.abs(x[i, half:] - y[j, half:]) <= window).sum(axis=1, dtype=np.int8)
            good = count >= self.sortings.needed
            yield asks[i[good]], others[low + j[good]]

    def links(self, asking: np.ndarray, others: np.ndarray, diagonal: bool):
        """The pairs of ``candidates`` that are close enough and first meet in this table."""
        for a, b in self.candidates(asking, others, diagonal):
            self.verified += len(a)
            fits = [np.einsum("nw,nw->n", self.rows[a[s : s + 65536]], self.rows[b[s : s + 65536]]) >= self.least * self.norms[a[s : s + 65536]] * self.norms[b[s : s + 65536]] for s in range(0, len(a), 65536)]
            fits = np.concatenate(fits) if fits else np.zeros(0, bool)
            a, b = a[fits], b[fits]
            met = np.zeros(len(a), dtype=bool)
            for t in range(self.turn):
                met |= (self.blocks[a, t] == self.blocks[b, t]) & self._sorted_close(a, b, t)
            new = ~met & self._sorted_close(a, b, self.turn)
            yield a[new], b[new]

    def _sorted_close(self, a, b, t):
        return np.abs(self.at[a, t % DIRECTIONS] - self.at[b, t % DIRECTIONS]).astype(float) <= self.sortings.sort_window


def link_tiles(placed: DataFrame, sortings: Sortings, width: int, item: int, least: float) -> DataFrame:
    """``a, b, links``: for each class of a tile how many vectors it links to there (``b`` null), and a spanning forest
    of these links (``links`` 0)."""

    def compare(group: pa.Table) -> pa.Table:
        column = lambda name: group.column(name).combine_chunks()
        classes, values, copies, side = column("cls").to_pylist(), column("v").to_pylist(), column("copies").to_numpy(), column("side").to_numpy()
        at = np.frombuffer(b"".join(column("at").to_pylist()), np.float32).reshape(len(values), DIRECTIONS)
        blocks = np.frombuffer(b"".join(column("blocks").to_pylist()), np.int32).reshape(len(values), sortings.tables)
        tile = Tile(sortings, int(group.column("table")[0].as_py()), values, at, blocks, width, item, least)
        diagonal = bool((side == 2).all())
        sides = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
        links, label = np.zeros(len(values), dtype=np.int64), np.arange(len(values))
        for a, b in tile.links(*sides, diagonal):
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            label = forest(len(values), np.concatenate([a, np.arange(len(values))]), np.concatenate([b, label]))
        counted, grown = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(values)))
        a = [classes[i] for i in counted] + [classes[i] for i in grown]
        b = [None] * len(counted) + [classes[i] for i in label[grown]]
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([*links[counted].tolist(), *[0] * len(grown)], pa.int64())], ["a", "b", "links"])

    return tiles(placed).groupBy(*TILE).applyInArrow(compare, "a binary, b binary, links long")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST_COSINE, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row; links are pairs at a cosine of at least ``least``.

    Null and zero vectors, and those with a null or non-finite component, link with nothing and are their own component.
    Shorter vectors are read as filled up with zeros. Rows that repeat a vector link with each other, whatever their
    ids. A component's id is its smallest id that is not null; a row is kept if that is its own (a row without an id only
    where its component has none).
    """
    spark = df.sparkSession
    importable(spark)
    item = 4 if df.schema[vector].dataType.elementType == T.FloatType() else 8
    rows = stage(vector_rows(df, key, vector), "vectors")
    with scratch(spark) as keep:
        facts = keep(stage(_class_facts(rows, item, least, block), "class-facts"))
    linked = rows.filter("cls IS NOT NULL").select("id", "cls").join(facts, "cls").select("id", "n_links", "component_id")
    alone = rows.filter("cls IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _class_facts(rows: DataFrame, item: int, least: float, block: int) -> DataFrame:
    """``cls, n_links, component_id`` of every class of equal vectors."""
    classes = stage(rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")), "vector-classes")
    found, longest = classes.agg(F.count(F.lit(1)), F.max(F.length("v"))).first()
    width = (longest or item) // item
    sample = _units(_matrix([r["v"] for r in classes.select("v", "cls").orderBy("cls").limit(SAMPLE).collect()], width, item)).reshape(-1, width)
    sortings = calibrate(sample, found, least, block)
    placed = place_in_tables(classes, sortings, width, item)
    met = stage(link_tiles(placed, sortings, width, item, least), "links")
    roots = components(met.filter("b IS NOT NULL"))
    degree = met.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    of_class = classes.select("cls", "copies", "least").join(degree, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    of_class = stage(of_class.select("cls", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least", "root"), "classes-linked")
    # A component may hold a large part of all classes: its least id is found by parts and written, so that the join
    # back is one of two written tables, which adaptive execution splits where a component is large.
    inside = of_class.filter("root IS NOT NULL")
    smallest = stage(inside.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    lone = of_class.filter("root IS NULL").select("cls", "n_links", F.col("least").alias("component_id"))
    return inside.join(smallest, "root").select("cls", "n_links", "component_id").unionByName(lone)


SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
  AND len(list_filter(embedding, lambda c: c <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {LEAST_COSINE}),
r AS (SELECT vec_id, vec_id AS seen FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c"""


@query("op12_near_vectors", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
