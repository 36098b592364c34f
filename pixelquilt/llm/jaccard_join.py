"""Exact Jaccard join of documents over word n-grams, as a blocked sparse matrix product.

The incidence matrix has a row for each different set of n-grams (equal sets are one row) and a column for each
n-gram. Only a part of each row can decide: in any order of the columns, a row of size n that links shares at least m
columns among its first n - ceil(t n) + m with the other one, so the product runs over those, block of columns by block of columns, and adds up
how much two rows have in common. A pair goes on only if that sum and the columns not yet seen, whose number follows
from the sizes, can reach the bound ceil((n1 + n2) t / (1 + t)). For pairs that do, the remaining columns are counted.

Columns that very many rows have are kept out of the pairing. The rows they concern take another order, with all their
frequent columns last. Rows that consist of frequent columns almost alone (large groups of near copies) are first
compared with one row for each such column; what these comparisons connect is one component and needs no further
ones, and only rows of different components that meet in a column are then compared. So a group of near copies costs
in proportion to its rows, and no link between different components is missed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquilt.llm.common import bitmap_of, importable, in_bitmap, scratch, stage, table
from pixelquilt.llm.components import components
from pixelquilt.llm.hashing import mixed, span_hashes
from pixelquilt.llm.registry import query

WIDTH = 5
PERCENT = 75
#: A column of more rows than this is frequent.
FREQUENT = 48
#: Blocks of columns that are multiplied one after the other.
COLUMN_BLOCKS = 2
#: Rounds in which rows meet one row for each of their frequent columns.
STAR_ROUNDS = 2
#: Columns are counted in two to this many parts at least, and in so many that a part has about this many columns.
MERGED_PARTS_BITS = 8
MERGED_COLUMNS = 1 << 19

_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of a text that are hashed at a time.
BLOCK_BYTES = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash for every word, of its bytes with A-Z lowered. Long texts are hashed in blocks that end at white
    space."""
    data = np.frombuffer(raw, np.uint8)
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        part = data[at:end]
        at = end
        gap = np.concatenate([[True], _SPACE[part], [True]])
        turns = np.flatnonzero(gap[1:] != gap[:-1])
        found.append(span_hashes(_FOLD[part], turns[::2], turns[1::2]))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def grams_of(words: np.ndarray, width: int) -> np.ndarray:
    """The different n-grams of a text, from the hashes of its words; a shorter text is one n-gram."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(width, n)
    found = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        found = mixed((found * _MIX) ^ words[i : n - size + 1 + i])
    return np.unique(found)


def set_of(text: str | None, width: int) -> np.ndarray:
    return grams_of(word_hashes((text or "").encode("utf-8")), width)


def leading(n: int, percent: int) -> int:
    """How many columns of a row of size n decide: any row that links shares one of them."""
    return n - -(-percent * n // 100) + 1 if n else 0


def demand(n: int, percent: int) -> int:
    """How many of its leading columns a row of size n is made to share: a third of those that decide."""
    return max(1, leading(n, percent) // 3)


def _demand(n: Column, percent: int) -> Column:
    return F.greatest(F.lit(1), F.floor((n - F.ceil(n * percent / 100) + 1) / 3))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64), pa.int64()))


def _digests(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """The whole digest of each set, and its first 64 bits."""
    found = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
    return pa.array(found, pa.binary()), pa.array(np.frombuffer(b"".join(d[:8] for d in found), np.int64))


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``key, text_hash, n`` (size of the set), ``row`` (its digest) and ``c`` (the digest's first 64 bits)."""
    importable(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))

    def sign(batches):
        for batch in batches:
            sets = [set_of(t.as_py(), width) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), *_digests(sets)], ["key", "text_hash", "n", "row", "c"])

    return rows.mapInArrow(sign, f"key {rows.schema['key'].dataType.simpleString()}, text_hash long, n long, row binary, c long")


def leads(df: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """``row, c, n, last, lead``: the first columns of every set in the order of their hashes, as many as decide and
    as are demanded besides, and the last of them."""

    def lead(batches):
        for batch in batches:
            sets = [s for t in batch.column(0) if len(s := set_of(t.as_py(), width))]
            firsts = [s[: leading(len(s), percent) - 1 + demand(len(s), percent)] for s in sets]
            last = np.array([f[-1] for f in firsts], np.uint64).view(np.int64)
            row, c = _digests(sets)
            yield pa.RecordBatch.from_arrays([row, c, pa.array([len(s) for s in sets], pa.int64()), pa.array(last), _lists(firsts)], ["row", "c", "n", "last", "lead"])

    return df.select(text).filter(F.col(text).isNotNull()).mapInArrow(lead, "row binary, c long, n long, last long, lead array<long>")


def _sets(df: DataFrame, key: str, text: str, wanted: np.ndarray, width: int) -> DataFrame:
    """``row, c, n, grams`` of the documents whose key is marked in a bitmap."""
    rows = df.select(F.xxhash64(F.col(key)).alias("hk"), F.col(text).alias("text"))

    def collect(batches):
        for batch in batches:
            kept = batch.column(1).filter(pa.array(in_bitmap(wanted, batch.column(0).to_numpy())))
            sets = [s for t in kept if len(s := set_of(t.as_py(), width))]
            yield pa.RecordBatch.from_arrays([*_digests(sets), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["row", "c", "n", "grams"])

    return rows.mapInArrow(collect, "row binary, c long, n long, grams array<long>")


def _close(a: str, b: str, percent: int):
    """Sizes that a link allows."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _shared(cells: DataFrame, label: str) -> DataFrame:
    """Cells (gram, c, n) of columns with two rows or more, with the column's number of rows ``df``."""
    counts = cells.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    return stage(cells.join(counts, "gram"), label)


def _products(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs ``c1 < c2`` with the number of columns they share."""
    left = cells.select("gram", F.col("c").alias("c1"), F.col("n").alias("n1"))
    right = cells.select("gram", F.col("c").alias("c2"), F.col("n").alias("n2"))
    met = left.join(right, "gram").filter((F.col("c1") < F.col("c2")) & _close("n1", "n2", percent))
    return met.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("common"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, ``a, b`` by digest, after counting all their columns."""
    one = sets.select(F.col("c").alias("c1"), F.col("row").alias("a"), F.col("n").alias("n1"), F.col("grams").alias("g1"))
    two = sets.select(F.col("c").alias("c2"), F.col("row").alias("b"), F.col("n").alias("n2"), F.col("grams").alias("g2"))
    both = pairs.select("c1", "c2").join(one, "c1").join(two, "c2")
    overlap = F.size(F.array_intersect("g1", "g2"))
    counted = both.filter(_close("n1", "n2", percent)).withColumn("overlap", overlap)
    return counted.filter(F.col("overlap") * 100 >= (F.col("n1") + F.col("n2") - F.col("overlap")) * percent).select("a", "b", "overlap")


def _column_blocks(sets: DataFrame, bits: int) -> DataFrame:
    """``part, grams, rows``: the different columns of a block of sets and how many of its sets have each, as one array
    for every ``part``, the high ``bits`` of a column."""
    importable(sets.sparkSession)

    def count(batches):
        for batch in batches:
            gram, rows = np.unique(batch.column(0).flatten().to_numpy().view(np.uint64), return_counts=True)
            part = (gram >> np.uint64(64 - bits)).astype(np.int64)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            ends = pa.array([*first, len(gram)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (gram.view(np.int64), rows)]
            yield pa.RecordBatch.from_arrays([pa.array(part[first], pa.int64()), *lists], ["part", "grams", "rows"])

    return sets.select("grams").mapInArrow(count, "part long, grams array<long>, rows array<long>")


def _column_counts(sets: DataFrame) -> DataFrame:
    """``gram, df``: the columns that two of the sets have or more, with their number of sets.

    Columns are counted in arrays where the sets lie, and the arrays of one part are merged, so no column of a set is a
    row of its own: near copies share nearly all of theirs, and most others belong to one set. There are so many parts
    that one stays small.
    """
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(MERGED_PARTS_BITS, (total // MERGED_COLUMNS).bit_length())

    def merge(found: pa.Table) -> pa.Table:
        gram, at = np.unique(np.concatenate([x.values.to_numpy() for x in found["grams"]]), return_inverse=True)
        df = np.zeros(len(gram), np.int64)
        np.add.at(df, at, np.concatenate([x.values.to_numpy() for x in found["rows"]]))
        return pa.table({"gram": pa.array(gram[df > 1], pa.int64()), "df": pa.array(df[df > 1], pa.int64())})

    return _column_blocks(sets, bits).groupBy("part").applyInArrow(merge, "gram long, df long")


def _reordered(sets: DataFrame, frequent: np.ndarray, shared: np.ndarray, percent: int) -> DataFrame:
    """Deciding cells (gram, c, n, room) in the order that has frequent columns last, but for columns that no other row has.

    ``room`` is how many columns a pair can still share whose first common column this is: those that follow in the row.
    Where it is a frequent one, they are all frequent.
    """

    def lead(batches):
        for batch in batches:
            code, size, gram, room = [], [], [], []
            column = batch.column(2)
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
            hashes = batch.column(3).values.to_numpy()
            marks, met = in_bitmap(frequent, hashes), in_bitmap(shared, hashes)
            for c, n, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends, ends[1:]):
                order = np.lexsort((flat[a:b].view(np.uint64), marks[a:b]))[: leading(n, percent)]
                place = np.flatnonzero(met[a:b][order])
                gram.append(flat[a:b][order[place]])
                code.append(np.full(len(place), c))
                size.append(np.full(len(place), n))
                room.append(n - place)
            joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (gram, code, size, room)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in joined], ["gram", "c", "n", "room"])

    hashes = F.transform("grams", lambda g: F.xxhash64(g))
    return sets.select("c", "n", "grams", hashes.alias("hashes")).mapInArrow(lead, "gram long, c long, n long, room long")


def _enough(n1: Column, n2: Column, common: Column, percent: int) -> Column:
    """Whether two sets of these sizes may link with so many columns in common."""
    return common * (100 + percent) >= (n1 + n2) * percent


def _label(links: DataFrame) -> DataFrame:
    with scratch(links.sparkSession) as keep:
        return keep(stage(components(links), "labels"))


def links(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Staged signatures of all documents, and ``a, b, overlap``: verified links between different sets.

    Every listed pair links; every pair that links is listed or its sets are connected by listed ones.
    """
    signed = stage(signatures(df, key, text, width), "signatures")
    rows = stage(leads(df, text, width, percent).dropDuplicates(["row"]), "rows")
    cells = None
    for block in range(COLUMN_BLOCKS):
        own = rows.select(F.explode("lead").alias("gram"), "c", "n").filter(F.pmod("gram", F.lit(COLUMN_BLOCKS)) == block)
        own = _shared(own, f"cells-{block}")
        cells = own if cells is None else cells.unionByName(own)
    # How many of the leading columns of a row are frequent.
    often = cells.filter(F.col("df") > FREQUENT)
    late = stage(often.groupBy("c").agg(F.count(F.lit(1)).alias("late"), F.first("n").alias("n")), "late")
    unseen = F.col("n") - (F.col("n") - F.ceil(F.col("n") * percent / 100) + _demand(F.col("n"), percent))
    facts = rows.select("c", "n", "last").withColumn("unseen", unseen).drop("n").join(late.drop("n"), "c", "left").withColumn("late", F.coalesce("late", F.lit(0)))
    pairs = _products(cells.filter(F.col("df") <= FREQUENT), percent)
    first = facts.select([F.col(x).alias(f"{x}1") for x in facts.columns])
    second = facts.select([F.col(x).alias(f"{x}2") for x in facts.columns])
    needed = F.ceil((F.col("n1") + F.col("n2")) * percent / (100 + percent))
    # Up to the smaller of the two last columns everything common is counted, but for frequent columns. Hashes are
    # ordered as unsigned numbers.
    unsigned = lambda x: F.col(x).bitwiseXOR(F.lit(-(1 << 63)))
    reach = F.when(unsigned("last1") <= unsigned("last2"), F.col("late1") + F.col("unseen1")).otherwise(F.col("late2") + F.col("unseen2"))
    pairs = stage(pairs.join(first, "c1").join(second, "c2").filter(F.col("common") + reach >= needed).select("c1", "c2"), "pairs")

    # A pair that meets in frequent columns only must share the demand of one of the two rows, whose sizes are close.
    late = late.filter(F.col("late") >= _demand(F.ceil(F.col("n") * percent / 100), percent)).select("c")
    wanted = pairs.select(F.col("c1").alias("c")).unionByName(pairs.select(F.col("c2").alias("c"))).unionByName(late.select("c")).distinct()
    holders = signed.groupBy("row", "c").agg(F.min(F.struct("key")).alias("held")).join(wanted, "c", "left_semi")
    marked = bitmap_of(holders, F.col("held.key"))
    found = _sets(df, key, text, marked, width)
    sets = stage(found.join(wanted, "c", "left_semi").dropDuplicates(["row"]), "sets")
    linked = stage(_verified(pairs, sets, percent), "links")

    if late.isEmpty():
        return signed, linked
    return signed, _frequent_links(sets.join(late, "c", "left_semi"), sets, linked, percent)


def _frequent_links(concerned: DataFrame, sets: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """Add the links that meet in frequent columns only."""
    concerned = stage(concerned, "concerned")
    counts = stage(_column_counts(concerned), "counts")
    # The bitmaps mark frequent columns and those that two rows have; one marked by mistake is only ordered later, or met by nobody.
    frequent, shared = (bitmap_of(found, F.col("gram")) for found in (counts.filter(F.col("df") > FREQUENT), counts))
    cells = _shared(_reordered(concerned, frequent, shared, percent), "late-cells")
    pairs = stage(_products(cells.filter(F.col("df") <= FREQUENT), percent).select("c1", "c2"), "late-pairs")
    known = stage(linked.unionByName(_verified(pairs, sets, percent)), "links")
    # What is left are pairs whose first common column is a crowded one. Then all others follow it in both rows, so a row
    # takes part with a column only if enough of its columns follow: rows with a part of their own over a seventh, as
    # texts on one template have it, meet nobody here.
    n, room = F.col("n"), F.col("room")
    least = F.ceil(n * percent / 100)
    crowded = stage(cells.filter((F.col("df") > FREQUENT) & _enough(n, least, room, percent)).select("gram", "c", "n", "room"), "crowded")
    if crowded.isEmpty():
        return known
    codes = sets.select("row", "c")
    roots = _label(known.select("a", "b"))
    for turn in range(STAR_ROUNDS + 1):
        at = codes.join(roots.withColumnRenamed("node", "row"), "row", "left").select("c", F.coalesce("root", "row").alias("root"))
        placed = crowded.join(at, "c")
        # The centre of a column: at first the row with the least of its own, which copies are closest to that have little
        # in common but their template; then the row of the smallest hash.
        own = -F.col("room") / F.col("n") if turn == 0 else F.lit(0.0)
        order = F.struct(own.alias("own"), F.xxhash64("c", F.lit(turn)).alias("h"), *[F.col(x).alias(x) for x in ("c", "n", "root")])
        spread = placed.groupBy("gram").agg(F.min(order).alias("centre"), F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("gram", "centre")
        spread = stage(spread, "spread")
        if spread.isEmpty():  # every frequent column lies in one component
            return known
        outside = placed.join(spread, "gram").filter("root <> centre.root")
        if turn < STAR_ROUNDS:
            met = outside.filter(_close("n", "centre.n", percent)).select(F.col("c").alias("c1"), F.col("centre.c").alias("c2"))
        else:
            # What is left, exactly: rows outside the centre's component with all rows of the column.
            mine = outside.select("gram", F.col("c").alias("c1"), F.col("n").alias("n1"), F.col("root").alias("root1"), F.col("room").alias("room1"))
            others = placed.select("gram", F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("root").alias("root2"), F.col("room").alias("room2"))
            met = mine.join(others, "gram").filter((F.col("root1") != F.col("root2")) & _close("n1", "n2", percent) & _enough(F.col("n1"), F.col("n2"), F.least("room1", "room2"), percent)).select("c1", "c2")
        met = met.select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).distinct()
        new = stage(_verified(met, sets, percent), "links")
        known = known.unionByName(new)
        if turn < STAR_ROUNDS and not new.isEmpty():
            # Stars around the roots connect what the links so far do.
            roots = _label(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new.select("a", "b")))
    return known


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """A row for each row of ``df``: key, ``n_shingles``, ``component_id``, the smallest key that links reach, and
    ``text_hash``, which tells rows of one key apart.

    A text without words has no set: its component is its own key. Equal sets link. A null key can be in a component
    but not name it; a component of null keys alone has a null id. Rows may repeat, other columns are not read, an
    empty table gives an empty result.
    """
    with scratch(df.sparkSession) as keep:
        signed, linked = links(df, key, text, width, percent)
        roots = keep(_label(linked.select("a", "b")))
        keep(signed)
    placed = signed.filter("n > 0").groupBy("row").agg(F.min("key").alias("least")).join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    # Only sets in a component of several need its smallest key.
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_row = placed.select("row", "root").join(named, "root").select("row", "component_id")
    full = signed.select("key", "text_hash", "n", "row").filter("n > 0").join(by_row, "row").drop("row")
    empty = signed.filter("n = 0").select("key", "text_hash", "n", F.col("key").alias("component_id"))
    return full.unionByName(empty).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", "text_hash")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df``, as they are, without those of a component that is named by another key.

    Texts without words stay, and so do rows with a null key: they have no smaller key to give way to. Rows that
    repeat the smallest key of a component all stay, as they are one document to the key. Of a key with several texts,
    each text is judged on its own.
    """
    with scratch(df.sparkSession) as keep:
        found = classes(df, key, text, width, percent)
        dropped = keep(stage(found.filter(F.col("component_id") < F.col(key)).select(F.col(key).alias("_dropped"), F.col("text_hash").alias("_text_hash")).distinct(), "dropped"))
    return df.join(dropped, (F.col(key) == F.col("_dropped")) & (F.xxhash64(F.col(text)) == F.col("_text_hash")), "left_anti")


@query("op1_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).drop("text_hash")
