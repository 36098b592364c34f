"""Repeated passages, found by content-defined chunks and, at their edges, word by word.

A passage repeats if MIN_WORDS words or more, with the white space between them, stand at an earlier place, in the order
of (key, place). Every window of MIN_WORDS words whose content occurs before goes, so a passage goes up to its true
ends; the first occurrence stays.

Not every window is compared. The smallest hash of the half-windows in a window is its anchor: equal windows have equal
anchors, so only windows whose anchor occurs twice matter. Those that begin in the same chunk are compared as one unit
first. A gear hash rolls over the bytes of a text; where its top bits are zero, the chunk ends at the next white space.
It depends on the last 32 bytes alone, so a passage has the same inner units wherever it stands. A unit that occurs
before repeats as a whole. Windows of the other units, at the edges and in first occurrences, are compared on their own.
The first occurrence of a window is never in a repeating unit, so none is missed.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquilt.llm.common import BITMAP_WORDS, bitmap_of, fresh, importable, in_bitmap, scratch, stage, table
from pixelquilt.llm.hashing import Runs, mixed, span_hashes
from pixelquilt.llm.registry import query

#: A cut is due every 2^CUT_BITS bytes on average.
CUT_BITS = 5
#: Bytes that a cut waits for white space.
PATIENCE = 64
#: Words that a passage needs to be taken out.
MIN_WORDS = 16

WINDOW = 32
#: The gear table by rule: mixed byte values, and nothing for the zero byte that pads the start of a text.
GEAR = np.array([0] + [xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(1, 256)], dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: The base of each half of a digest.
BASES = [0x9E3779B97F4A7C1, 0x1094D049BB133111]
#: Seeds of the hashes of words and of the white space between them.
_WORD, _GAP = 1, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The hashes of white space of one byte.
_ONE = span_hashes(np.arange(256, dtype=np.uint8), np.arange(256), np.arange(1, 257), _GAP)
#: What lies between two texts: as many zero bytes as the gear hash looks back.
_APART = bytes(WINDOW)

#: Bytes of texts that are hashed together.
BLOCK_BYTES = 1 << 18
#: Bits that a bitmap has for each member, and the most words it grows to (32 MB).
MEMBER_BITS = 8
MOST_WORDS = 1 << 22


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h_i = sum of G[b_(i-j)] << j over the last 32 bytes, by doubling the span five times."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def cuts_of(data: np.ndarray, space: np.ndarray | None = None) -> np.ndarray:
    """Where the chunks of a text end (its length last); ``space`` tells white space."""
    n = len(data)
    hits = np.flatnonzero(gear_hashes(data) < np.uint32(1 << (32 - CUT_BITS)))
    spaces = np.flatnonzero(_SPACE[data] if space is None else space)
    at = np.searchsorted(spaces, hits)
    following = np.append(spaces, n + 2 * PATIENCE)[at]
    # Without white space near by, the cut comes between two characters.
    forced = hits + PATIENCE
    for _ in range(3):
        inside = (forced < n) & ((data[np.minimum(forced, n - 1)] & 0xC0) == 0x80)
        forced = forced + inside
    ends = np.where(following <= hits + PATIENCE, following, forced)
    return np.unique(np.append(ends[(ends > 0) & (ends < n)], n)) if n else np.zeros(0, np.int64)


def _sliding(pick, values: np.ndarray, width: int) -> np.ndarray:
    """pick (of two neighbouring spans) over every ``width`` neighbours, by doubling the span."""
    out, span = values, 1
    while 2 * span <= width:
        out, span = pick(out[:-span], out[span:]), 2 * span
    rest = width - span
    return pick(out[:-rest], out[rest:]) if rest else out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a ^ (a >> np.uint64(31))) * _MIX + b


class Windows:
    """The windows of ``width`` words of a text, or of each of a list of texts: none reaches into the next text.

    Texts lie one after the other, zero bytes between them, so that all are hashed at once. What is found in a text
    does not depend on the others. ``owner`` is each window's text, ``idx`` the word of that text where it begins.
    """

    def __init__(self, texts: str | list[str | None] | None, width: int):
        parts = [(t or "").encode("utf-8") for t in (texts if isinstance(texts, list) else [texts])]
        self.raw, self.width = _APART.join(parts), width
        self.data = np.frombuffer(self.raw, np.uint8)
        upto = np.cumsum([len(x) + WINDOW for x in parts]) - WINDOW
        self._space = _SPACE[self.data]
        self._space[(upto[:-1, None] + np.arange(WINDOW)).ravel()] = True
        space = np.concatenate([[True], self._space, [True]])
        turns = np.flatnonzero(space[1:] != space[:-1])
        #: Bytes at which words begin and end.
        self.starts, self.ends = turns[::2], turns[1::2]
        words = np.concatenate([[0], np.searchsorted(self.starts, upto)])
        each = np.maximum(np.diff(words) - width + 1, 0)
        self.n = int(each.sum())
        self.owner = np.repeat(np.arange(len(parts)), each)
        self.idx = np.arange(self.n) - np.repeat(np.cumsum(each) - each, each)
        #: The word at which each window begins, counted over all texts.
        self._at = self.idx + words[self.owner]
        self._runs: dict[int, Runs] = {}

    @cached_property
    def _words(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, _WORD)

    @cached_property
    def _items(self) -> np.ndarray:
        """A hash of every word but the last and the white space after it."""
        first, after = self.ends[:-1], self.starts[1:]
        gaps = _ONE[self.data[first]]
        wide = np.flatnonzero(after - first > 1)
        gaps[wide] = span_hashes(self.data, first[wide], after[wide], _GAP)
        return mixed((self._words[:-1] * _MIX) ^ gaps)

    @cached_property
    def _grams(self) -> np.ndarray:
        """Hashes of the half-windows. Where they are equal by chance, more is compared."""
        half = max(self.width // 2, 1)
        return mixed(_joined(_sliding(_joined, self._items, half - 1), self._words[half - 1 :])) if half > 1 else self._words

    @cached_property
    def _least(self) -> np.ndarray:
        return _sliding(np.minimum, self._grams, self.width - max(self.width // 2, 1) + 1)

    @cached_property
    def anchors(self) -> np.ndarray:
        """The hash that each window has at least, mixed: least hashes alone have few high bits, of which bitmaps take six."""
        return mixed(self._least[self._at]).view(np.int64) if self.n else np.zeros(0, np.int64)

    def chosen(self, windows: np.ndarray | None = None) -> np.ndarray:
        """The anchors of all windows or of those that are true in ``windows``, once for each place."""
        if not self.n:
            return self.anchors
        at = self._at if windows is None else self._at[windows]
        reach = len(self._grams) - len(self._least) + 1
        least = np.zeros(len(self._least) + 2 * (reach - 1), np.uint64)
        least[at + (reach - 1)] = self._least[at]
        return mixed(self._grams[_sliding(np.maximum, least, reach) == self._grams]).view(np.int64)

    def digest(self, which: int, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Half of the digest of the text of the windows from ``first`` up to before ``after``, white space inside included."""
        if which not in self._runs:
            self._runs[which] = Runs(self._items, BASES[which])
        last = self._at[after - 1] + self.width - 1
        return mixed((self._runs[which].of(self._at[first], last) * _MIX) ^ self._words[last]).view(np.int64)

    def units(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First windows and ends of the units with a marked anchor, and which windows have one."""
        marked = in_bitmap(marks, self.anchors)
        if not marked.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), marked
        cut = np.zeros(len(self.starts) + 1, bool)
        cut[np.searchsorted(self.starts, cuts_of(self.data, self._space))] = True
        first = np.flatnonzero(cut[self._at] | (self.idx == 0))
        after = np.append(first[1:], self.n)
        some = np.logical_or.reduceat(marked, first)
        return first[some], after[some], marked


def _places(docs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of the places of units."""
    return mixed(mixed(first.astype(np.uint64)) ^ docs.view(np.uint64)).view(np.int64)


def _identity(key: Column, text: Column) -> Column:
    """Tells documents apart whose keys are null or repeat; rows that are alike in both count as one document."""
    return F.xxhash64(key, text)


def _blocks(docs: pa.Array, texts: pa.Array):
    """Blocks of a batch, of BLOCK_BYTES of text together or one longer text: first row, documents, texts."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_BYTES, "right")))
        yield at, docs.slice(at, end - at).to_numpy(), texts.slice(at, end - at).to_pylist()
        at = end


def _each(rows: DataFrame, name: str, find) -> DataFrame:
    """One column of 64-bit numbers: all that ``find(docs, texts)`` gives for blocks of ``doc, text``."""

    def numbers(batches):
        for batch in batches:
            for _, docs, texts in _blocks(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(find(docs, texts))], [name])

    return rows.select("doc", "text").mapInArrow(numbers, f"{name} long")


def _spans(rows: DataFrame, find, **columns: str) -> DataFrame:
    """``key, doc`` and ``columns``: what ``find(docs, texts)`` gives for blocks of texts, after each span's text in its block."""
    kind = rows.schema["key"].dataType.simpleString()
    numbers = {"int": np.int32, "long": np.int64}

    def spans(batches):
        for batch in batches:
            for at, docs, texts in _blocks(batch.column(1), batch.column(2)):
                owner, *found = find(docs, texts)
                taken = pa.array(owner + at, pa.int64())
                made = [pa.array(x.astype(numbers[k])) for x, k in zip(found, columns.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), *made], ["key", "doc", *columns])

    return rows.mapInArrow(spans, ", ".join([f"key {kind}, doc long", *(f"{c} {k}" for c, k in columns.items())]))


def _owners(spans: DataFrame, *content: str) -> DataFrame:
    """The first place of every content that stands at more than one.

    Staged, so that a join reads two plain exchanges, whose frequent digests adaptive execution splits."""
    at = F.struct("key", "doc", "idx")
    owners = spans.groupBy(*content).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("of")).filter("of > 1").drop("of")
    return stage(owners, "owners")


def _later(width: int) -> Column:
    """Whether the content occurs before. What overlaps its own first occurrence does not count."""
    same = F.struct("key", "doc").eqNullSafe(F.struct(F.col("first.key"), F.col("first.doc")))
    return F.col("first").isNotNull() & (~same | (F.col("idx") >= F.col("first.idx") + width))


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``key, doc, places``: for every document with any, the spans of its words (first, end) that occur before."""
    importable(df.sparkSession)
    context = df.sparkSession.sparkContext
    rows = df.select(F.col(key).alias("key"), _identity(F.col(key), F.col(text)).alias("doc"), F.col(text).alias("text")).filter(F.col("text").isNotNull())

    def marks(members: DataFrame):
        """A bitmap with room for its members, within bounds."""
        members = stage(members, "members")
        words = BITMAP_WORDS
        while words < MOST_WORDS and words * 64 < MEMBER_BITS * members.count():
            words *= 2
        return context.broadcast(bitmap_of(members, F.col("d"), words=words, hashed=True))

    def twice(numbers: DataFrame):
        return marks(numbers.groupBy("d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d"))

    anchors = twice(_each(rows, "d", lambda docs, texts: Windows(texts, min_words).chosen()))

    def units(docs, texts):
        w = Windows(texts, min_words)
        first, after, _ = w.units(anchors.value)
        if not len(first):
            return [first] * 6
        return w.owner[first], w.idx[first], after - first, w.digest(0, first, after), w.digest(1, first, after), _places(docs[w.owner[first]], w.idx[first])

    with scratch(df.sparkSession) as keep:
        spans = stage(_spans(rows, units, idx="int", n="int", d1="long", d2="long", place="long"), "units")
        found = spans.join(_owners(spans, "d1", "d2"), ["d1", "d2"], "left")
        judged = keep(stage(found.select("key", "doc", "idx", "n", "place", _later(min_words).alias("later")), "judged-units"))
        own = marks(judged.filter("NOT later").select(F.col("place").alias("d")))

    def open_windows(docs, texts):
        """Windows with a marked anchor, outside of repeating units."""
        w = Windows(texts, min_words)
        first, after, marked = w.units(anchors.value)
        kept = in_bitmap(own.value, _places(docs[w.owner[first]], w.idx[first]))
        inside = np.zeros(w.n + 1, np.int64)
        inside[first[kept]] += 1
        inside[after[kept]] -= 1
        return w, marked & (np.cumsum(inside)[:-1] > 0)

    def open_anchors(docs, texts):
        w, some = open_windows(docs, texts)
        return w.chosen(some) if some.any() else np.zeros(0, np.int64)

    again = twice(_each(rows, "d", open_anchors))

    def windows(docs, texts):
        w, some = open_windows(docs, texts)
        at = np.flatnonzero(some)
        at = at[in_bitmap(again.value, w.anchors[at])]
        return (w.owner[at], w.idx[at], w.digest(0, at, at + 1), w.digest(1, at, at + 1)) if len(at) else [at] * 4

    spans = stage(_spans(rows, windows, idx="int", d1="long", d2="long"), "windows")
    edges = spans.join(_owners(spans, "d1", "d2"), ["d1", "d2"]).filter(_later(min_words)).select("key", "doc", "idx", F.lit(1).alias("n"))
    later = judged.filter("later").select("key", "doc", "idx", "n").unionByName(edges)
    later = later.select("key", "doc", F.struct(F.col("idx").alias("at"), (F.col("idx") + F.col("n") + (min_words - 1)).alias("upto")).alias("span"))
    # The units and windows of one document, at most.
    return later.groupBy("key", "doc").agg(F.sort_array(F.collect_set("span")).alias("places"))


def without(text: str, places, min_words: int = MIN_WORDS) -> str:
    """A text without spans of its words, given in order; they may overlap. The white space after a span goes with it."""
    w = Windows(text, min_words)
    total, kept, done = len(w.starts), [], 0
    joined: list[list[int]] = []
    for at, upto in places:
        if joined and at <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], upto)
        else:
            joined.append([at, upto])
    for at, upto in joined:
        if upto < total:
            begin, end = w.starts[at] if at else 0, w.starts[upto]
        else:
            begin, end = (w.ends[at - 1], w.ends[-1]) if at else (0, len(w.raw))
        kept.append(w.raw[done:begin])
        done = end
    return (b"".join(kept) + w.raw[done:]).decode("utf-8")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows and columns of ``df``, with repeated passages cut from ``text``.

    Null and empty texts stay as they are. The first occurrence of a passage, by key, stays; keys may be null (first)
    or repeat, and rows with the same key and text are treated as one document. Other columns are carried along
    whatever their names; an empty table stays empty. Only documents with repeats are moved.
    """
    with scratch(df.sparkSession) as keep:
        found = keep(stage(repeats(df, key, text, min_words), "repeats"))
    found = found.select(F.struct(F.col("key").alias("k"), F.col("doc").alias("d")).alias("_id"), "places")
    marked = bitmap_of(found, F.col("_id.d"), hashed=True)
    held = df.sparkSession.sparkContext.broadcast(marked)
    doc, places = fresh(df, "doc"), fresh(df, "places")

    @F.pandas_udf("boolean")
    def touched(docs: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(held.value, docs.to_numpy()))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, ats: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or a is None else without(t, zip(a.tolist(), e.tolist(), strict=True), min_words) for t, a, e in zip(texts, ats, ends, strict=True)], dtype=object)

    with_id = df.withColumn(doc, _identity(F.col(key), F.col(text)))
    moved = with_id.filter(touched(F.col(doc))).withColumn(doc, F.struct(F.col(key).alias("k"), F.col(doc).alias("d")))
    moved = moved.join(found.select(F.col("_id").alias(doc), F.col("places").alias(places)), doc, "left")
    cleaned = moved.withColumn(text, cut(F.col(text), F.col(places)["at"], F.col(places)["upto"])).select(df.columns)
    return with_id.filter(~touched(F.col(doc))).select(df.columns).unionByName(cleaned)


@query("op2_chunk_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    return remove_repeats(docs).withColumn("removed_bytes", F.col("n_bytes") - F.octet_length("text"))
