"""What filters do to each other: every order of five filters, from one word a document.

A document fails some of the five filters. Of the 32 subsets of filters it survives those that hold none of them; the
set of these subsets is its survival word, one bit a subset. How many documents survive each subset is then a count of
bits by position, for each part of the table and each label. Words are added up as carry-save planes: three words
become a sum and a carry without a look at single bits, and a word that stands for many copies enters the planes of
its count's binary digits. All orders and steps follow from those 32 numbers a part.

Copies of a text are told by their digest (256 bits) before the words are made: what all but the first copy fail is
decided for each group of equal texts from its least id, and groups of copies are counted, not listed, before they meet.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelquilt.llm.common import importable, table
from pixelquilt.llm.registry import query

FILTERS = "ABCDE"
COPY = FILTERS.index("E")
SUBSETS = 1 << len(FILTERS)
ORDERS = ["".join(order) for order in permutations(FILTERS)]

LEAST_WORDS = 200
LEAST_DISTINCT = 50  # of 100 words
MOST_CAPITALS = 2  # of 100 code points
MARKS = b"#$%&*|"

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_LATER_BYTES = bytes(range(0x80, 0xC0))
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a long text whose words are listed at a time.
PIECE = 1 << 22

#: WORDS[failed]: the survival word of a document that fails the filters of this mask.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not failed & s) for failed in range(SUBSETS)], dtype=np.uint32)


def _pieces(text: bytes):
    at = 0
    while len(text) - at > PIECE and (cut := _GAP.search(text, at + PIECE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def failed_by(text: bytes) -> int:
    """Which of A to D a whole text (in UTF-8) fails, as a mask. Bytes split at the same six characters as the words."""
    words, distinct = 0, set()
    for piece in _pieces(text):
        found = piece.split()
        words += len(found)
        distinct.update(found)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _LATER_BYTES))
    return (
        (words < LEAST_WORDS)
        | (100 * len(distinct) < LEAST_DISTINCT * words) << 1
        | (100 * capitals > MOST_CAPITALS * points) << 2
        | (len(text.translate(None, MARKS)) < len(text)) << 3
    )


def text_facts(df: DataFrame, key: str, part: str, text: str) -> DataFrame:
    """``key, part, digest, failed`` per row; the text goes no further."""

    def measure(batches):
        for batch in batches:
            digests, failed = [], []
            for value in batch.column(2):
                raw = value.as_py()
                digests.append(hashlib.sha256(raw).digest())
                failed.append(failed_by(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(failed, pa.int32())], ["key", "part", "digest", "failed"])

    narrow = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return narrow.mapInArrow(measure, "key long, part string, digest binary, failed int")


def labelled(facts: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """With ``good`` and ``toxic``; what has no label is neither. A label that repeats counts once."""
    of = labels.groupBy(F.col(key).cast("long").alias("label_key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    # Rows without a key find no label; they are dealt out evenly instead of meeting in one task.
    lone = F.col("key").isNull()
    keyed = facts.withColumn("lone", lone).withColumn("label_key", F.when(lone, F.monotonically_increasing_id()).otherwise(F.col("key")))
    found = keyed.join(of.filter("label_key IS NOT NULL").withColumn("lone", F.lit(False)), ["label_key", "lone"], "left")
    return found.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def survival_words(rows: DataFrame) -> DataFrame:
    """``part, good, toxic, failed, copies``: rows that share all of it, with the copies of a text told apart.

    E fails every row whose text stands under a smaller key anywhere in the table. Rows without a key neither fail E nor
    make others fail it; rows that repeat the least key all pass.
    """
    cell = ["digest", "part", "failed", "good", "toxic"]
    by_key = rows.groupBy("label_key", "lone", "key", *cell).agg(F.count(F.lit(1)).alias("n"))
    cells = by_key.groupBy(*cell).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("lone"), F.col("n")).otherwise(0)).alias("unkeyed"),
        F.min("key").alias("least"),
        F.min_by("n", "key").alias("at_least"),
    )
    leads = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    first = F.col("unkeyed") + F.when(leads, F.col("at_least")).otherwise(0)
    told = cells.withColumn("first", first)
    both = F.array(
        F.struct(F.col("failed"), F.col("first").alias("copies")),
        F.struct(F.col("failed").bitwiseOR(1 << COPY).alias("failed"), (F.col("n") - F.col("first")).alias("copies")),
    )
    return told.select("part", "good", "toxic", F.explode(F.filter(both, lambda w: w["copies"] > 0)).alias("w")).select("part", "good", "toxic", "w.failed", "w.copies")


def positional_counts(words: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """For each of 32 bit positions, the copies of words that have it set, by carry-save addition."""
    counts, carried, level = np.zeros(32, dtype=np.int64), words[:0], 0
    top = int(copies.max()).bit_length() if len(copies) else 0
    while level < top or len(carried):
        at = np.concatenate([words[(copies >> level) & 1 == 1], carried]) if level < top else carried
        carries = []
        while len(at) > 2:
            third = len(at) // 3
            a, b, c = at[:third], at[third : 2 * third], at[2 * third : 3 * third]
            either = a ^ b
            carries.append((a & b) | (either & c))
            at = np.concatenate([either ^ c, at[3 * third :]])
        counts += ((at[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(axis=0, dtype=np.int64) << level
        carried, level = np.concatenate(carries) if carries else words[:0], level + 1
    return counts


def subset_survivors(words: DataFrame) -> DataFrame:
    """``part, subset, kept, good, toxic``: the rows that survive each subset, and those of them with each label."""

    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            parts = names.indices.to_numpy()
            good, toxic = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            survival, copies = WORDS[batch.column(3).to_numpy()], batch.column(4).to_numpy()
            order = np.argsort(parts, kind="stable")
            edges = np.flatnonzero(np.diff(parts[order], prepend=-1))
            found = []
            for rows in np.split(order, edges[1:]):
                found.append([positional_counts(survival[r], copies[r]) for r in (rows, rows[good[rows]], rows[toxic[rows]])])
            kept = [pa.array(np.concatenate([counts[i] for counts in found]), pa.int64()) for i in range(3)]
            which = names.dictionary.take(pa.array(np.repeat(parts[order][edges], SUBSETS)))
            yield pa.RecordBatch.from_arrays([which, pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(found))), *kept], ["part", "subset", "kept", "good", "toxic"])

    partial = words.mapInArrow(count, "part string, subset int, kept long, good long, toxic long")
    return partial.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])


def _steps() -> dict[str, np.ndarray]:
    """Every order and step, with the subset before it and the step's filter as masks."""
    rows = [(order, step + 1, sum(1 << FILTERS.index(f) for f in order[:step]), 1 << FILTERS.index(own)) for order in ORDERS for step, own in enumerate(order)]
    names, steps, before, own = zip(*rows)
    return {"order": names, "step": np.array(steps, dtype=np.int32), "before": np.array(before), "own": np.array(own)}


STEPS = _steps()
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def order_report(kept: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[np.ndarray]:
    """The report's numbers for all orders and steps of a part, from the survivors of each subset."""
    before, own = STEPS["before"], STEPS["own"]
    removed = kept[before] - kept[before | own]
    redundant = kept[0] - kept[own] - removed
    unique = kept[(SUBSETS - 1) & ~own] - kept[SUBSETS - 1]
    of_filter = {f: int(removed[own == f].sum()) for f in np.unique(own)}
    shapley = np.array([of_filter[f] for f in own])
    return [kept[before | own], removed, redundant, unique, good[before] - good[before | own], toxic[before] - toxic[before | own], shapley]


def report(survivors: DataFrame) -> DataFrame:
    """One row for each part, order and step."""

    def spell_out(batches):
        for batch in batches:
            for name, cells in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.zeros((3, SUBSETS), dtype=np.int64)
                for cell in cells:
                    counts[:, cell["subset"]] = cell["kept"], cell["good"], cell["toxic"]
                numbers = [pa.array(x.astype(np.int64)) for x in order_report(*counts)]
                columns = [pa.array([name] * len(STEPS["step"])), pa.array(STEPS["order"]), pa.array(STEPS["step"]), *numbers]
                yield pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in REPORT.split(", ")])

    # 32 entries a part.
    by_part = survivors.groupBy("part").agg(F.collect_list(F.struct("subset", "kept", "good", "toxic")).alias("cells"))
    return by_part.mapInArrow(spell_out, REPORT)


def audit(df: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """The report of all orders of the five filters, per part.

    Null texts are empty (and fail A only, unless a smaller key is empty too), a null part is the empty string, a table
    without rows gives none. Rows without a key have no label and never fail E. Repeated rows count each.
    """
    importable(df.sparkSession)
    rows = labelled(text_facts(df, key, part, text), labels, key)
    return report(subset_survivors(survival_words(rows)))


_ORDERS_SQL = " || ".join(f"f{i}" for i in range(len(FILTERS)))
_DIFFERENT = " AND ".join(f"l{i}.f{i} <> l{j}.f{j}" for i in range(len(FILTERS)) for j in range(i))
_LETTERS = ", ".join(f"(SELECT unnest(string_split('{','.join(FILTERS)}', ',')) AS f{i}) l{i}" for i in range(len(FILTERS)))
SQL = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w))::INT
 + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
 + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS f FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, f),
o AS (SELECT {_ORDERS_SQL} AS filter_order FROM {_LETTERS} WHERE {_DIFFERENT}),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
 coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS before FROM o, (SELECT unnest(range(1, {len(FILTERS) + 1})) AS step)),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN f & (before | own) = 0 THEN n ELSE 0 END) AS kept,
 sum(CASE WHEN f & before = 0 AND f & own <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN f & before <> 0 AND f & own <> 0 THEN n ELSE 0 END) AS redundant,
 sum(CASE WHEN f = own THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN f & before = 0 AND f & own <> 0 THEN good ELSE 0 END) AS good_lost,
 sum(CASE WHEN f & before = 0 AND f & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost FROM g, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
 good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""


@query("op11_filter_audit", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
