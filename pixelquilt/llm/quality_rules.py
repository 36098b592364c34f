"""Quality rules: simple bounds, then robust multivariate outliers for each language and source.

Statistics of a text become a vector. For every language and source the minimum covariance determinant estimate is
found: a centre and covariance of the three quarters of its documents that lie closest together, by concentration
steps from a start at the medians until the determinant no longer falls: the local minimum of that start. A document is rejected if its Mahalanobis distance from its group's estimate is
too large. Groups with few documents are pooled, first by language, then all together.

All of it is DataFrame work: array functions inside a row, sums and counted bins for each group. No group is gathered;
a group that holds a third of all rows is summed where its rows lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelquilt.functions.binding import let
from pixelquilt.llm.common import WORD_GAPS, stage, table, words_of
from pixelquilt.llm.registry import query

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Fewer documents than this are pooled with others of the language, or with all.
MIN_GROUP = 60
#: The share of a group whose covariance has the least determinant.
SUBSET = 0.75
#: 0.75 / P(chi2(6) <= median-like quantile of chi2(4) at 0.75): makes the subset's covariance that of the whole.
CONSISTENCY = 1.4866
#: A fall of the determinant's logarithm that is more than rounding.
LEAST_FALL = 1e-9
#: Squared distance beyond which a document is an outlier.
CUTOFF = 25.0
#: Spread that every statistic has at least, so that one that is constant in a group rejects nothing on its own.
FLOORS = (0.06, 0.4, 0.4, 0.2)
#: Bins for each unit of squared distance, and the last bin.
BINS_PER_UNIT, LAST_BIN = 16, 16383

P = len(FLOORS)
X = [f"x{i}" for i in range(P)]
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text has twice or more."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.get(starts, i - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeated(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda w, i: (w["h"] == F.get(ordered, i - 1)["h"]) | (w["h"] == F.get(ordered, i + 1)["h"]))
        return let(F.sort_array(F.transform(twice, lambda w: w["p"])), covered)

    def starts(ws: Column) -> Column:
        return F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0)))

    def hashes(ws: Column) -> Column:
        return F.transform(starts(ws), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))

    def any_twice(found: Column) -> Column:
        placed = F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        # A missing neighbour compares as null, which a filter takes as no. Most texts repeat nothing and are not sorted.
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(F.sort_array(placed), repeated))

    return let(hashes(words), any_twice)


def statistics(text: Column) -> Column:
    """A struct of the base statistics of a whole text. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def all_of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return let(
            words_of(t),
            lambda ws: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeat_words(ws).cast("long").alias("n_repeat_words"),
            ),
        )

    return let(text, all_of)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def _vector(s: Column) -> list[Column]:
    """Mean word length, symbols for each hundred letters, repeated lines and repeated words, spread evenly by logarithm
    and root."""
    words, chars = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["word_chars"], F.lit(1))
    return [
        F.log(chars / words),
        F.log1p(100 * s["n_symbols"] / chars),
        F.sqrt(s["n_dup_lines"] * 20 / words),
        F.sqrt(s["n_repeat_words"] / words),
    ]


def _inverse_root(cov: dict[tuple[int, int], Column]) -> dict[str, Column]:
    """The inverse of the Cholesky factor of a covariance, as columns m_ij."""
    low: dict[tuple[int, int], Column] = {}
    for i in range(P):
        for j in range(i + 1):
            rest = cov[i, j]
            for k in range(j):
                rest = rest - low[i, k] * low[j, k]
            low[i, j] = F.sqrt(rest) if i == j else rest / low[j, j]
    inverse: dict[tuple[int, int], Column] = {}
    for j in range(P):
        inverse[j, j] = 1 / low[j, j]
        for i in range(j + 1, P):
            rest = low[i, j] * inverse[j, j]
            for k in range(j + 1, i):
                rest = rest + low[i, k] * inverse[k, j]
            inverse[i, j] = -rest / low[i, i]
    return {f"m{i}{j}": c for (i, j), c in inverse.items()}


def _squared_distance(x: list[Column]) -> Column:
    """From the estimate's columns c_i (centre) and m_ij."""
    z = [x[i] - F.col(f"c{i}") for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"m{i}{j}") * z[j]
        total = total + part * part
    return total


def _groups(rows: DataFrame) -> DataFrame:
    """Which estimate each (lang, source) takes: its own, its language's pool, or the pool of all. Structs as keys hold
    nulls like any value."""
    counted = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") >= MIN_GROUP
    pooled = F.sum(F.when(~own, F.col("n")).otherwise(0)).over(Window.partitionBy("lang"))
    none = F.lit(None).cast("string")
    key = F.when(own, F.struct(F.lit(2).alias("level"), F.col("lang").alias("l"), F.col("source").alias("s")))
    key = key.when(pooled >= MIN_GROUP, F.struct(F.lit(1).alias("level"), F.col("lang").alias("l"), none.alias("s")))
    key = key.otherwise(F.struct(F.lit(0).alias("level"), none.alias("l"), none.alias("s")))
    return counted.select(F.struct("lang", "source").alias("pair"), key.alias("g"))


def estimates(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``pair`` (language and source) with the centre and inverse root covariance of its group, from the documents
    that pass the bounds. One row for each pair of language and source that has such a document."""
    s = F.col("s")
    narrow = df.select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), statistics(F.col(text)).alias("s"))
    return _fit(stage(narrow.filter(~base_failed(s)).select("lang", "source", *[c.alias(n) for n, c in zip(X, _vector(s))]), "statistics"))


def _fit(rows: DataFrame) -> DataFrame:
    """The estimates from staged rows of ``lang, source, x0..``."""
    groups = stage(_groups(rows), "groups")
    rows = rows.withColumn("pair", F.struct("lang", "source")).join(groups, "pair").select("g", *X)
    # The start: medians, and spreads from the quartiles (1.349 of them in a normal's).
    quartiles = [F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).alias(x) for x in X]
    start = rows.groupBy("g").agg(*quartiles)
    spread = [F.greatest((F.get(x, F.lit(2)) - F.get(x, F.lit(0))) / 1.349, F.lit(f)) for x, f in zip(X, FLOORS)]
    diagonal = {(i, j): spread[i] * spread[i] if i == j else F.lit(0.0) for i in range(P) for j in range(i + 1)}
    found = start.select("g", *[F.get(X[i], F.lit(1)).alias(f"c{i}") for i in range(P)], *[c.alias(n) for n, c in _inverse_root(diagonal).items()])
    return groups.join(_settled(rows, stage(found, "start")), "g").drop("g")


def _settled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Concentration steps until no group's determinant falls. A group keeps its last estimate that fell, so steps that
    would go round in a circle end as well."""
    found, names = stage(_concentrate(rows, found), "estimate"), [c for c in found.columns if c != "g"]

    def height(estimate: Column) -> Column:
        return -2 * sum((F.log(estimate[f"m{i}{i}"]) for i in range(P)), F.lit(0.0))

    while True:
        both = found.select("g", F.struct(*names).alias("last")).join(_concentrate(rows, found).select("g", F.struct(*names).alias("next")), "g")
        falls = height(F.col("next")) < height(F.col("last")) - LEAST_FALL
        judged = stage(both.select("g", falls.alias("falls"), F.when(falls, F.col("next")).otherwise(F.col("last")).alias("e")).select("g", "falls", "e.*"), "estimate")
        found = judged.drop("falls")
        if judged.filter("falls").isEmpty():
            return found


def _concentrate(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One step: the closest documents of every group give the next centre and covariance."""
    scored = rows.join(found, "g").withColumn("bin", F.least(F.floor(_squared_distance([F.col(x) for x in X]) * BINS_PER_UNIT), F.lit(LAST_BIN)).cast("int"))
    counted = scored.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"))
    # At most LAST_BIN + 1 rows for each group.
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    everything = F.sum("n").over(Window.partitionBy("g"))
    last = counted.select("g", "bin", upto.alias("upto"), everything.alias("everything")).filter(F.col("upto") >= SUBSET * F.col("everything")).groupBy("g").agg(F.min("bin").alias("last"))
    subset = scored.join(last, "g").filter(F.col("bin") <= F.col("last"))
    # Sums of differences from the last centre, which lose no digits.
    z = [F.col(X[i]) - F.col(f"c{i}") for i in range(P)]
    sums = [F.avg(z[i]).alias(f"a{i}") for i in range(P)] + [F.avg(z[i] * z[j]).alias(f"b{i}{j}") for i in range(P) for j in range(i + 1)]
    moments = subset.groupBy("g").agg(*sums, *[F.first(f"c{i}").alias(f"c{i}") for i in range(P)])
    cov = {(i, j): CONSISTENCY * (F.col(f"b{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")) + (FLOORS[i] ** 2 if i == j else 0.0) for i in range(P) for j in range(i + 1)}
    return moments.select("g", *[(F.col(f"c{i}") + F.col(f"a{i}")).alias(f"c{i}") for i in range(P)], *[c.alias(n) for n, c in _inverse_root(cov).items()])


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """A row for each row of ``df``: key, the base statistics, ``base_failed``, ``distance`` (squared; null if the base
    failed) and ``kept``.

    Null texts have no words and fail the base. Null languages and sources are groups of their own. Keys may be null
    or repeat, other columns are not read, an empty table gives an empty result. Texts are read once.
    """
    narrow = df.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), statistics(F.col(text)).alias("s"))
    s = F.col("s")
    held = stage(narrow.select("key", F.struct("lang", "source").alias("pair"), s, base_failed(s).alias("base_failed"), *[c.alias(n) for n, c in zip(X, _vector(s))]), "judged")
    found = _fit(held.filter(~F.col("base_failed")).select("pair.lang", "pair.source", *X))
    distance = F.when(~F.col("base_failed"), _squared_distance([F.col(x) for x in X]))
    judged = held.join(found, "pair", "left").withColumn("distance", distance)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)
    return judged.select(F.col("key").alias(key), *[f"s.{n}" for n in STATISTICS], "base_failed", "distance", kept.alias("kept"))


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``df``, as they are, that the rules keep. Whole texts do not move: the estimates come to them."""
    found = estimates(df, text, lang, source)
    s = statistics(F.col(f"d.{text}"))
    pair = F.struct(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    carried = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("d"), pair.alias("pair"))
    passed = carried.withColumn("s", s).filter(~base_failed(F.col("s")))
    judged = passed.join(found, "pair", "left").filter(F.coalesce(_squared_distance(_vector(F.col("s"))), F.lit(0.0)) <= CUTOFF)
    return judged.select("d.*")


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("distance")
