"""The packing plan against placing piece by piece, the classifier's calibration, and the pipeline's stages on odd rows."""

import random
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from pixelquilt.llm import classifier, common, packing

SF = "/root/testdata/sf0.1"


def placed_one_by_one(histogram, capacity):
    """Fills of the packs when each piece, longest first, goes to the shortest pack, or to a new one that is filled until
    the pieces of its length no longer fit."""
    packs, filling = [], None
    for length in sorted(histogram, reverse=True):
        filling = None
        for _ in range(histogram[length]):
            shortest = min(range(len(packs)), key=packs.__getitem__, default=None)
            if filling is not None and packs[filling] + length <= capacity and (shortest is None or packs[shortest] + length > capacity or shortest == filling):
                packs[filling] += length
            elif shortest is not None and packs[shortest] + length <= capacity:
                packs[shortest] += length
            else:
                packs.append(length)
                filling = len(packs) - 1
    return packs


def test_plan_has_as_many_packs_as_placing_one_by_one():
    draw = random.Random(3)
    for _ in range(200):
        capacity = draw.choice([7, 16, 64])
        histogram = {draw.randint(1, capacity): draw.randint(1, 12) for _ in range(draw.randint(0, 9))}
        patterns = packing.plan_patterns(histogram, capacity)
        used = [sum(length * times for length, times in pattern) for pattern, packs in patterns for _ in range(packs)]
        assert max(used, default=0) <= capacity
        assert {n: sum(t * packs for pattern, packs in patterns for length, t in pattern if length == n) for n in histogram} == histogram
        assert len(used) == len(placed_one_by_one(histogram, capacity))


def test_scores_are_calibrated(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels, "doc_id").select(docs["*"])
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    scored = [(r["score"], truth[r["doc_id"]]) for r in classifier.score(known, classifier.fit(docs, labels)).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    score, quality = np.array(scored).T
    bins = np.minimum((score * 10).astype(int), 9)
    off = sum(abs(score[bins == b].mean() - quality[bins == b].mean()) * (bins == b).mean() for b in range(10) if (bins == b).any())
    assert ((score - quality) ** 2).mean() < 0.03 and off < 0.05


def test_stages_take_odd_rows(spark, odd):
    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    for table in (docs, docs.limit(0)):
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = common.stage(step(spark, table, SF), f"test-{name}")
            assert out.columns == table.columns, name
            assert out.count() <= table.count() and (name == "quality" or out.filter("text IS NULL").count() == table.filter("text IS NULL").count())
        pieces = corpus_pipeline.STAGES[-1][1](spark, table, SF)
        assert pieces.select("doc_id", "doc_tokens").distinct().count() == pieces.filter("start = 0").select("doc_id", "doc_tokens").distinct().count()


def test_scratch_tables_go(spark):
    from pathlib import Path

    df = spark.range(5)
    with common.scratch(spark) as keep:
        gone, kept = common.stage(df, "gone"), keep(common.stage(df, "kept"))
        with common.scratch(spark) as inner:
            middle = inner(common.stage(df, "middle"))
    assert not Path(gone.staged_at).exists() and not Path(middle.staged_at).exists() and kept.count() == 5
    left = []
    with common.left_over(left):
        stays = common.stage(df, "stays")
    assert left == [stays.staged_at] and stays.count() == 5
    common.delete(spark, left)
    assert not Path(stays.staged_at).exists()
