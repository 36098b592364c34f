"""Vector search and the pipeline against brute force."""

import math

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from pixelquilt.llm import queries, top_k

SF = "/root/testdata/sf0.001"


def test_top_k_odd_vectors(spark):
    vectors = [(0, [0.5, -0.25]), (50, [0.1, 0.9]), (1, None), (2, [1.0, None]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, [0.5, -0.25]), (6, [0.5, -0.25]), (7, [2.0]), (8, []), (None, [9.0, 9.0]), (5, [0.5, -0.25])]
    table = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, x int")
    fine = [(i, [math.floor(256 * c) for c in v]) for i, v in vectors if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    want = []
    for q in (0, 50):
        x = dict(fine)[q]
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in fine if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    # Components are 32-bit floats.
    got = sorted(tuple(r) for r in top_k.top_k(table, F.col("id") % 50 == 0).collect())
    rounded = [(q, r, i) for q, r, i, _ in got]
    assert rounded == [(q, r, i) for q, r, i, _ in sorted(want)]
    assert top_k.top_k(table.limit(0), F.col("id") % 50 == 0).count() == 0
    with pytest.raises(ValueError):
        top_k.top_k(spark.createDataFrame([(0, [1e9])], "vec_id long, embedding array<float>"), F.col("id") % 50 == 0)


def test_top_k_twin(spark):
    found = duckdb.connect()
    found.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    assert sorted(tuple(r) for r in queries.QUERIES["op7_top_k"](spark, SF).collect()) == sorted(found.execute(queries.SQL["op7_top_k"]).fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, last, SF)
        assert out.columns == docs.columns, name
        kept = {r["doc_id"]: r for r in out.collect()}
        assert set(kept) <= {r["doc_id"] for r in last.collect()}
        last = spark.createDataFrame(list(kept.values()), docs.schema)
        assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p["doc_id"] for p in pieces} == set(kept)
