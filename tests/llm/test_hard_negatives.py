"""Hard negatives against scoring all rows."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquilt.llm import hard_negatives, queries

SF = "/root/testdata/sf0.001"


def plain(rows):
    width = max((len(v) for _, v, _ in rows if v), default=1)
    fine = [(k, lab, np.array([math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v)), dtype=float)) for k, v, lab in rows if k is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, (anchor, label, x) in enumerate(fine):
        if anchor % 50:
            continue
        scored = sorted((-int(x @ y), k, lab) for m, (k, lab, y) in enumerate(fine) if m != n)
        for s, positive, _ in [r for r in scored if r[2] == label][:5]:
            hard = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(anchor, positive, i + 1, k, -s, -t) for i, (t, k, _) in enumerate(hard)]
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(k, v, lab, 1, b"x") for k, v, lab in rows], "vec_id long, embedding array<float>, label int, c1 int, x binary")
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("id") % 50 == 0).collect())
    assert got == plain(rows)
    return got


def test_odd_vectors(spark):
    rows = [(0, [0.5, -0.25], 1), (50, [0.1, 0.9], 2), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 0.0], 1), (4, [float("inf"), 0.0], 1), (5, [0.5, -0.25], 1), (6, [0.5, -0.25], 1), (7, [2.0], 1), (8, [], 2), (None, [0.4, 0.1], 2)]
    rows += [(9, [0.3, -0.2], 2), (10, [0.3, -0.2], 3), (10, [0.3, -0.2], 3), (5, [0.4, -0.25], 2), (11, [0.4, -0.25], None), (50, [0.1, 0.8], 2), (12, [-0.5, 0.9], 2), (13, [0.2, 0.5], 1), (14, [0.1, 0.5, 3.0], 1), (100, [-1.0, 0.0], 7), (101, [1.0, 0.0], 7)]
    assert check(spark, rows)
    check(spark, [])
    check(spark, [(50, [1.0, 2.0], 1)])
    with pytest.raises(ValueError):
        check(spark, [(50, [1e9, 2.0], 1)])


@pytest.mark.parametrize("probe, segment, asking", [(4096, 8192, 2048), (200, 100, 10)])
def test_all_windows_are_certified(spark, monkeypatch, probe, segment, asking):
    for name, value in (("PROBE", probe), ("SEGMENT", segment), ("ASKING", asking), ("CELL", 16)):
        monkeypatch.setattr(hard_negatives, name, value)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 16))
    x = centres[draw.integers(0, 12, 1500)] + 0.4 * draw.normal(size=(1500, 16))
    x[:500] = x[0]
    rows = [(int(k), [float(c) for c in v], int(lab)) for k, v, lab in zip(draw.permutation(1500), x, draw.integers(0, 4, 1500))]
    rows += [(2000, [0.1] * 16, 9), (2050, [0.2] * 16, 8), (2051, [0.3] * 16, 8)]
    assert len(check(spark, rows)) > 100


def test_cells_come_by_falling_bounds():
    draw = np.random.default_rng(1)
    first, second = draw.normal(size=(2, 9))
    got = list(hard_negatives.multi_sequence(first, second))
    assert [b for b, _, _ in got] == sorted((first[:, None] + second[None, :]).ravel(), reverse=True) and len({(i, j) for _, i, j in got}) == 81


def test_bounds_hold_and_prune():
    """On clustered vectors most cells stay below what an anchor asks for; no score lies outside its cell's bounds."""
    draw = np.random.default_rng(2)
    x = np.floor(256 * (draw.normal(size=(10, 64))[draw.integers(0, 10, 6000)] + 0.15 * draw.normal(size=(6000, 64))))
    books = hard_negatives.fit_codebooks(x[:3000], 6000)
    found = [hard_negatives._nearest(part, c) for part, c in zip(books.halves(x), books.centres)]
    radii = [np.array([far[code == c].max(initial=0) for c in range(books.codes)]) for code, far in found]
    books = hard_negatives.Codebooks(books.cut, books.width, books.centres, tuple(radii), None)
    upper, lower = books.half_bounds(x[:100])
    codes = [code for code, _ in found]
    scores = x[:100] @ x.T
    top = upper[0][:, codes[0]] + upper[1][:, codes[1]]
    assert (scores <= top).all() and (scores >= lower[0][:, codes[0]] + lower[1][:, codes[1]]).all()
    assert (top >= np.sort(scores, axis=1)[:, -6][:, None]).mean() < 0.2


def test_hard_negatives_twin(spark):
    found = duckdb.connect()
    found.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    assert sorted(tuple(r) for r in queries.QUERIES["op13_hard_negatives"](spark, SF).collect()) == sorted(found.execute(queries.SQL["op13_hard_negatives"]).fetchall())
