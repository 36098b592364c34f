"""Near vectors against comparing all pairs."""

import duckdb
import numpy as np
import pytest

from pixelquilt.llm import near_vectors, queries

SF = "/root/testdata/sf0.001"


def plain(rows, least=0.95):
    """n_links, component and kept of each row, with all pairs compared."""
    width = max((len(v) for _, v in rows if v), default=1)
    fine = [bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v) for _, v in rows]
    x = np.zeros((len(rows), width))
    for i, (_, v) in enumerate(rows):
        if fine[i]:
            x[i, : len(v)] = np.asarray(v, np.float32)
            x[i] /= np.abs(x[i]).max()
    norms = np.sqrt((x**2).sum(1))
    linked = (x @ x.T >= least * norms[:, None] * norms[None, :]) & np.outer(fine, fine).astype(bool)
    np.fill_diagonal(linked, False)
    label = near_vectors.forest(len(rows), *np.nonzero(linked))
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [k for j, (k, _) in enumerate(rows) if label[j] == label[i] and k is not None]
        component = min(ids) if ids else None
        out.append((key, int(linked[i].sum()), component, key == component))
    return sorted(out, key=repr)


def check(spark, rows, recall=1.0, **options):
    """Components must be right; of the links, none may be made up and all but ``1 - recall`` be found."""
    df = spark.createDataFrame([(k, v, 1, b"x") for k, v in rows], "vec_id long, embedding array<float>, `cls` int, v binary")
    got = sorted((tuple(r) for r in near_vectors.near_vectors(df, **options).collect()), key=repr)
    want = plain(rows)
    assert [(k, c, kept) for k, _, c, kept in got] == [(k, c, kept) for k, _, c, kept in want]
    found, all_links = (sum(r[1] for r in x) for x in (got, want))
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and found >= recall * all_links


def test_odd_vectors(spark):
    rows = [(0, [0.5, -0.25]), (50, [0.1, 0.9]), (1, None), (2, [1.0, None]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, [0.5, -0.25]), (6, [5.0, -2.5]), (7, [2.0]), (8, []), (9, [0.0, 0.0])]
    rows += [(None, [0.5, -0.25]), (None, [-1.0, -1.0]), (None, [-1.0, -1.1]), (5, [0.5, -0.25]), (5, [0.5, -0.25]), (11, [1e-30, 1e-30]), (12, [1e30, 1e30]), (13, [-3.0, 0.0, 4.0])]
    check(spark, rows)
    check(spark, [])
    check(spark, [(1, None)])


def groups(draw, singles, copies, spread, width=32):
    """Lone vectors, one hot group of near copies, chains whose ends are far apart, exact copies."""
    middle = draw.normal(size=width)
    x = [*draw.normal(size=(singles, width)), *(middle + spread * draw.normal(size=(copies, width)))]
    for _ in range(20):
        a, b = draw.normal(size=(2, width))
        x += [np.cos(t) * a / np.linalg.norm(a) + np.sin(t) * b / np.linalg.norm(b) for t in np.arange(0, 1.5, 0.25)]
    x += [x[0]] * 40
    return [(int(k), [float(c) for c in v]) for k, v in zip(draw.permutation(len(x)), x)]


@pytest.mark.parametrize("most, chunk, block", [(4096, 2048, 1024), (4096, 2048, 64), (100, 40, 64)])
def test_links_are_found(spark, monkeypatch, most, chunk, block):
    monkeypatch.setattr(near_vectors, "MOST_IN_BLOCK", most)
    monkeypatch.setattr(near_vectors, "CHUNK", chunk)
    rows = groups(np.random.default_rng(5), 900, 400, 0.1)
    got = plain(rows)
    assert max(r[1] for r in got) > 300
    check(spark, rows, recall=0.9999, block=block)


def test_recall_at_the_threshold():
    """Pairs at the threshold itself, against what the calibration promises; far more for closer ones."""
    draw = np.random.default_rng(9)
    base = near_vectors._units(draw.normal(size=(4000, 64)))
    aside = draw.normal(size=base.shape)
    aside = near_vectors._units(aside - (aside * base).sum(1, keepdims=True) * base)
    sortings = near_vectors.calibrate(base, 200_000)
    assert sortings.planes.shape[2] == 8 and 1 < sortings.tables < 64
    found = {}
    for cosine in (0.9501, 0.97):
        other = cosine * base + np.sqrt(1 - cosine**2) * aside
        (at, blocks), (at2, blocks2) = sortings.places(base), sortings.places(other)
        own = np.arange(sortings.tables) % near_vectors.DIRECTIONS
        met = ((blocks == blocks2) & (np.abs(at[:, own] - at2[:, own]) <= sortings.sort_window)).any(1)
        found[cosine] = (met & ((np.abs(at - at2) <= sortings.window).sum(1) >= sortings.needed)).mean()
    assert found[0.9501] > 0.995 and found[0.97] > 0.999
    # What a window lets pass among unrelated vectors.
    assert ((np.abs(at[:2000, None] - at[None, 2000:]) <= sortings.window).sum(2) >= sortings.needed).mean() < 1e-3


def test_close_data_are_cut_less():
    tight = near_vectors._units(np.ones((500, 16)) + 0.01 * np.random.default_rng(1).normal(size=(500, 16)))
    assert near_vectors.calibrate(tight, 10**6).planes.shape[2] < 5


def test_near_vectors_twin(spark):
    found = duckdb.connect()
    found.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    assert sorted(tuple(r) for r in queries.QUERIES["op12_near_vectors"](spark, SF).collect()) == sorted(found.execute(queries.SQL["op12_near_vectors"]).fetchall())
