"""The quality rules' estimate against plain numpy: concentration steps until the determinant no longer falls."""

import numpy as np

from pixelquilt.llm import quality_rules as Q


def step(x, centre, root):
    z = (x - centre) @ root.T
    bins = np.minimum(np.floor((z * z).sum(1) * Q.BINS_PER_UNIT), Q.LAST_BIN)
    last = next(b for b in np.unique(bins) if (bins <= b).sum() >= Q.SUBSET * len(x))
    near = x[bins <= last]
    cov = Q.CONSISTENCY * np.cov(near.T, bias=True) + np.diag(np.square(Q.FLOORS))
    return near.mean(0), np.linalg.inv(np.linalg.cholesky(cov)), np.linalg.slogdet(cov)[1]


def start(x):
    ordered = np.sort(x, axis=0)
    low, middle, high = (ordered[int(np.ceil(q * len(x))) - 1] for q in (0.25, 0.5, 0.75))
    return middle, np.diag(1 / np.maximum((high - low) / 1.349, Q.FLOORS))


def settled(x):
    """The estimate and the steps that it took."""
    centre, root, height = step(x, *start(x))
    steps = 1
    while (after := step(x, centre, root))[2] < height - Q.LEAST_FALL:
        (centre, root, height), steps = after, steps + 1
    return centre, root, steps


def test_estimates_settle(spark):
    draw = np.random.default_rng(3)
    groups = {}
    for k in range(6):
        turn = draw.normal(size=(4, 4))
        groups[f"s{k}"] = np.concatenate([draw.normal(size=(300, 4)) @ turn, draw.standard_t(2, (150, 4)) * 3 + 2 * k])
    rows = [("en", name, *map(float, v)) for name, x in groups.items() for v in x]
    table = spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double")
    got = {r["pair"]["source"]: r for r in Q._fit(table).collect()}
    assert set(got) == set(groups)
    want = {name: settled(x) for name, x in groups.items()}
    assert max(steps for _, _, steps in want.values()) > 3
    for name, (centre, root, _) in want.items():
        assert np.allclose([got[name][f"c{i}"] for i in range(4)], centre, rtol=1e-6, atol=1e-6), name
        assert np.allclose([got[name][f"m{i}{j}"] for i in range(4) for j in range(i + 1)], [root[i, j] for i in range(4) for j in range(i + 1)], rtol=1e-6, atol=1e-6), name
