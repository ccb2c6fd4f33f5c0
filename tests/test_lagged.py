"""Windows that are never written out, against windows that are."""

import numpy as np
import pytest

from fahrwerk.operators import lagged


def windows(x, size):
    return np.array([x[i : i + size].ravel() for i in range(len(x) - size + 1)]).reshape(-1, size * x.shape[1])


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 40])
def test_lag_sums(n):
    x = np.random.default_rng(n).normal(size=(n, 3))
    count, total, products = lagged.lag_sums(x, 5)
    w = windows(x, 5)
    assert count == len(w) and np.allclose(total, w.sum(axis=0)) and np.allclose(products, w.T @ w)


@pytest.fixture(scope="module")
def runs(spark):
    """Runs of 3 to 61 rows, one of which has a null and one a non-finite value; extra columns."""
    rng = np.random.default_rng(2)
    out = {r: rng.normal(size=(n, 2)) for r, n in {1: 61, 2: 5, 3: 4, 4: 3, 5: 17, 6: 28, 7: 7}.items()}
    out[5][8, 1], out[6][13, 0] = np.nan, np.inf
    rows = [(r, i, None if np.isnan(a) else float(a), None if np.isnan(b) else float(b), 7) for r, x in out.items() for i, (a, b) in enumerate(x)]
    return out, spark.createDataFrame(rows, "run_id long, seq long, a double, b double, part long")


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_fit_and_errors(runs, chunk):
    out, df = runs
    parts = lagged.stretches(df, ["a", "b"], 5, chunk)
    every = {(r, i): w for r, x in out.items() for i, w in enumerate(windows(x, 5))}
    good = np.stack([w for w in every.values() if np.isfinite(w).all()])
    n, mean, cov = lagged.window_moments(parts, 2, 5)
    assert n == len(good) and np.allclose(mean, good.mean(axis=0)) and np.allclose(cov, np.cov(good.T))
    mean, top = lagged.fit(parts, 2, 5, 3)
    assert np.allclose(top.T @ top, np.eye(3))

    def error(w):
        c = w - mean
        return np.abs(c - top @ (top.T @ c)).reshape(5, 2) if np.isfinite(w).all() else None

    want = {k: error(w) for k, w in every.items()}
    got = {(r.run_id, r.seq): r.error for r in lagged.window_errors(parts, mean, top, 2, 5, chunk).collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (e is None) and (e is None or np.allclose(got[k], e.mean(axis=0))) for k, e in want.items())
    rows = lagged.point_errors(parts, mean, top, 2, 5, chunk).collect()
    got = {(r.run_id, r.seq): r.error for r in rows}
    assert len(rows) == len(got) == sum(map(len, out.values()))
    for (r, i), e in got.items():
        w = want.get((r, i - 2))
        assert (e is None) == (w is None) and (e is None or np.allclose(e, w[2]))


def test_nothing_to_fit(runs):
    _, df = runs
    parts = lagged.stretches(df.limit(0), ["a", "b"], 5)
    with pytest.raises(ValueError):
        lagged.fit(parts, 2, 5)
    assert lagged.window_errors(parts, np.zeros(10), np.eye(10)[:, :2], 2, 5).count() == 0


def test_stretches_are_bounded(runs):
    """A run of any length is cut into stretches of chunk + size - 1 rows at most."""
    _, df = runs
    assert max(len(r.v) for r in lagged.stretches(df, ["a"], 5, 7).collect()) == 7 + 4
