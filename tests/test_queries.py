"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from fahrwerk.operators import lstm_training
from fahrwerk.plans import billing, long_runs, records  # noqa: F401  (register their queries)
from fahrwerk.plans import queries as plans
from fahrwerk.sources.telemetry import shipments

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    out = [tuple(tuple(v) if isinstance(v, (list, np.ndarray)) else None if pd.isna(v) else float(v) if isinstance(v, float) else int(v) if hasattr(v, "__index__") else v for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def warped(x, y):
    d = np.full((len(x) + 1, len(y) + 1), np.inf)
    d[0, 0] = 0
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            d[i + 1, j + 1] = (a - b) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1] ** 0.5


def windows(spark):
    return {(w.run_id, w.win): np.array(w.v) for w in plans._windows(spark, SF).collect()}


def vectors(spark):
    return {v.vec_id: np.array(v.v) for v in plans._vectors(spark, SF).collect()}


def is_nearest_mean(spark, got):
    x = vectors(spark)
    means = {c: np.mean([x[v] for v in g.vec_id], axis=0) for c, g in got.groupby("centroid")}
    assert len(got) == len(x) and len(means) > 1
    for row in got.itertuples():
        d = {c: np.linalg.norm(x[row.vec_id] - m) for c, m in means.items()}
        assert d[row.centroid] <= min(d.values()) + 1e-6 and abs(row.d - d[row.centroid]) < 1e-3


def check_dtw_distance(spark, got):
    w = windows(spark)
    assert len(got) and all(abs(r.d - warped(w[r.run_id, r.win], w[r.run_id, 0])) < 1e-4 for r in got.itertuples())


def check_warped_matrix(spark, got):
    w, c = windows(spark), {r.context: r.v for r in billing.chosen_centroids(spark, SF).collect()}
    assert len(got) == len(w) * len(c)
    assert all(abs(r.d - warped(w[r.run_id, r.win], c[r.context])) < 1e-4 for r in got.itertuples())


def check_hybrid_features(spark, got):
    f = np.stack(got.f.to_list())
    assert np.allclose(f.mean(axis=0), 0, atol=1e-3) and np.allclose(f.std(axis=0)[f.std(axis=0) > 0], 1, atol=1e-3)


def check_combined_features(spark, got):
    w = windows(spark)
    for r in got.itertuples():
        x = w[r.run_id, r.win]
        mag = np.abs(np.fft.fft(x))[:15]
        want = [x.min(), x.max(), x.mean(), x.std(), x.var()]
        assert len(r.f) == 114 and np.allclose(r.f[:5], want, atol=1e-3)
        assert abs(r.f[11] - (mag * np.arange(15) / 3).sum() / mag.sum()) < 1e-3 and abs(r.f[49] - sum(r.f[18:49])) < 1


def check_band_passed(spark, got):
    w = windows(spark)
    for r in got.itertuples():
        before, after = np.abs(np.fft.rfft(w[r.run_id, r.win])), np.abs(np.fft.rfft(r.v))
        assert len(r.v) == 30 and after[0] < 0.5 * before[0] + 1e-6


def check_morlet_features(spark, got):
    assert len(got) == len(windows(spark)) and all(len(f) == 39 and abs(f[31] - sum(f[:31])) <= 1e-6 * f[31] for f in got.f)


def check_squeezed_spectrum(spark, got):
    n = {(r.run_id, r.event_type): r.n for r in plans.telemetry(spark, SF).groupBy("run_id", "event_type").agg(plans.F.count("*").alias("n")).collect()}
    assert all((r.rows is None) == (n[r.run_id, r.context] < 10) for r in got.itertuples())


def check_pca_variance(spark, got):
    z = np.stack(got.z.to_list())
    cov = np.cov(z.T)
    assert np.all(np.diff(np.diag(cov)) <= 1e-6) and np.abs(cov - np.diag(np.diag(cov))).max() < 1e-4
    x = np.stack(list(vectors(spark).values()))
    assert np.trace(cov) >= 0.95 * np.trace(np.cov(x.T)) - 1e-6


def check_reduce_hybrid(spark, got):
    assert all(len(z) == 8 for z in got.z) and len(got) == len(vectors(spark))


def path(x, c):
    """Distance of a series to a centroid, and the aligned pairs, cell by cell."""
    d = np.full((len(x) + 1, len(c) + 1), np.inf)
    d[0, 0] = 0
    for i, a in enumerate(x):
        for j, b in enumerate(c):
            d[i + 1, j + 1] = (a - b) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
    i, j, pairs = len(x), len(c), []
    while i and j:
        pairs.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: d[p])
    return d[-1, -1], pairs


def check_warped_clusters(spark, got):
    """Against k-means written out, round by round until nothing moves."""
    w = windows(spark)
    centroids = [np.array(c.v, float) for c in billing.chosen_centroids(spark, SF).orderBy("context").collect()]
    for _ in range(50):
        near = {k: min((path(x, c)[0], n) for n, c in enumerate(centroids)) for k, x in w.items()}
        moved = 0.0
        for n, c in enumerate(centroids):
            found = [(j, w[k][i]) for k in w if near[k][1] == n for i, j in path(w[k], c)[1]]
            for j in range(len(c)):
                own = [v for at, v in found if at == j]
                if own:
                    moved = max(moved, abs(np.mean(own) - c[j]))
                    c[j] = np.mean(own)
        if moved <= 1e-6:
            break
    want = {k: min((path(x, c)[0] ** 0.5, n) for n, c in enumerate(centroids)) for k, x in w.items()}
    assert len(got) == len(w) and got.cluster.nunique() > 1
    assert all(r.cluster == want[r.run_id, r.win][1] and abs(r.d - want[r.run_id, r.win][0]) < 1e-3 for r in got.itertuples())


def lstm_output(window, layers):
    """What a stack of LSTM layers gives, number by number."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for w in layers:
        n = len(w["hh"][0])
        h, c, out = np.zeros(n), np.zeros(n), []
        for x in window:
            z = np.array([np.dot(w["ih"][k], x) + np.dot(w["hh"][k], h) + w["b"][k] for k in range(4 * n)])
            c = sigmoid(z[n : 2 * n]) * c + sigmoid(z[:n]) * np.tanh(z[2 * n : 3 * n])
            h = sigmoid(z[3 * n :]) * np.tanh(c)
            out.append(h)
        window = out
    return np.array(window)


def check_lstm_test_errors(spark, got):
    """Against models that are trained in the same way, applied number by number."""
    w = billing.lstm_windows(spark, SF)
    models = lstm_training.fit(w, 4, hidden=(24, 12, 6), epochs=12)
    want = {(r.grp, r.run_id, r.seq): np.array(r.v).reshape(-1, 4) for r in w.where("part = 'test'").collect()}
    assert set(zip(got.grp, got.run_id, got.win, strict=True)) == set(want) and models.weights
    assert all(losses[-1] < losses[0] for losses in models.losses.values())
    for r in got[got.error.notna()].iloc[::9].itertuples():
        x = (want[r.grp, r.run_id, r.win] - models.low[r.grp]) / (models.high[r.grp] - models.low[r.grp])
        assert np.allclose(r.error, np.abs(lstm_output(x, lstm_training.shaped(models.weights[r.grp], models.sizes)) - x).mean(axis=0), atol=1e-5)


def all_windows(spark):
    """Windows of 30 rows of four signals by (run, first place), written out, and the eight components that explain most."""
    t = shipments(spark, SF).orderBy("run_id", "seq").toPandas()
    found = {}
    for run, g in t.groupby("run_id"):
        x = np.stack([g.quantity, g.price / 1000, g.discount, g.tax], axis=1).astype(float)
        found |= {(run, i): x[i : i + 30].ravel() for i in range(len(x) - 29)}
    x = np.stack(list(found.values()))
    values, vectors = np.linalg.eigh(np.cov(x.T))
    top = vectors[:, np.argsort(-values)[:8]]
    c = x - x.mean(axis=0)
    e = np.abs(c - c @ top @ top.T).reshape(len(x), 30, 4)
    return t, dict(zip(found, e, strict=True))


def check_recon_error(spark, got):
    t, errors = all_windows(spark)
    assert len(got) == len(t) and not got.duplicated(["run_id", "seq"]).any()
    for r in got.itertuples():
        want = errors.get((r.run_id, r.seq - 15))
        assert (want is None) == (r.error is None) and (want is None or np.allclose(want[15], r.error, atol=2e-5))


def check_window_errors(spark, got):
    _, errors = all_windows(spark)
    assert len(got) == len(errors) and not got.duplicated(["run_id", "seq"]).any()
    assert all(np.allclose(errors[r.run_id, r.seq].mean(axis=0), r.error, atol=2e-5) for r in got.itertuples())


def check_kmeans_seeded(spark, got):
    is_nearest_mean(spark, got)


check_kmeans_random = check_kmeans_seeded


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_against_brute_force(spark, name):
    globals()[f"check_{name}"](spark, plans.QUERIES[name](spark, SF).toPandas())


def test_result_does_not_depend_on_partitions(spark):
    from fahrwerk.operators import sequence as sq
    from fahrwerk.sources.telemetry import telemetry

    t = telemetry(spark, SF)
    a = rows(sq.blocks(t).toPandas())
    b = rows(sq.blocks(t.repartition(7, "value")).toPandas())
    assert a == b
