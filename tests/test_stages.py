"""Pipelines of fitted stages: against numpy, on other rows than they were fitted on, and after loading."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from fahrwerk.operators import stages
from fahrwerk.operators.stages import FeatureReducer, Standardizer, WindowFeatures
from fahrwerk.plans import evaluation
from fahrwerk.plans import queries as plans
from fahrwerk.plans.billing import chosen_centroids

SF = "/root/testdata/sf0.001"
evaluation_schema = "grp string, run_id long, part string, method string, pearson_corr double, mae double, rmse double, stretched_corr double, stretched_mae double, stretched_rmse double"


@pytest.fixture(scope="module")
def windows(spark):
    return plans._windows(spark, SF).cache()


@pytest.fixture(scope="module")
def seeds(spark):
    return [[float(x) for x in c.v] for c in chosen_centroids(spark, SF).orderBy("context").collect()]


def seven(v):
    x = np.array(v, float)
    m, n = x.mean(), len(x)
    s = np.sqrt(x.var(ddof=1)) + 1e-8 if n > 1 else np.nan
    return [x.min(), x.max(), m, np.sqrt((x * x).mean()), x.var(ddof=1), ((x - m) ** 3).mean() / s**3, ((x - m) ** 4).mean() / s**4]


def warped(x, y):
    d = np.full((len(x) + 1, len(y) + 1), np.inf)
    d[0, 0] = 0
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            d[i + 1, j + 1] = (a - b) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1] ** 0.5


def plain_hybrid(train, seeds):
    """Means, deviations, components and centroids of k-means on features beside warped distances, written out."""
    vector = lambda v: np.array([*seven(v), *[warped(v, s) for s in seeds]])
    x = np.stack([vector(v) for v in train])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / np.where(scale > 0, scale, 1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    share = np.clip(values[::-1], 0, None) / np.clip(values, 0, None).sum()
    k = min(max(int(np.searchsorted(np.cumsum(share), 0.95 - 1e-12) + 1), 10), z.shape[1], len(z) - 1)
    top = vectors[:, ::-1][:, :k]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(k)])
    middle = z.mean(axis=0)
    place = lambda v: ((vector(v) - mean) / np.where(scale > 0, scale, 1) - middle) @ top
    points, c = np.stack([place(v) for v in train]), np.stack([place(s) for s in seeds])
    for _ in range(100):
        at = np.sqrt(((points[:, None] - c) ** 2).sum(axis=2)).argmin(axis=1)
        new = np.stack([points[at == i].mean(axis=0) if (at == i).any() else c[i] for i in range(len(c))])
        moved, c = np.abs(new - c).max(), new
        if moved <= 1e-9:
            break
    return lambda v: np.sqrt(((place(v) - c) ** 2).sum(axis=1))


def test_hybrid_clusters_equal_numpy(spark, windows, seeds):
    train = windows.where("run_id % 3 > 0")
    model = evaluation.fitted(train, seeds, "kmeans_dtw")
    far = plain_hybrid([r.v for r in train.collect()], seeds)
    rows = model.transform(windows).collect()
    assert len(rows) == windows.count() and len({r.cluster for r in rows}) > 1
    for row in rows:
        want = far(row.v)
        assert np.allclose(row.distances, want, rtol=1e-6, atol=1e-6) and row.cluster == int(np.argmin(row.distances))


def test_saved_pipelines_give_the_same(windows, seeds, tmp_path):
    model = evaluation.fitted(windows.where("run_id % 2 = 0"), seeds, "kmeans_dtw")
    model.save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    key = lambda m: sorted((r.run_id, r.win, r.cluster, tuple(r.distances)) for r in m.transform(windows).collect())
    assert key(back) == key(model)


@pytest.mark.parametrize("strategy", ["pca", "anova", "mutual_information", "hybrid", "none"])
def test_reducers_are_fitted_once_and_applied_to_others(spark, windows, strategy, tmp_path):
    labelled = windows.withColumn("label", (F.col("win") % 2).cast("int"))
    line = Pipeline(stages=[WindowFeatures(inputCol="v"), Standardizer(inputCol="features"), FeatureReducer(inputCol="scaled", strategy=strategy, k=3)])
    line.save(str(tmp_path / "unfitted"))
    fitted = Pipeline.load(str(tmp_path / "unfitted")).fit(labelled.where("run_id % 2 = 0"))
    got = {(r.run_id, r.win): r.reduced for r in fitted.transform(labelled).collect()}
    few = {(r.run_id, r.win): r.reduced for r in fitted.transform(labelled.where("run_id % 2 = 1")).collect()}
    assert few and all(got[k] == v for k, v in few.items())
    assert {len(v) for v in got.values()} == {{"pca": 7, "none": 7}.get(strategy, 3)}


def test_null_windows_stay_null(spark, windows):
    model = evaluation.fitted(windows, [[1.0, 2.0, 3.0], [300.0, 2.0, 9.0]], "kmeans")
    odd = spark.createDataFrame([(1, 1, None)], "run_id int, win int, v array<double>")
    (row,) = model.transform(odd).collect()
    assert row.reduced is None and row.distances is None and row.cluster is None


def test_prices_of_all_methods(spark, windows, seeds):
    rows = {(r.run_id, r.win): r for r in evaluation.method_prices(spark, SF).collect()}
    prices = [r.price for r in chosen_centroids(spark, SF).orderBy("context").select("context").withColumn("price", evaluation.labels.context_price(F.col("context"))).collect()]
    parts = {r.run_id: r.part for r in plans.ordered_split(spark, SF).collect()}
    values = {(r.run_id, r.win): r.v for r in windows.collect()}
    assert set(rows) == set(values) and {r.part for r in rows.values()} <= {"train", "validation"}
    far = plain_hybrid([v for k, v in values.items() if parts[k[0]] == "train"], seeds)
    for k, row in rows.items():
        d = far(values[k])
        assert row.part == parts[k[0]] and row.kmeans_dtw == pytest.approx(sum(p / x for p, x in zip(prices, d, strict=True)) / sum(1 / x for x in d), rel=1e-4)


def test_evaluation_equals_numpy(spark):
    rows = evaluation.method_prices(spark, SF).toPandas()
    got = {(r.run_id, r.method): r for r in evaluation.eval_all_methods(spark, SF).collect()}
    assert {m for _, m in got} == set(evaluation.METHODS) and len(got) == 4 * rows.run_id.nunique()
    for (run, method), r in got.items():
        own = rows[rows.run_id == run]
        x, y = own[method].to_numpy(), own.truth.to_numpy()
        t = np.maximum(1 - (x - np.median(x)), 1)
        s = 1 + 49 * (t - t.min()) / (t.max() - t.min()) if t.max() > t.min() else np.full(len(t), 25.0)
        for z, names in ((x, ("pearson_corr", "mae", "rmse")), (s, ("stretched_corr", "stretched_mae", "stretched_rmse"))):
            if len(z) > 1 and z.std() > 1e-9 and y.std() > 1e-9:
                assert r[names[0]] == pytest.approx(np.corrcoef(z, y)[0, 1], abs=1e-4)
            assert r[names[1]] == pytest.approx(np.abs(z - y).mean(), abs=1e-4) and r[names[2]] == pytest.approx(np.sqrt(((z - y) ** 2).mean()), abs=1e-4)
    frame = spark.createDataFrame([tuple(r) for r in got.values()], evaluation_schema)
    total = evaluation.summary(frame).collect()
    assert sum(t.runs for t in total) == len(got)
    for t in total:
        own = [r.mae for r in got.values() if (r.grp, r.part, r.method) == (t.grp, t.part, t.method)]
        assert t.runs == len(own) and t.mae_mean == pytest.approx(np.mean(own), abs=1e-3)


def test_domains(spark, windows):
    for domain, width in (("time", 7), ("frequency", None), ("combined", 57)):
        assert set(stages.DOMAINS) >= {domain}
        sizes = {len(r.f) for r in WindowFeatures(inputCol="v", outputCol="f", domain=domain).transform(windows).collect()}
        assert len(sizes) == 1 and (width is None or sizes == {width})


@pytest.mark.parametrize("fit", [lambda d, s: evaluation.warping.fit(d, s)[1], lambda d, s: stages.SeededKMeans(inputCol="v", seeds=s).fit(d)])
def test_rounds_dont_make_their_rows_again(spark, fit):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [([float(x) for x in np.random.default_rng(i).random(6) * 9],) for i in range(40)]
    fit(spark.createDataFrame(rows, "v array<double>").mapInArrow(run, "v array<double>"), [[0.0] * 6, [9.0] * 6])
    assert made.value == 40
