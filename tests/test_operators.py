import numpy as np
import pytest
from pyspark.sql import functions as F

from fahrwerk.functions import codec, geo, labels, text, units
from fahrwerk.operators import autoencoder, cluster, features, joins, pricing, reduction
from fahrwerk.operators import sequence as sq


def run(spark, contexts, values=None):
    values = values or [float(i) for i in range(len(contexts))]
    return spark.createDataFrame([(1, i, c, v) for i, (c, v) in enumerate(zip(contexts, values, strict=True))], "run_id long, seq long, context string, value double")


def col(df, name, order="seq"):
    return [r[name] for r in df.orderBy(order).collect()]


PRICES = [
    ("road", 1.0), ("ramp_asc_10.0_1.0_1", 17.0), ("ramp_desc_0.5_1.0_1", 1.5), ("ramp_desc_5.0_1.0_1", 1.0), ("ramp_two_way_5.0_1.0_1", 3.0), ("ramp__10.0_1.0_1", 3.0),
    ("crash", 50.0), ("pothole_small_2.56_1", 15.0), ("speedbump_raised_2.0_1", 8.0), ("elevated_crosswalk__2.0_1", 5.0), ("cut__0.1_1", 3.0), ("unknown", 3.0), (None, 1.0),
]


def test_prices(spark):
    df = spark.createDataFrame([(c,) for c, _ in PRICES], "c string").select(labels.context_price(F.col("c")).alias("p"), labels.context_price(F.col("c"), crash=False).alias("q"))
    assert [r.p for r in df.collect()] == [p for _, p in PRICES]
    assert df.collect()[6].q == 3.0


def test_generic_and_coarse(spark):
    df = spark.createDataFrame([("ramp_asc_2.5_90.5_1",), ("pothole_small_2.56_3",), (None,), ("road",)], "c string")
    got = df.select(labels.generic_context(F.col("c")).alias("g"), labels.coarse_context(F.col("c")).alias("k")).collect()
    assert [r.g for r in got] == ["ramp_asc_2.5_90.5", "pothole_small_2.56", "unknown", "road"]
    assert [r.k for r in got] == ["ramp_asc", "pothole", "unknown", "road"]


@pytest.mark.parametrize("spike,low,high", [(20, 10, 31), (0, 0, 11), (39, 29, 39)])
def test_crash_dilation(spark, spike, low, high):
    df = run(spark, ["road"] * 40, [99.0 if i == spike else 0.0 for i in range(40)])
    got = col(df.withColumn("c", sq.crash_dilation(None, F.col("value") > 10)), "c")
    assert [i for i, c in enumerate(got) if c == "crash"] == list(range(low, high + 1))


@pytest.mark.parametrize("labels_,want", [("a road road a", "a a a a"), ("road a", "road a"), ("a road", "a road"), ("a road b", "a road b"), ("road road", "road road")])
def test_gap_fill(spark, labels_, want):
    assert col(run(spark, labels_.split()).withColumn("c", sq.gap_fill()), "c") == want.split()


@pytest.mark.parametrize("n,windows", [(29, 0), (30, 1), (31, 1), (60, 2)])
def test_window_tail(spark, n, windows):
    assert sq.tumbling_windows(run(spark, ["road"] * n), ["value"]).count() == windows


def test_representative_samples(spark):
    long = {r.context: r.sample for r in sq.representative_samples(run(spark, ["a"] * 35 + ["b"] * 7), "value").collect()}
    assert long["a"] == [float(i) for i in range(30)]
    assert long["b"] == [35.0 + i % 7 for i in range(30)]
    two = sq.representative_samples(run(spark, ["a"] * 15 + ["b"] + ["a"] * 20), "value").where("context = 'a'").first().sample
    assert two == [float(i) for i in range(16, 36)] + [float(i) for i in range(10)]


def test_blocks_with_null_labels(spark):
    assert sorted(r.n for r in sq.blocks(run(spark, ["a", None, None, "a"])).collect()) == [1, 1, 2]


def test_centred_window_edges(spark):
    got = col(run(spark, ["road"] * 40).withColumn("m", sq.centred(None, F.avg("value"))), "m")
    assert got[:15] == [None] * 15 and got[-14:] == [None] * 14 and got[15] == 14.5


def test_spatial_cases(spark):
    f = spark.createDataFrame([(0, 0, "ramp", 0.0, 0.0, 0.0, 20.0, 0.0, 0.0), (1, 0, "pothole", 100.0, 0.0, 0.0, 100.0, 0.0, 0.0)], "type_rank int, list_idx int, ftype string, ax double, ay double, az double, bx double, by double, bz double")
    p = spark.createDataFrame([(1, 100.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0), (3, 10.0, 0.0, 0.0), (4, 0.0, 0.0, 10.0), (5, 25.0, 0.0, 0.0), (6, -3.0, -4.0, 0.0)], "id int, x double, y double, z double")
    got = {r.id: r.feature for r in joins.spatial_context(p, f, ["id"]).collect()}
    assert got == {1: "pothole_0", 2: "ramp_0", 3: "ramp_0", 4: "road", 5: "ramp_0", 6: "ramp_0"}


def test_spatial_against_all_pairs(spark):
    """Dense features on lines, ramps among them: the same as by all pairs, and cells keep few."""
    rng = np.random.default_rng(3)
    x, y, kind = rng.integers(0, 600, 3000) / 10, rng.integers(0, 20, 3000) * 2.0, rng.integers(0, 3, 3000)
    f = np.stack([x, y, np.zeros(3000), x + 12.0 * (kind == 0), y, np.zeros(3000)], axis=1)
    p = np.stack([rng.integers(0, 8000, 400) / 100, rng.integers(0, 60, 400).astype(float), np.zeros(400)], axis=1)
    features = spark.createDataFrame([(int(k), i, f"t{k}", *map(float, r)) for i, (k, r) in enumerate(zip(kind, f, strict=True))], "type_rank int, list_idx int, ftype string, ax double, ay double, az double, bx double, by double, bz double")
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id int, x double, y double, z double")
    want = {}
    for i, q in enumerate(p):
        d = f[:, 3:] - f[:, :3]
        n = (d * d).sum(axis=1)
        t = np.clip(((q - f[:, :3]) * d).sum(axis=1) / np.where(n == 0, 1, n), 0, 1)[:, None]
        off = q - (f[:, :3] + t * d)
        near = np.flatnonzero(((off * off).sum(axis=1) <= 25) & (q >= np.minimum(f[:, :3], f[:, 3:]) - 5).all(axis=1) & (q <= np.maximum(f[:, :3], f[:, 3:]) + 5).all(axis=1))
        want[i] = min(((kind[k], k) for k in near), default=None)
    got = {r.id: r.feature for r in joins.spatial_context(points, features, ["id"]).collect()}
    assert got == {i: "road" if w is None else f"t{w[0]}_{w[1]}" for i, w in want.items()}
    celled = joins._celled(points, 5.0)
    assert joins.ranked_cells(features, celled, 5.0).count() < 12 * celled.select("cx", "cy", "cz").distinct().count()


def test_asof(spark):
    left = spark.createDataFrame([(1, t) for t in (0, 5, 10, 11)], "k int, t long")
    right = spark.createDataFrame([(1, 5, 50), (1, 10, 100)], "k int, t long, v int")
    assert col(joins.asof_before(left, right, ["k"], ["t"], "v"), "v", "t") == [50, 50, 50, 100]


def test_asof_sequential(spark):
    left = spark.createDataFrame([(1, i, t) for i, t in enumerate((1, 12, 13, 35))], "run_id long, rid long, t long")
    ego = spark.createDataFrame([(1, 0), (1, 10), (1, 20), (1, 30)], "run_id long, t long")
    # A row between the pointer and the next time moves it there; once it was jumped over, it sticks.
    assert col(joins.asof_sequential(left, ego, "run_id"), "ego", "rid") == [10, 20, 20, 20]


def test_units_round_trip(spark):
    df = spark.range(1).select(units.encode_digital(multi=F.lit(2), type=F.lit(5), subtype=F.lit(7), length=F.lit(24)).alias("u")).withColumn("d", units.decode_unit(F.col("u")))
    d = df.first().d
    assert (d.si, d.multi, d.type, d.subtype, d.length) == (0, 2, 5, 7, 24)
    d = spark.range(1).select(units.decode_unit(units.encode_si(m=F.lit(1), s=F.lit(6))).alias("d")).first().d
    assert (d.si, d.m, d.s, d.multi) == (1, 1, 6, 0)


def test_motion_vectors(spark):
    df = spark.createDataFrame([(1.5, -2.0, 0.25, 9.0, 2**62)], "speed double, heading double, yaw_rate double, accel double, id long")
    got = codec.round_trip(df).first()
    assert (got.back.speed, got.back.heading, int(got.back.id)) == (1.5, -2.0, 2**62)


def test_log(spark):
    log = "x\nLog Start:\n(u={a}=>7,d=16,t=100,sig=3)={[{id=1,speed=2.5},\n\t]}\n(u={b}=>8,d=2,t=101,sig=3)={1.25}\n(u={b}=>8,d=2,t=102,sig=3)={}\n(u={c}=>9,d=2,t=103,sig=3)={.-9}"
    got = text.log_entries(spark.createDataFrame([(log,)], "text string")).orderBy("pos").collect()
    assert [(r.unit, r.dev, r.t, r.value) for r in got] == [(7, 16, 100, None), (8, 2, 101, 1.25), (8, 2, 102, None)]
    assert got[0].value_mv[0].speed == 2.5


def test_logs_that_are_spoilt_or_broken(spark):
    one = "(u={a}=>7,d=1,t=1,sig=3)={1}\n"
    logs = [(1, "Log Start:\n.-9\n" + one + one), (2, "Log Start:\n" + one + "(u={b}=>8,d=2,t=2,sig=3)={.-9}\n" + one), (3, "Log Start:\n(u={a}=>x)\n" + one), (4, None), (5, "")]
    got = text.log_entries(spark.createDataFrame(logs, "log int, text string")).collect()
    assert sorted((r.log, r.pos, r.value) for r in got) == [(1, 0, 1.0), (1, 1, 1.0), (2, 0, 1.0), (3, 0, 1.0)]


def test_pointer_sticks_at_an_empty_stretch(spark):
    left = spark.createDataFrame([(1, i, t) for i, t in enumerate([5, 15, 15, 20, 45, 55])], "run_id long, rid long, t long")
    right = spark.createDataFrame([(1, t) for t in (0, 10, 20, 30, 40, 50, 60)], "run_id long, t long")
    got = [r.ego for r in joins.asof_sequential(left, right, "run_id").orderBy("rid").collect()]
    assert got == [10, 20, 20, 20, 20, 20]
    none = joins.asof_sequential(left, right.limit(0), "run_id").collect()
    assert [r.ego for r in none] == [None] * 6


def test_squeezed_tone_gathers_in_one_row():
    t = np.arange(200) / 10
    m, freq = features.squeezed(np.sin(2 * np.pi * 1.25 * t))
    row = m.mean(axis=1)
    assert abs(freq[row.argmax()] - 1.25) < 0.1 and row.max() > 5 * np.sort(row)[-4]


def test_batched_warping_equals_single():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 7)), rng.normal(size=(5, 4))
    for a, b, got in zip(x, y, features.warped(x, y), strict=True):
        d = np.full((8, 5), np.inf)
        d[0, 0] = 0
        for i in range(7):
            for j in range(4):
                d[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
        assert abs(got - d[-1, -1]) < 1e-9


def test_ecef_of_the_equator(spark):
    p = spark.range(1).select(geo.ecef(F.lit(0.0), F.lit(90.0), F.lit(10.0)).alias("p")).first().p
    assert abs(p.x) < 1e-6 and abs(p.y - (geo.AXIS + 10)) < 1e-6 and abs(p.z) < 1e-6


def test_spectrum_of_a_tone():
    t = np.arange(30) / 10
    f = features.spectrum_features(np.sin(2 * np.pi * 2 * t)[None])[0]
    assert abs(f[0] - 2) < 1e-6 and abs(f[4] - 2) < 1e-9
    assert not features.spectrum_features(np.zeros((1, 30))).any()
    assert not features.spectrum_features(np.ones((1, 1))).any()


def test_wavelet_prefers_the_tone():
    t = np.arange(120) / 10
    low, high = (features.wavelet_features(np.sin(2 * np.pi * f * t)[None])[0] for f in (0.5, 2.0))
    assert low[32] > high[32] and low.shape == (39,)


def test_band_pass_keeps_the_band():
    t = np.arange(4000) / 10000
    ratio = [np.abs(features.band_pass(np.sin(2 * np.pi * f * t)[None], 50, 450, 10000)[0][2000:]).max() for f in (5, 200, 3000)]
    assert ratio[0] < 0.01 and 0.95 < ratio[1] < 1.05 and ratio[2] < 0.01


def test_dtw():
    assert features.warped(np.array([[1.0, 2, 3]]), np.array([[1.0, 1, 2, 3, 3]])).tolist() == [0]
    assert features.warped(np.array([[0.0, 0]]), np.array([[1.0]])).tolist() == [2]


def test_flat_signal_features(spark):
    f = spark.createDataFrame([([5.0] * 30,)], "v array<double>").select(features.time_features(F.col("v")).alias("f")).first().f
    assert (f.skew, f.kurt, f.std, f.zcr) == (0.0, 0.0, 0.0, 0.0)


DIST = [(1, 0, 10.0, 0.0), (1, 1, 20.0, 3.0), (2, 0, 10.0, 1.0), (2, 1, 20.0, 1.0), (3, 0, 10.0, 1.0), (3, 1, 20.0, 5.0), (4, 0, 10.0, 200.0), (4, 1, 20.0, 300.0)]


@pytest.mark.parametrize("name,want", [("inverse", [10.0, 15.0, 10 + 10 / 6, 14.0]), ("hard", [10.0, 10.0, 10.0, 10.0]), ("threshold", [10.0, 15.0, 10.0, 10.0]), ("weighted_average", [10.0, 15.0, 10 + 10 / 6, 10.0]), ("exponential", [10.0, 15.0, 10.0, 10.0])])
def test_prices_of_windows(spark, name, want):
    d = spark.createDataFrame(DIST, "w int, centroid int, price double, d double")
    assert col(pricing.price_windows(d, ["w"], name), "price", "w") == pytest.approx(want)


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        pricing.price_windows(spark.range(1), ["id"], "none")


def test_kmeans_and_pca(spark):
    pts = spark.createDataFrame([(i, [float(i // 5) * 10 + i % 5, 1.0]) for i in range(10)], "id long, v array<double>")
    seeds = spark.createDataFrame([(0, [0.0, 1.0]), (1, [4.0, 1.0])], "centroid long, c array<double>")
    c = {r.centroid: r.c for r in cluster.seeded_kmeans(pts, seeds, ["id"]).collect()}
    assert c[0] == [2.0, 1.0] and c[1] == [12.0, 1.0]
    mean, top, share = cluster.pca(pts, "v", 2, least=1)
    assert mean == pytest.approx([7.0, 1.0]) and top[:, 0] == pytest.approx([1.0, 0.0]) and share[0] == pytest.approx(1.0)


def test_linear_autoencoder_flags_the_odd_window(spark):
    rows = [(1, i, float(np.sin(i / 2) + (5 if i == 70 else 0))) for i in range(120)]
    df = spark.createDataFrame(rows, "run_id long, seq long, a double")
    w = autoencoder.frames(df, ["a"])
    mean, top = autoencoder.fit_linear(w.where("seq < 30"), 30, 2)
    e = {r.seq: r.error for r in autoencoder.point_errors(df, w, mean, top, 1).collect()}
    assert e[0] is None and e[119] is None and max((v[0], k) for k, v in e.items() if v)[1] == 70


def test_lstm_shapes():
    rng = np.random.default_rng(1)
    layer = lambda i, n: {"ih": rng.normal(size=(4 * n, i)), "hh": rng.normal(size=(4 * n, n)), "b": np.zeros(4 * n)}
    x = rng.normal(size=(2, 30, 3))
    out = autoencoder.lstm_reconstruct(x, {"encoder": [layer(3, 5), layer(5, 2)], "decoder": [layer(2, 5)]}, (rng.normal(size=(3, 5)), np.zeros(3)))
    assert out.shape == x.shape


def test_lstm_errors_of_known_weights(spark):
    # One unit whose gates stay open copies nothing: with zero weights the output is the bias alone.
    zero = {"ih": np.zeros((8, 2)), "hh": np.zeros((8, 2)), "b": np.zeros(8)}
    layers, out = {"encoder": [zero], "decoder": [zero]}, (np.zeros((2, 2)), np.array([1.0, -1.0]))
    w = spark.createDataFrame([(1, [1.0, -1.0, 3.0, -1.0, 1.0, 2.0])], "run_id long, v array<double>")
    assert np.allclose(autoencoder.lstm_errors(w, layers, out, 2).first().error, [2 / 3, 1.0])
    assert np.allclose(autoencoder.lstm_errors(w, layers, out, 2, middle=True).first().error, [2.0, 0.0])
    rng = np.random.default_rng(1)
    cell = {"ih": rng.normal(size=(12, 2)), "hh": rng.normal(size=(12, 3)), "b": rng.normal(size=12)}
    x, h, c = rng.normal(size=(1, 4, 2)), np.zeros(3), np.zeros(3)
    for t in range(4):
        z = cell["ih"] @ x[0, t] + cell["hh"] @ h + cell["b"]
        gate = 1 / (1 + np.exp(-z))
        c = gate[3:6] * c + gate[:3] * np.tanh(z[6:9])
        h = gate[9:] * np.tanh(c)
        assert np.allclose(autoencoder.lstm(x, cell)[0, t], h)


def test_too_many_centroids_are_refused(spark, monkeypatch):
    monkeypatch.setattr(cluster, "MOST_CENTROIDS", 1)
    p = spark.createDataFrame([(1, [0.0])], "id long, v array<double>")
    c = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "centroid long, c array<double>")
    with pytest.raises(ValueError):
        cluster.with_distances(p, c)


def test_reducers_by_name(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [float(i % 2) + 0.01 * rng.normal(), *rng.normal(size=3).tolist()]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label long, v array<double>")
    for name in ("anova", "mutual_information"):
        r = reduction.fit_reducer(df, name, 4, "label", k=1)
        assert r.indices == [0]
    for name, width in (("pca", 4), ("incremental_pca", 4), ("none", 4), ("hybrid", 2)):
        out = reduction.fit_reducer(df, name, 4, "label", k=2, select=3).apply(df)
        assert {len(r[-1]) for r in out.select("z").collect()} == {width}, name
    for name, error in (("umap", RuntimeError), ("other", ValueError)):
        with pytest.raises(error):
            reduction.fit_reducer(df, name, 4)


def test_warped_alignments_equal_a_plain_computation():
    from fahrwerk.operators import warping

    rng = np.random.default_rng(12)
    for n, m in ((1, 1), (1, 4), (5, 1), (6, 9), (12, 12)):
        x, c = rng.integers(0, 4, (7, n)).astype(float), rng.integers(0, 4, m).astype(float)
        cost, _ = warping.aligned(x, c, back=False)
        sums = np.zeros((2, m))
        for row, got in zip(x, cost, strict=True):
            d = np.full((n + 1, m + 1), np.inf)
            d[0, 0] = 0
            for i in range(n):
                for j in range(m):
                    d[i + 1, j + 1] = (row[i] - c[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
            assert got == d[n, m]
            i, j = n, m
            while i and j:
                sums[:, j - 1] += row[i - 1], 1
                i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: d[p])
        assert np.array_equal(warping.barycentre_sums(x, c), sums)
        assert (warping.lower_bounds(x, c) <= cost + 1e-9).all()
    centroids = [rng.random(k) * s for k, s in ((4, 1), (4, 9), (6, 3), (5, 1))]
    x = rng.random((60, 8)) * rng.choice([1, 3, 9], (60, 1))
    every = np.stack([warping.aligned(x, c, back=False)[0] for c in centroids], axis=1)
    at, best = warping.nearest(x, centroids)
    assert (at == every.argmin(axis=1)).all() and np.allclose(best, every.min(axis=1))


def test_warped_clusters_leave_out_what_has_no_values(spark):
    from fahrwerk.operators import warping

    rows = [(1, [1.0, 2.0, 3.0]), (2, None), (3, []), (4, [1.0, None]), (5, [9.0, 9.0]), (6, [float("nan")])]
    series = spark.createDataFrame(rows, "id int, v array<double>")
    centroids, rounds = warping.fit(series, [[1.0, 3.0], [8.0]])
    got = {r.id: (r.cluster, r.d) for r in warping.assign(series, centroids, ["id"]).collect()}
    assert rounds == 2 and centroids[1].tolist() == [9.0] and got[5] == (1, 0.0) and got[1][0] == 0
    assert all(got[k] == (None, None) for k in (2, 3, 4, 6))


def test_digamma_and_neighbour_information(spark):
    from fahrwerk.operators import cluster

    euler = 0.5772156649015329
    psi = lambda n: sum(1 / k for k in range(1, int(n))) - euler
    for row in spark.range(1, 60).select("id", cluster.digamma(F.col("id").cast("double")).alias("psi")).collect():
        assert abs(row.psi - psi(row.id)) < 1e-9
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, 90).tolist() + [7]
    x = np.stack([rng.integers(0, 6, 91) * 1.0, rng.normal(size=91) + np.array(labels), rng.normal(size=91)], axis=1)
    frame = spark.createDataFrame([(int(c), [float(z) for z in v]) for c, v in zip(labels, x, strict=True)] + [(None, [1.0, 2.0, 3.0])], "label long, v array<double>")
    got = {r.i: r.mi for r in cluster.neighbour_information(frame, "label", k=4, step=0.5).collect()}
    for i in range(3):
        terms = []
        for a, c in zip(x[:, i], labels, strict=True):
            own = sorted(abs(a - b) for b, e in zip(x[:, i], labels, strict=True) if e == c)[1:]
            if own:
                k = min(4, len(own))
                d = own[k - 1]
                terms.append((psi(k), psi(len(own) + 1), psi(sum(abs(x[:-1, i] - a) < d) if d else sum(x[:-1, i] == a))))  # the last one is alone in its label
        mean = np.mean(terms, axis=0)
        assert abs(got[i] - max(0, psi(len(terms)) + mean[0] - mean[1] - mean[2])) < 1e-6
    assert got[1] > got[2]
