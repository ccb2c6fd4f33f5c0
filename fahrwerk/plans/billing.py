"""Registered queries of window billing and its evaluation, beyond the single steps in ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import autoencoder, cluster, features, lagged, lineage, lstm_training, pricing, ranks, warping
from ..operators import sequence as sq
from ..sources.telemetry import SHIP_SQL, TELE_SQL, shipments, telemetry
from .base import query, r
from .queries import _BASE, _DIST, _WIN, GENERIC_SQL, GROUPS_SQL, JOIN_GROUPS, PRICE2, _vectors, _windows, baseline, metrics, with_groups

# Contexts, their blocks and centroids


def _contexts(spark, sf_dir) -> DataFrame:
    """Telemetry with the kind of event as context: its stretches are long enough to be centroids."""
    return telemetry(spark, sf_dir).select("run_id", "seq", "value", "k", F.col("event_type").alias("context"))


_BLOCKS = f"{TELE_SQL}, isl as (select *, seq - row_number() over (partition by run_id, event_type order by seq) as g from tele), blk as (select run_id, event_type as context, g, min(seq) as start, count(*) as n, list(value order by seq) as v, round(sum(value), 4) as total from isl group by run_id, event_type, g)"


@query(f"with {_BLOCKS} select context, count(*) as blocks, cast(sum(n) as bigint) as rows, max(n) as longest, count(*) filter (n > 1) as usable from blk group by context")
def context_accumulation(spark, sf_dir):
    b = sq.context_blocks(_contexts(spark, sf_dir), "value")
    return b.groupBy("context").agg(F.count("*").alias("blocks"), F.sum("n").alias("rows"), F.max("n").alias("longest"), F.count_if(F.col("n") > 1).alias("usable"))


_CHOSEN = f"{_BLOCKS}, chosen as (select context, arg_min(run_id, (run_id, start)) as run_id, arg_min(start, (run_id, start)) as start, arg_min(v, (run_id, start)) as v from blk where n > 1 group by context)"


def chosen_centroids(spark, sf_dir) -> DataFrame:
    return sq.chosen_blocks(sq.context_blocks(_contexts(spark, sf_dir), "value"))


@query(f"with {_CHOSEN} select context, run_id, start, len(v) as n, round(list_sum(v), 4) as total, {PRICE2.replace('context', 'chosen.context')} as price from chosen")
def centroid_choice(spark, sf_dir):
    c = chosen_centroids(spark, sf_dir)
    return c.select("context", "run_id", "start", F.size("v").cast("long").alias("n"), r(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"), labels.context_price(F.col("context")).alias("price"))


@query(f"with {_BLOCKS} select run_id, context, list_transform(range(count(*) + 1), lambda i: cast(coalesce(list_sum(list_slice(list(n order by start), 1, i)), 0) as bigint)) as bounds, round(sum(total), 3) as total from blk group by run_id, context")
def context_segments(spark, sf_dir):
    s = sq.context_segments(_contexts(spark, sf_dir), "value")
    return s.select("run_id", "context", "bounds", r(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query()
def squeezed_spectrum(spark, sf_dir):
    """Mean squeezed magnitude of each run's signal in each context."""
    s = sq.context_segments(_contexts(spark, sf_dir), "value")
    return s.select("run_id", "context", F.transform(features.squeezed_energy("v"), lambda x: F.round(x, 6)).alias("rows"))


# Features


@query(f"""with {_WIN}, m as (select run_id, win, avg(x) as m, sqrt(var_samp(x)) + 1e-8 as s from x group by run_id, win)
  select run_id, win, [min(x), max(x), round(avg(x), 4), round(sqrt(avg(x * x)), 4), round(var_samp(x), 2), round(avg(power((x - m), 3)) / power(max(s), 3), 4), round(avg(power((x - m), 4)) / power(max(s), 4), 4), 0, 0, 0, 0] as f from x join m using (run_id, win) group by run_id, win""")
def features_seven(spark, sf_dir):
    f = _windows(spark, sf_dir).select("run_id", "win", features.seven_features(F.col("v")).alias("f"))
    places = [15, 15, 4, 4, 2, 4, 4, 4, 4, 4, 4]
    return f.select("run_id", "win", F.array(*[r(F.col("f")[i], n) for i, n in enumerate(places)]).alias("f"))


_RFFT = f"{_WIN}, c as (select run_id, win, b as bin, sum(x * cos(2 * pi() / 30 * b * i)) as re, sum(x * sin(2 * pi() / 30 * b * i)) as im from x cross join range(16) t(b) group by all), mag as (select run_id, win, bin, sqrt(re * re + im * im) as m from c)"


@query(f"with {_RFFT} select run_id, win, round(min(m), 4) as min, round(max(m), 4) as max, round(avg(m), 4) as mean, round(sqrt(avg(m * m)), 4) as rms, round(var_samp(m), 1) as var, round(sqrt(sum(m)) / avg(abs(m)), 5) as shape, round(max(m) / sqrt(avg(m * m)), 5) as crest from mag group by run_id, win")
def frequency_features(spark, sf_dir):
    f = _windows(spark, sf_dir).select("run_id", "win", features.spectrum("v").alias("s")).select("run_id", "win", features.shape_features(F.col("s")).alias("f"))
    places = {"var": 1, "shape": 5, "crest": 5}
    return f.select("run_id", "win", *[r(F.col(f"f.{c}"), places.get(c, 4)).alias(c) for c in ("min", "max", "mean", "rms", "var", "shape", "crest")])


@query()
def band_passed(spark, sf_dir):
    """Windows in the band from 1 to 3 Hz."""
    w = _windows(spark, sf_dir)
    return w.select("run_id", "win", F.transform(features.band_passed("v", F.lit(1.0), F.lit(3.0), F.lit(10.0)), lambda x: F.round(x, 6)).alias("v"))


@query()
def combined_features(spark, sf_dir):
    """57 features of each of two signals, side by side."""
    w = sq.tumbling_windows(telemetry(spark, sf_dir).withColumn("k", F.col("k").cast("double")), ["value", "k"])
    both = F.concat(features.combined_features(F.col("value")), features.combined_features(F.col("k")))
    return w.select("run_id", "win", F.transform(both, lambda x: F.round(x, 4)).alias("f"))


# Distances to centroids, hybrid features


def _warped_matrix(windows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Warping distance of each window to each centroid; centroids are one per context."""
    c = F.broadcast(centroids.select("context", F.col("v").alias("c")))
    return windows.crossJoin(c).select("run_id", "win", "context", features.dtw_distance("v", "c").alias("d"))


@query()
def warped_clusters(spark, sf_dir):
    """Windows by k-means under warping, from the contexts' centroids until it settles; clusters by the order of contexts."""
    w = _windows(spark, sf_dir)
    seeds = [c.v for c in chosen_centroids(spark, sf_dir).orderBy("context").collect()]
    centroids, _ = warping.fit(w, seeds)
    return warping.assign(w, centroids, ["run_id", "win"]).select("run_id", "win", "cluster", r(F.col("d")).alias("d"))


@query()
def warped_matrix(spark, sf_dir):
    return _warped_matrix(_windows(spark, sf_dir), chosen_centroids(spark, sf_dir)).withColumn("d", r(F.col("d")))


@query()
def hybrid_features(spark, sf_dir):
    """Features of each window with its distances to the centroids, standardized by population moments."""
    w = _windows(spark, sf_dir)
    near = _warped_matrix(w, chosen_centroids(spark, sf_dir)).groupBy("run_id", "win").agg(F.transform(F.sort_array(F.collect_list(F.struct("context", "d"))), lambda x: x["d"]).alias("d"))
    joined = w.select("run_id", "win", F.slice(features.seven_features(F.col("v")), 1, 7).alias("f")).join(near, ["run_id", "win"]).select("run_id", "win", F.concat("f", "d").alias("v"))
    width = joined.agg(F.max(F.size("v"))).first()[0] or 0
    n, mean, cov = cluster.moments(joined, "v", width)
    scale = [(float(m), float((cov[i, i] * max(n - 1, 1) / max(n, 1)) ** 0.5) or 1.0) for i, m in enumerate(mean)]
    return joined.select("run_id", "win", F.array(*[r((F.col("v")[i] - m) / s, 5) for i, (m, s) in enumerate(scale)]).alias("f"))


# Evaluation


def _methods(spark, sf_dir) -> DataFrame:
    """Prices of each window by method."""
    b = baseline(spark, sf_dir).select("run_id", "win", "truth", "base")
    s = pricing.stretched(b, "base", ["run_id"])
    return b.select("run_id", "win", "truth", F.lit("baseline").alias("method"), F.col("base").alias("price")).unionByName(s.select("run_id", "win", "truth", F.lit("stretched").alias("method"), F.col("stretched").alias("price")))


_STRETCH = "turned as (select *, greatest(1.0::double, 1 - (base - median(base) over (partition by {by}))) as t from {of}), st as (select *, min(t) over (partition by {by}) as a, max(t) over (partition by {by}) as b from turned), stretched as (select *, case when a = b then 25.0::double else 1 + 49 * (t - a) / nullif(b - a, 0) end as stretched from st)"
_METHODS = f"{_BASE}, {_STRETCH.format(by='run_id', of='base')}, prices as (select run_id, win, truth, 'baseline' as method, base as price from base union all select run_id, win, truth, 'stretched', stretched from stretched)"
_CORR = "case when isnan(corr(price, truth)) then null else round(corr(price, truth), 5) end as pearson_corr"


@query(f"with {_METHODS} select run_id, method, {_CORR}, round(avg(abs(price - truth)), 5) as mae, round(sqrt(avg((price - truth) * (price - truth))), 5) as rmse from prices group by run_id, method")
def eval_by_run_method(spark, sf_dir):
    m = metrics(_methods(spark, sf_dir), ["run_id", "method"], "price")
    return m.select("run_id", "method", *[r(F.col(c), 5).alias(c) for c in ("pearson_corr", "mae", "rmse")])


@query(f"with {_METHODS}, {GROUPS_SQL}, m as (select grp, mass, friction, run_id, method, avg(abs(price - truth)) as mae from prices {JOIN_GROUPS} group by all) select mass, friction, method, round(avg(mae), 5) as mae_mean, round(stddev_samp(mae), 5) as mae_std from m group by mass, friction, method")
def summary_by_method(spark, sf_dir):
    m = with_groups(metrics(_methods(spark, sf_dir), ["run_id", "method"], "price"))
    return m.groupBy("mass", "friction", "method").agg(r(F.avg("mae"), 5).alias("mae_mean"), r(F.stddev_samp("mae"), 5).alias("mae_std"))


@query(f"with {_BASE}, {GROUPS_SQL}, g as (select * from base {JOIN_GROUPS}), {_STRETCH.format(by='grp', of='g')} select grp, run_id, win, round(stretched, 4) as price from stretched")
def price_stretched_group(spark, sf_dir):
    """Turned at the median of a whole group of runs."""
    g = with_groups(baseline(spark, sf_dir).select("run_id", "win", "base"))
    return pricing.stretched_in_groups(g, "base", ["grp"]).select("grp", "run_id", "win", r(F.col("stretched")).alias("price"))


@query(f"with {_BASE}, {GROUPS_SQL} select grp, run_id, win, row_number() over (partition by grp order by truth, run_id, win) as place, round(truth, 6) as truth, round(base, 5) as price from base {JOIN_GROUPS}")
def sorted_pairs(spark, sf_dir):
    """Prices in order of the ground truth."""
    g = with_groups(baseline(spark, sf_dir))
    g = ranks.numbered(g, ["grp"], ["truth", "run_id", "win"], "place")
    return g.select("grp", "run_id", "win", (F.col("place") + 1).alias("place"), r(F.col("truth"), 6).alias("truth"), r(F.col("base"), 5).alias("price"))


@query(f"with {_BASE}, {GROUPS_SQL} select run_id, win, round(base, 5) as price from base {JOIN_GROUPS} where grp = 'group_3'")
def single_group(spark, sf_dir, group: str = "group_3"):
    g = with_groups(baseline(spark, sf_dir)).where(F.col("grp") == group)
    return g.select("run_id", "win", r(F.col("base"), 5).alias("price"))


@query(f"with {TELE_SQL}, {GROUPS_SQL} select grp, count(*) as n from tele {JOIN_GROUPS} group by grp having count(*) filter (value > 489.9) = 0")
def whole_groups(spark, sf_dir):
    """Groups none of whose rows misses a value (values above 489.9 count as missing here)."""
    t = telemetry(spark, sf_dir).withColumn("value", F.when(F.col("value") <= 489.9, F.col("value")))
    return sq.whole_groups(with_groups(t), ["grp"], ["value"]).groupBy("grp").agg(F.count("*").alias("n"))


@query(f"with {TELE_SQL} select run_id, cast(seq // 30 as bigint) as win, case when substr(md5(run_id || ':' || seq // 30), 1, 2) < 'b3' then 'train' when substr(md5(run_id || ':' || seq // 30), 1, 2) < 'd9' then 'validation' else 'test' end as part from tele group by run_id, seq // 30 having count(*) = 30")
def random_split(spark, sf_dir):
    """70, 15 and 15 of 100 windows, by a digest of the window's name."""
    return sq.random_split(_windows(spark, sf_dir).select("run_id", "win"), ["run_id", "win"])


# Clusters


@query(f"with {_DIST} select centroid, row_number() over (order by sum(c), centroid) - 1 as place, round(sum(c), 5) as level from c group by centroid")
def centroid_order(spark, sf_dir):
    """Centroids by the sum of their features."""
    c = cluster.mean_vectors(_vectors(spark, sf_dir), "label").withColumnRenamed("label", "centroid")
    return cluster.ranked_centroids(c, F.aggregate("c", F.lit(0.0), lambda a, x: a + x)).select("centroid", "place", r(F.col("level"), 5).alias("level"))


_SEEDS = "s as (select row_number() over (order by md5('42:' || vec_id)) - 1 as centroid, vec_id, embedding from embeddings qualify centroid < 8)"


@query(f"""with {_SEEDS}, v as (select vec_id, unnest(range(len(embedding))) as i, unnest(embedding)::double as x from embeddings), c as (select centroid, unnest(range(len(embedding))) as i, unnest(embedding)::double as c from s),
  d as (select v.vec_id, centroid, sqrt(sum((x - c) * (x - c))) as d from v join c using (i) group by all) select vec_id, arg_min(centroid, (d, centroid)) as centroid, round(min(d), 5) as d from d group by vec_id""")
def random_start(spark, sf_dir):
    """The nearest of eight points that a digest picks: where k-means with a random start begins."""
    p = _vectors(spark, sf_dir)
    return cluster.assign(p, cluster.random_seeds(p, 8, "vec_id"), ["vec_id"]).select("vec_id", "centroid", r(F.col("d"), 5).alias("d"))


@query()
def kmeans_random(spark, sf_dir):
    p = _vectors(spark, sf_dir)
    c = cluster.seeded_kmeans(p, cluster.random_seeds(p, 8, "vec_id"), ["vec_id"])
    return cluster.assign(p, c, ["vec_id"]).select("vec_id", "centroid", r(F.col("d")).alias("d"))


@query("""with v as (select label, unnest(range(len(embedding))) as i, unnest(embedding)::double as x from embeddings), s as (select i, min(x) as lo, max(x) as hi, count(*) as n from v group by i),
  c as (select i, n, label, least(floor((x - lo) / nullif(hi - lo, 0) * 10), 9) as bin, count(*) as c from v join s using (i) group by all), b as (select *, sum(c) over (partition by i, bin) as ob, sum(c) over (partition by i, label) as ol from c)
  select cast(i as int) as i, round(sum(c / n * ln(c * n / (ob * ol))), 5) as mi from b group by i""")
def mutual_information(spark, sf_dir):
    return cluster.mutual_information(_vectors(spark, sf_dir), "label").select("i", r(F.col("mi"), 5).alias("mi"))


_PSI = lambda x: f"(ln({x} + 6) - 1 / (2 * ({x} + 6)) - 1 / (12 * power({x} + 6, 2)) + 1 / (120 * power({x} + 6, 4)) - 1 / (252 * power({x} + 6, 6)) + 1 / (240 * power({x} + 6, 8)) - {' - '.join(f'1 / ({x} + {k})' for k in range(6))})"


@query(f"""with v as (select vec_id, label, count(*) over (partition by label) as n_label, embedding from embeddings where label is not null qualify n_label > 1), x as (select vec_id, label, n_label, unnest(range(len(embedding))) as i, unnest(embedding)::double as x from v),
  near as (select a.i, a.vec_id, any_value(a.x) as x, any_value(a.n_label)::double as n_label, least(3, any_value(a.n_label) - 1)::double as k, list_sort(list(abs(a.x - b.x))) as away from x a join x b on a.i = b.i and a.label = b.label and a.vec_id <> b.vec_id group by a.i, a.vec_id),
  d as (select i, vec_id, x, n_label, k, away[k::int] as d from near),
  m as (select d.i, d.vec_id, any_value(d.n_label) as n_label, any_value(d.k) as k, count(*)::double as m from d join x c on c.i = d.i and (abs(c.x - d.x) < d.d or (d.d = 0 and c.x = d.x)) group by d.i, d.vec_id)
  select cast(i as int) as i, round(greatest(0::double, {_PSI('count(*)::double')} + avg({_PSI('k')}) - avg({_PSI('n_label')}) - avg({_PSI('m')})), 5) as mi from m group by i""")
def neighbour_information(spark, sf_dir):
    """Mutual information of each component with the label, by the third nearest neighbour."""
    return cluster.neighbour_information(_vectors(spark, sf_dir), "label").select("i", r(F.col("mi"), 5).alias("mi"))


# Scaling back, errors, names


@query(f"with {SHIP_SQL} select run_id, seq, round(quantity, 4) as quantity from ship")
def denormalized(spark, sf_dir):
    """Scaled by minimum and maximum, and back."""
    s = shipments(spark, sf_dir)
    m = s.agg(F.min("quantity").alias("lo"), F.max("quantity").alias("hi"))
    back = s.crossJoin(F.broadcast(m)).withColumn("x", (F.col("quantity") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return back.select("run_id", "seq", r(F.col("x") * (F.col("hi") - F.col("lo")) + F.col("lo")).alias("quantity"))


@query()
def window_errors(spark, sf_dir):
    """Mean absolute reconstruction error of each signal in each window."""
    s = shipments(spark, sf_dir).select("run_id", "seq", "quantity", (F.col("price") / 1000).alias("price"), "discount", "tax")
    parts = lineage.cut(lagged.stretches(s, ["quantity", "price", "discount", "tax"]))
    mean, top = lagged.fit(parts, 4)
    return lagged.window_errors(parts, mean, top, 4).select("run_id", "seq", F.transform("error", lambda x: F.round(x, 5)).alias("error"))


def lstm_windows(spark, sf_dir) -> DataFrame:
    """Windows of four signals with their physics group and their part of the split."""
    s = shipments(spark, sf_dir)
    w = autoencoder.tumbling_frames(s, ["quantity", "price", "discount", "tax"])
    return with_groups(sq.random_split(w, ["run_id", "win"])).select("grp", "run_id", F.col("win").alias("seq"), "v", "part")


@query()
def lstm_test_errors(spark, sf_dir):
    """Errors of each signal in the test windows, by an LSTM autoencoder that is trained for each physics group."""
    w = lstm_windows(spark, sf_dir)
    models = lstm_training.fit(w, 4, hidden=(24, 12, 6), epochs=12)
    e = lstm_training.errors(w.where("part = 'test'"), models)
    return e.select("grp", "run_id", F.col("seq").alias("win"), F.transform("error", lambda x: F.round(x, 5)).alias("error"))


@query(f"with {TELE_SQL} select event_id, 'simulation_' || run_id || '_mass_' || (run_id % 3) || '_friction_' || (k % 4) / 4.0::double as name, cast(run_id as int) as id, make_timestamp((seq * 1000003) // 1000) as t, cast((seq * 1000003) % 1000 as int) as nanos, {GENERIC_SQL} as generic from tele")
def names_and_times(spark, sf_dir):
    """File names of runs, the id that splitting them gives, and whole numbers as nanoseconds since 1970: Spark's times hold microseconds, the rest stands beside them."""
    t = telemetry(spark, sf_dir)
    name = labels.run_name(F.col("run_id"), F.col("run_id") % 3, (F.col("k") % 4) / 4)
    return t.select("event_id", name.alias("name"), labels.split_id(name).alias("id"), labels.index_time(F.col("seq") * 1000003).alias("t"), labels.index_nanos(F.col("seq") * 1000003).alias("nanos"), labels.generic_context(F.col("context")).alias("generic"))


@query(f"with {TELE_SQL} " + " union all ".join(f"select '{c}' as name, count(*) as n, count(*) - count({c}) as nulls, count(distinct {c}) as kinds, cast(min({c}) as double) as lo, cast(max({c}) as double) as hi from tele" for c in ("run_id", "seq", "value", "k")))
def column_profile(spark, sf_dir):
    """One row per column: rows, nulls, distinct values, least and largest."""
    t = telemetry(spark, sf_dir)
    names = ["run_id", "seq", "value", "k"]
    one = lambda c: F.struct(F.lit(c).alias("name"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.countDistinct(c).alias("kinds"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"))
    return t.agg(F.array(*[one(c) for c in names]).alias("all")).select(F.explode("all").alias("c")).select("c.*")
