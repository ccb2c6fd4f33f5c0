"""Prices by all methods, fitted on training runs, and their errors on training and validation runs."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import lineage, pricing, warping
from ..operators.stages import FeatureReducer, JoinedVectors, SeededKMeans, Standardizer, WarpedDistances, WindowFeatures
from .base import query, r
from .billing import chosen_centroids
from .queries import _windows, baseline, metrics, ordered_split

METHODS = ("baseline", "kmeans", "dtw", "kmeans_dtw")


def prepared(method: str, seeds: list[list[float]]) -> Pipeline:
    """From windows (column v) to what k-means takes: features, for kmeans_dtw with the distances to the seeds, scaled and projected."""
    stages = [WindowFeatures(inputCol="v", outputCol="features", domain="time")]
    name = "features"
    if method == "kmeans_dtw":
        stages += [WarpedDistances(inputCol="v", outputCol="warped", seeds=seeds), JoinedVectors(inputCols=["features", "warped"], outputCol="joined")]
        name = "joined"
    return Pipeline(stages=[*stages, Standardizer(inputCol=name, outputCol="scaled"), FeatureReducer(inputCol="scaled", outputCol="reduced", strategy="pca")])


def fitted(windows: DataFrame, seeds: list[list[float]], method: str) -> PipelineModel:
    """A pipeline from windows to their distances to centroids that start as the seeds, k-means to convergence."""
    before = prepared(method, seeds).fit(windows)
    start = windows.sparkSession.createDataFrame([(i, [float(x) for x in s]) for i, s in enumerate(seeds)], "seed int, v array<double>")
    points = [row.reduced for row in before.transform(start).orderBy("seed").collect()]
    return PipelineModel([*before.stages, SeededKMeans(inputCol="reduced", outputCol="distances", seeds=points).fit(before.transform(windows))])


def priced(distances: DataFrame, prices: list[float], key: list[str]) -> DataFrame:
    """Prices weighted by 1 / distance to the centroids, whose prices these are."""
    spread = distances.select(*key, F.posexplode("distances").alias("centroid", "d"))
    spread = spread.withColumn("price", F.element_at(F.array(*[F.lit(float(p)) for p in prices]), F.col("centroid") + 1))
    return pricing.price_windows(spread, key, "inverse")


def method_prices(spark, sf_dir) -> DataFrame:
    """grp, run_id, win, part, truth, and the price of each method: centroids begin as the contexts' and are fitted on the training runs."""
    parts = ordered_split(spark, sf_dir)
    # Every fit reads the windows several times.
    windows = lineage.cut(_windows(spark, sf_dir).join(parts, "run_id"))
    chosen = chosen_centroids(spark, sf_dir).select("context", "v", labels.context_price(F.col("context")).alias("price")).orderBy("context").collect()
    seeds, prices = [[float(x) for x in c.v] for c in chosen], [c.price for c in chosen]
    train = windows.where("part = 'train'").select("run_id", "win", "v")
    every, key = windows.select("run_id", "win", "v"), ["run_id", "win"]
    found = [baseline(spark, sf_dir).select(*key, "truth", F.col("base").alias("baseline"))]
    for method in ("kmeans", "kmeans_dtw"):
        found.append(priced(fitted(train, seeds, method).transform(every), prices, key).withColumnRenamed("price", method))
    centres, _ = warping.fit(train, seeds)
    near = WarpedDistances(inputCol="v", outputCol="distances", seeds=[c.tolist() for c in centres]).transform(every)
    found.append(priced(near, prices, key).withColumnRenamed("price", "dtw"))
    return reduce(lambda a, b: a.join(b, key), found).join(parts, "run_id").select("grp", *key, "part", "truth", *METHODS)


@query()
def eval_all_methods(spark, sf_dir):
    """Correlation and errors of each method on each run, as priced and stretched around the run's median."""
    p = lineage.cut(method_prices(spark, sf_dir))
    long = p.select("grp", "run_id", "win", "part", "truth", F.explode(F.create_map(*[x for m in METHODS for x in (F.lit(m), F.col(m))])).alias("method", "price"))
    long = pricing.stretched(long, "price", ["run_id", "method"])
    by = ["grp", "run_id", "part", "method"]
    plain = metrics(long, by, "price")
    turned = metrics(long, by, "stretched").toDF(*by, "stretched_corr", "stretched_mae", "stretched_rmse")
    return plain.join(turned, by).select(*by, *[r(F.col(c), 5).alias(c) for c in ("pearson_corr", "mae", "rmse", "stretched_corr", "stretched_mae", "stretched_rmse")])


def summary(m: DataFrame) -> DataFrame:
    return m.groupBy("grp", "part", "method").agg(F.count("*").alias("runs"), r(F.avg("mae")).alias("mae_mean"), r(F.stddev_samp("mae")).alias("mae_std"), r(F.avg("rmse")).alias("rmse_mean"), r(F.avg("stretched_mae")).alias("stretched_mae_mean"))


@query()
def summary_all_methods(spark, sf_dir):
    """Mean and deviation of the errors by physics group, part and method."""
    return summary(eval_all_methods(spark, sf_dir))


@query()
def hybrid_clusters(spark, sf_dir):
    """k-means on features beside warped distances, from the contexts' centroids to convergence."""
    w = _windows(spark, sf_dir)
    seeds = [[float(x) for x in c.v] for c in chosen_centroids(spark, sf_dir).orderBy("context").collect()]
    out = fitted(w, seeds, "kmeans_dtw").transform(w)
    return out.select("run_id", "win", "cluster", F.transform("distances", lambda x: F.round(x, 4)).alias("distances"))
