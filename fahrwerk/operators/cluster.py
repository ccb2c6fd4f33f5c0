"""Distances, seeded k-means, reduction, feature scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import segmented

MOST_CENTROIDS = 10_000


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def with_distances(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each point with each centroid (centroid, c, and more).

    Centroids are one per cluster, a number that the caller fixes; that they
    are few is checked, as every task gets them all.
    """
    n = centroids.count()
    if n > MOST_CENTROIDS:
        raise ValueError(f"{n} centroids are more than {MOST_CENTROIDS}")
    return points.crossJoin(F.broadcast(centroids)).withColumn("d", distance(F.col("v"), F.col("c")))


def mean_vectors(df: DataFrame, key: str, vector: str = "v") -> DataFrame:
    """Component-wise means as arrays."""
    parts = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("m"))
    return parts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda r: r["m"]).alias("c"))


def assign(points: DataFrame, centroids: DataFrame, key: list[str]) -> DataFrame:
    """The nearest centroid of each point; at equal distance the lower one."""
    d = with_distances(points, centroids)
    return d.groupBy(*key).agg(F.min_by("centroid", F.struct("d", "centroid")).alias("centroid"), F.min("d").alias("d"))


def seeded_kmeans(points: DataFrame, centroids: DataFrame, key: list[str], rounds: int = 20, tol: float = 1e-6) -> DataFrame:
    """Lloyd's rounds from given centroids; returns centroid, c.  Only the centroids come to the driver."""
    spark = points.sparkSession
    now = {r.centroid: np.array(r.c, float) for r in centroids.collect()}
    schema = "centroid long, c array<double>"
    for _ in range(rounds):
        c = spark.createDataFrame([(k, v.tolist()) for k, v in sorted(now.items())], schema)
        joined = points.join(assign(points, c, key).select(*key, "centroid"), key)
        new = {r.centroid: np.array(r.c, float) for r in mean_vectors(joined, "centroid").collect()}
        moved = max((float(np.abs(new[k] - now[k]).max()) for k in new), default=0.0)
        now |= new
        if moved <= tol:
            break
    return spark.createDataFrame([(k, v.tolist()) for k, v in sorted(now.items())], schema)


def moments(df: DataFrame, vector: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (n - 1): sums per partition, whose size depends on the width alone."""

    def run(batches):
        n, s, ss = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            x = np.stack(b[vector].to_list()) if len(b) else np.zeros((0, width))
            n, s, ss = n + len(x), s + x.sum(axis=0), ss + x.T @ x
        yield pd.DataFrame({"i": np.arange(width * width + width + 1), "v": np.concatenate([[n], s, ss.ravel()])})

    r = df.select(vector).mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas().v.to_numpy()
    n, s, ss = int(r[0]), r[1 : width + 1], r[width + 1 :].reshape(width, width)
    mean = s / max(n, 1)
    return n, mean, (ss - n * np.outer(mean, mean)) / max(n - 1, 1)


def principal(n: int, cov: np.ndarray, share: float, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Components of a covariance of n rows, and their explained shares."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    explained = np.clip(values, 0, None) / max(np.clip(values, 0, None).sum(), 1e-300)
    k = int(np.searchsorted(np.cumsum(explained), share - 1e-12) + 1)
    k = max(1, min(max(k, least), most, len(cov), max(n - 1, 1)))
    top = vectors[:, :k]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(k)])
    return top, explained[:k]


def pca(df: DataFrame, vector: str, width: int, share: float = 0.95, least: int = 10, most: int = 100):
    """(mean, components, explained shares): as many components as explain ``share``, between the bounds.

    A component's sign is that which makes its largest entry positive.
    """
    n, mean, cov = moments(df, vector, width)
    top, explained = principal(n, cov, share, least, most)
    return mean, top, explained


def project(df: DataFrame, vector: str, mean: np.ndarray, top: np.ndarray, name: str = "z") -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.to_list()) - mean) @ top)) if len(v) else v

    return df.withColumn(name, run(vector))


def anova_scores(df: DataFrame, label: str, vector: str = "v") -> DataFrame:
    """F score of each component: variance between labels over variance within."""
    x = df.select(label, F.posexplode(vector).alias("i", "x"))
    g = x.groupBy("i", label).agg(F.count("*").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("*")).alias("within"))
    t = g.groupBy("i").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum("within").alias("within"))
    between = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return t.select("i", ((between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"))


def mutual_information(df: DataFrame, label: str, vector: str = "v", bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each component, in equal-width bins, with the label."""
    x = df.select(label, F.posexplode(vector).alias("i", "x"))
    span = x.groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    # One row per component.
    at = F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    cells = x.join(span, "i").groupBy("i", "n", label, F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count("*").alias("c"))
    both = cells.withColumns({"of_bin": F.sum("c").over(Window.partitionBy("i", "bin")), "of_label": F.sum("c").over(Window.partitionBy("i", label))})
    return both.groupBy("i").agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("of_bin") * F.col("of_label")))).alias("mi"))


def random_seeds(points: DataFrame, k: int, key: str, vector: str = "v", seed: int = 42) -> DataFrame:
    """``k`` points in an order that a digest of key and seed makes random, and repeatable: centroid, c."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    first = points.select(order.alias("o"), F.col(vector).alias("c")).orderBy("o").limit(k)
    # As many rows as clusters.
    return first.select((F.row_number().over(Window.orderBy("o")) - 1).cast("long").alias("centroid"), "c")


def ranked_centroids(centroids: DataFrame, level: Column) -> DataFrame:
    """Centroids in order of their level: one row per cluster."""
    return centroids.withColumn("level", level).withColumn("place", (F.row_number().over(Window.orderBy("level", "centroid")) - 1).cast("long"))


def digamma(x: Column) -> Column:
    """The digamma function of numbers of at least 1: the series at x + 6, and back by the recurrence."""
    y = x + 6.0
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, F.lit(4))) - 1 / (252 * F.pow(y, F.lit(6))) + 1 / (240 * F.pow(y, F.lit(8)))
    return series - sum((1 / (x + float(k)) for k in range(1, 6)), 1 / x)


def neighbour_information(df: DataFrame, label: str, vector: str = "v", k: int = 3, step: float = 0.01) -> DataFrame:
    """Mutual information (nats, none below 0) of each component with the label, from distances to the k-th nearest neighbour.

    A value's k-th nearest neighbour among those of its label is among the k
    before and the k after it in order.  How many values of all labels lie
    nearer than that is the difference of two ranks, which running counts
    give over the values and the bounds together, in chunks of ``step``.
    Labels with fewer values than k + 1 take as many neighbours as there are;
    those with one value don't count.  Nulls don't count either.
    """
    x = df.select(F.col(label).alias("label"), F.posexplode(vector).alias("i", "x")).where("label is not null and x is not null")
    x = x.withColumn("x", F.col("x").cast("double"))
    own = Window.partitionBy("i", "label")
    order = own.orderBy("x")
    beside = [f("x", j).over(order) for j in range(1, k + 1) for f in (F.lag, F.lead)]
    steps = [F.struct(F.abs(b - F.col("x")).alias("d"), b.alias("b")) for b in beside]
    near = x.select("i", "x", F.count("*").over(own).alias("n_label"), F.array_sort(F.filter(F.array(*steps), lambda s: s["d"].isNotNull())).alias("away")).where("n_label > 1")
    near = near.withColumn("k", F.least(F.lit(k), F.col("n_label") - 1)).withColumn("far", F.element_at("away", F.col("k").cast("int"))).withColumn("d", F.col("far.d"))
    # The neighbour's own value is one bound, whatever sums round to.  Values at the bounds don't lie nearer; where the neighbour is equal, all equal values count.
    inner, outer = F.when(F.col("d") > 0, 0).otherwise(2), F.when(F.col("d") > 0, 2).otherwise(0)
    point = near.select("i", F.col("x").alias("at"), F.lit(1).alias("side"), F.lit(1).alias("one"), F.lit(0).alias("sign"))
    low = near.select("i", F.when(F.col("far.b") < F.col("x"), F.col("far.b")).otherwise(F.col("x") - F.col("d")).alias("at"), outer.alias("side"), F.lit(0).alias("one"), F.lit(-1).alias("sign"), "k", "n_label", "d", "x")
    high = near.select("i", F.when(F.col("far.b") > F.col("x"), F.col("far.b")).otherwise(F.col("x") + F.col("d")).alias("at"), inner.alias("side"), F.lit(0).alias("one"), F.lit(1).alias("sign"), "k", "n_label", "d", "x")
    every = point.unionByName(low, allowMissingColumns=True).unionByName(high, allowMissingColumns=True)
    ranked = segmented.scanned(every, {"below": segmented.Scan("sum", "one")}, ["i"], ["at", "side"], step).where("sign <> 0")
    # One row for each component, value, distance and label size: its two ranks, as often as it occurs.
    inside = ranked.groupBy("i", "x", "d", "k", "n_label").agg((F.sum(F.col("below") * F.col("sign")) / F.count_if(F.col("sign") == 1)).alias("m"), F.count_if(F.col("sign") == 1).alias("n"))
    mean = lambda c: F.sum(digamma(c.cast("double")) * F.col("n")) / F.sum("n")
    found = digamma(F.sum("n").cast("double")) + mean(F.col("k")) - mean(F.col("n_label")) - mean(F.col("m"))
    return inside.groupBy("i").agg(F.greatest(F.lit(0.0), found).alias("mi"))
