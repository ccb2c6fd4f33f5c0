"""Window prices from distances to priced centroids, baselines and stretches.

Distance rows are (key..., centroid, price, d); centroids are few (one per
context), so each window has a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

LEAST_WEIGHT = 0.01
CLOSENESS = 0.8
DECAY = 3.0


def inverse_distance() -> Column:
    """Prices weighted by 1/d; at distance 0 the mean price of the centroids there."""
    zero = F.avg(F.when(F.col("d") == 0, F.col("price")))
    weight = 1 / F.nullif("d", F.lit(0.0))
    return F.coalesce(zero, F.sum(F.col("price") * weight) / F.sum(weight))


def nearest() -> Column:
    return F.min_by("price", F.struct("d", "centroid"))


def filtered_inverse() -> Column:
    """As ``inverse_distance``, without weights under the least one; without any, the nearest price."""
    zero = F.avg(F.when(F.col("d") == 0, F.col("price")))
    weight = F.when((F.col("d") > 0) & (1 / F.nullif("d", F.lit(0.0)) >= LEAST_WEIGHT), 1 / F.nullif("d", F.lit(0.0)))
    return F.coalesce(zero, F.sum(F.col("price") * weight) / F.sum(weight), nearest())


def threshold(closeness: float = CLOSENESS) -> Column:
    """The nearest price if it is clearly nearer than the second, else ``filtered_inverse``."""
    two = F.slice(F.array_sort(F.collect_list("d")), 1, 2)
    d1, d2 = F.get(two, F.lit(0)), F.get(two, F.lit(1))
    clear = (d2 == 0) | (1 - d1 / F.nullif(d2, F.lit(0.0)) >= closeness) | d2.isNull()
    return F.when(clear, nearest()).otherwise(filtered_inverse())


def exponential() -> Column:
    """Weights e^(-3 d), small ones dropped; without any, the nearest price."""
    w = F.exp(-DECAY * F.col("d"))
    weight = F.when(w >= LEAST_WEIGHT, w)
    return F.coalesce(F.sum(F.col("price") * weight) / F.sum(weight), nearest())


STRATEGIES = {"inverse": inverse_distance, "hard": nearest, "weighted_average": filtered_inverse, "threshold": threshold, "exponential": exponential}


def price_windows(distances: DataFrame, key: list[str], strategy: str) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown pricing strategy: {strategy}")
    return distances.groupBy(*key).agg(STRATEGIES[strategy]().alias("price"))


def scaled(value: Column, over: Window, low: float = 1.0, high: float = 50.0, flat: float = 25.0) -> Column:
    """To [low, high] by minimum and maximum; a flat signal to ``flat``."""
    lo, hi = F.min(value).over(over), F.max(value).over(over)
    return F.when(hi == lo, flat).otherwise(low + (high - low) * (value - lo) / F.nullif(hi - lo, F.lit(0.0)))


def stretched(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Turned around at the median, at least 1, then scaled."""
    w = Window.partitionBy(*by)
    turned = F.greatest(F.lit(1.0), 1 - (F.col(value) - F.median(value).over(w)))
    return df.withColumn("_turned", turned).withColumn("stretched", scaled(F.col("_turned"), w)).drop("_turned")


def stretched_in_groups(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """As ``stretched``, for groups of any size: medians by selection, and no group's rows meet in a task."""
    middle = ranks.quantiles(df, by, value, [0.5]).select(*by, F.col("q")[0].alias("_middle"))
    turned = df.join(middle, by).withColumn("_turned", F.greatest(F.lit(1.0), 1 - (F.col(value) - F.col("_middle"))))
    bounds = turned.groupBy(*by).agg(F.min("_turned").alias("_lo"), F.max("_turned").alias("_hi"))
    span = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    price = F.when(F.col("_hi") == F.col("_lo"), 25.0).otherwise(1 + 49 * (F.col("_turned") - F.col("_lo")) / span)
    return turned.join(bounds, by).withColumn("stretched", price).drop("_middle", "_turned", "_lo", "_hi")
