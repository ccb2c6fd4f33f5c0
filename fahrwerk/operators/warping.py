"""k-means of series under dynamic time warping, with barycentres of aligned values.

Series meet each centroid many at once, along the anti-diagonals of their
cost matrices; each cell remembers from which neighbour it came, and all rows
walk back together.  A centroid is measured only for series whose lower bound
(what lies outside the centroid's range, or the distance of first and last
values) doesn't already exceed the nearest distance found.

A round assigns every series to its nearest centroid (ties to the first) and
moves each centroid's values to the mean of what is aligned with them, from
sums that tasks send; centroids without series stay.  Rounds end when no value
moves by more than ``tol``.  Null and empty series, and those with nulls or
NaN, belong to no cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Series that are aligned at once: their cost matrices lie in memory.
TOGETHER = 1024


def aligned(x: np.ndarray, c: np.ndarray, back: bool = True):
    """Squared costs of series (rows of x) against a centroid, and with ``back`` each cell's step (by diagonal, row, place in the series)."""
    n, m = x.shape[1], len(c)
    last = np.full((3, len(x), n + 1), np.inf)  # diagonals s - 2, s - 1 and s, by the place in the series
    last[0, :, 0] = 0
    steps = np.zeros((n + m + 1, len(x), n + 1), np.uint8) if back else None
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        # Both on, then the series alone, then the centroid alone: the first of equal ones.
        came = np.stack([last[0][:, i - 1], last[1][:, i - 1], last[1][:, i]])
        if back:
            steps[s][:, i] = came.argmin(axis=0)
        last[2] = np.inf
        last[2][:, i] = came.min(axis=0) + (x[:, i - 1] - c[s - i - 1]) ** 2
        last = last[[1, 2, 0]]
    return last[1][:, n], steps


def barycentre_sums(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each value of a centroid the sum and the number of the series' values that are aligned with it."""
    _, steps = aligned(x, c)
    rows, i, j = np.arange(len(x)), np.full(len(x), x.shape[1]), np.full(len(x), len(c))
    out = np.zeros((2, len(c)))
    while len(rows):
        np.add.at(out[0], j - 1, x[rows, i - 1])
        np.add.at(out[1], j - 1, 1)
        step = steps[i + j, rows, i]
        i, j = i - (step < 2), j - (step != 1)
        on = (i > 0) & (j > 0)
        rows, i, j = rows[on], i[on], j[on]
    return out


def lower_bounds(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What the squared cost is at least."""
    outside = np.maximum(np.maximum(x - c.max(), c.min() - x), 0)
    ends = (x[:, 0] - c[0]) ** 2 + ((x[:, -1] - c[-1]) ** 2 if x.shape[1] > 1 or len(c) > 1 else 0)
    return np.maximum((outside * outside).sum(axis=1), ends)


def nearest(x: np.ndarray, centroids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared cost) of each series."""
    bounds = np.stack([lower_bounds(x, c) for c in centroids], axis=1)
    order = np.argsort(bounds, axis=1, kind="stable")
    best, at = np.full(len(x), np.inf), np.full(len(x), -1)
    for turn in range(len(centroids)):
        which = order[:, turn]
        # A hair more than the bound, for what rounding does.
        open_ = bounds[np.arange(len(x)), which] <= best * (1 + 1e-12)
        for k in np.unique(which[open_]):
            rows = np.flatnonzero(open_ & (which == k))
            cost, _ = aligned(x[rows], centroids[k], back=False)
            better = (cost < best[rows]) | ((cost == best[rows]) & (k < at[rows]))
            best[rows[better]], at[rows[better]] = cost[better], k
    return at, best


def _matrices(values: pd.Series):
    """(rows, matrix) of series of equal length, a few at a time; unusable ones are left out."""
    lengths: dict[int, list[int]] = {}
    arrays = [None if v is None else np.asarray(v, float) for v in values.to_numpy()]
    for k, v in enumerate(arrays):
        if v is not None and len(v) and not np.isnan(v).any():
            lengths.setdefault(len(v), []).append(k)
    for rows in lengths.values():
        for i in range(0, len(rows), TOGETHER):
            part = rows[i : i + TOGETHER]
            yield np.array(part), np.stack([arrays[k] for k in part])


def fit(series: DataFrame, seeds: list[list[float]], rounds: int = 50, tol: float = 1e-6) -> tuple[list[np.ndarray], int]:
    """The centroids of series (column v), and the rounds that it took.  The series are made once, all rounds read them."""
    series = cut(series.select("v"))
    centroids = [np.array(s, float) for s in seeds]
    for number in range(rounds):
        now = [c.copy() for c in centroids]

        def sums(batches, now=now):
            total = [np.zeros((2, len(c))) for c in now]
            for b in batches:
                for _, x in _matrices(b["v"]):
                    at, _ = nearest(x, now)
                    for k in np.unique(at):
                        total[k] += barycentre_sums(x[at == k], now[k])
            yield pd.DataFrame([(k, j, t[0, j], t[1, j]) for k, t in enumerate(total) for j in range(t.shape[1]) if t[1, j]], columns=["k", "j", "s", "n"])

        moved = 0.0
        for r in series.mapInPandas(sums, "k int, j int, s double, n double").groupBy("k", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
            moved = max(moved, abs(r.s / r.n - centroids[r.k][r.j]))
            centroids[r.k][r.j] = r.s / r.n
        if moved <= tol:
            return centroids, number + 1
    return centroids, rounds


def assign(series: DataFrame, centroids: list[np.ndarray], key: list[str]) -> DataFrame:
    """``key``, the nearest centroid's number and the warped distance to it."""

    def run(batches):
        for b in batches:
            out = b[key].assign(cluster=pd.array([None] * len(b), "Int32"), d=np.nan)
            for rows, x in _matrices(b["v"]):
                at, cost = nearest(x, centroids)
                out.loc[b.index[rows], "cluster"] = at.astype(np.int32)
                out.loc[b.index[rows], "d"] = np.sqrt(cost)
            yield out.assign(d=out["d"].astype("Float64").mask(out["cluster"].isna()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in series.select(*key).schema.fields)
    return series.select(*key, "v").mapInPandas(run, f"{schema}, cluster int, d double")
