"""A linear autoencoder over sliding windows that are never written out.

Runs are cut into stretches: the rows in which a chunk's windows start, and the
``size - 1`` after them, so a row is sent once, or twice near a chunk's end.
The covariance of all windows is made of products of rows at each lag: the
sum over a stretch's windows at places (a, a + lag) is the running sum of the
products, less what lies before the first window's and after the last one's
place.  So a stretch costs rows x lags, not rows x lags x lags, and no task
holds more than a stretch.

``seq`` is a row's place in its run, without gaps.  Windows that hold a null or
non-finite signal are left out of the fit, and have null errors.  An empty
table, or one without a whole window, has no components to fit and raises
``ValueError``; its errors, with components from elsewhere, are no rows or null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import WINDOW
from .cluster import principal

#: Windows of a stretch.
CHUNK = 4096


def stretches(df: DataFrame, signals: list[str], size: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """run_id, part and v: the rows of part x chunk and after in which its windows lie, signals side by side."""
    first = F.greatest(F.floor((F.col("seq") - size + 1) / chunk), F.lit(0))
    spread = df.select("run_id", "seq", F.array(*[F.col(s).cast("double") for s in signals]).alias("x"), F.explode(F.sequence(first, F.floor(F.col("seq") / chunk))).alias("part"))
    rows = spread.groupBy("run_id", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "x"))).alias("r"))
    return rows.select("run_id", "part", F.flatten(F.transform("r", lambda r: r["x"])).alias("v"))


def _rows(v, signals: int) -> np.ndarray:
    return np.asarray(v, float).reshape(-1, signals)


def lag_sums(x: np.ndarray, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Windows of consecutive rows, their sums by place, and their sums of products by two places."""
    n, k = len(x) - size + 1, x.shape[1]
    total, products = np.zeros((size, k)), np.zeros((size, k, size, k))
    if n <= 0:
        return 0, total.ravel(), products.reshape(size * k, -1)

    def between(values: np.ndarray, places: int) -> np.ndarray:
        run = np.concatenate([np.zeros_like(values[:1]), np.cumsum(values, axis=0)])
        return run[n : n + places] - run[:places]

    total[:] = between(x, size)
    for lag in range(size):
        a = np.arange(size - lag)
        both = between(x[: len(x) - lag, :, None] * x[lag:, None, :], size - lag)
        products[a, :, a + lag, :] = both
        products[a + lag, :, a, :] = both.transpose(0, 2, 1)
    return n, total.ravel(), products.reshape(size * k, -1)


def window_moments(parts: DataFrame, signals: int, size: int = WINDOW) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance (n - 1) of all windows; the sums that come to the driver depend on the width alone."""
    width = size * signals

    def run(batches):
        n, s, ss = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            for v in b["v"]:
                x = _rows(v, signals)
                bad = np.flatnonzero(~np.isfinite(x).all(axis=1))
                for piece in np.split(x, bad):
                    # After the first cut a piece begins with the row that isn't finite.
                    one = lag_sums(piece[1:] if len(piece) and not np.isfinite(piece[0]).all() else piece, size)
                    n, s, ss = n + one[0], s + one[1], ss + one[2]
        yield pd.DataFrame({"i": np.arange(width * width + width + 1), "v": np.concatenate([[n], s, ss.ravel()])})

    r = parts.select("v").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas().v.to_numpy()
    n = int(r[0]) if len(r) else 0
    if not n:
        raise ValueError("no window to fit on")
    mean, ss = r[1 : width + 1] / n, r[width + 1 :].reshape(width, width)
    return n, mean, (ss - n * np.outer(mean, mean)) / max(n - 1, 1)


def fit(parts: DataFrame, signals: int, size: int = WINDOW, components: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Mean and components of all windows."""
    n, mean, cov = window_moments(parts, signals, size)
    top, _ = principal(n, cov, share=1.0, least=components, most=components)
    return mean, top


def _windows(x: np.ndarray, size: int) -> np.ndarray:
    """All windows of consecutive rows, signals side by side in time."""
    if len(x) < size:
        return np.zeros((0, size * x.shape[1]))
    return np.lib.stride_tricks.sliding_window_view(x, size, axis=0).transpose(0, 2, 1).reshape(len(x) - size + 1, -1)


def _given_back(w: np.ndarray, mean: np.ndarray, top: np.ndarray, signals: int) -> np.ndarray:
    x = w - mean
    return np.abs(x - x @ top @ top.T).reshape(len(w), len(mean) // signals, signals)


def _listed(e: np.ndarray) -> list:
    return [row.tolist() if ok else None for row, ok in zip(e, np.isfinite(e).all(axis=1), strict=True)]


def _errors(parts: DataFrame, one) -> DataFrame:
    kind = parts.schema["run_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for run_id, part, v in zip(b["run_id"], b["part"], b["v"], strict=True):
                seq, error = one(int(part), v)
                yield pd.DataFrame({"run_id": pd.Series([run_id] * len(seq), dtype=b["run_id"].dtype), "seq": seq, "error": pd.Series(error, dtype=object)})

    return parts.select("run_id", "part", "v").mapInPandas(run, f"run_id {kind}, seq long, error array<double>")


def window_errors(parts: DataFrame, mean: np.ndarray, top: np.ndarray, signals: int, size: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """run_id, seq of the first row and error: the mean absolute reconstruction error of each signal over each window."""

    def one(part, v):
        e = _given_back(_windows(_rows(v, signals), size), mean, top, signals).mean(axis=1)
        return part * chunk + np.arange(len(e)), _listed(e)

    return _errors(parts, one)


def point_errors(parts: DataFrame, mean: np.ndarray, top: np.ndarray, signals: int, size: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """run_id, seq and error of every row: that of the window in whose middle it lies, null where none does."""
    half = size // 2

    def one(part, v):
        x = _rows(v, signals)
        e = _listed(_given_back(_windows(x, size), mean, top, signals)[:, half])
        # A row belongs to the stretch in which its window starts, the first rows of a run to its first one.
        first, end = 0 if part == 0 else half, min(len(x), chunk + half)
        seq = np.arange(first, end)
        return part * chunk + seq, [e[i - half] if half <= i < half + len(e) else None for i in seq]

    return _errors(parts, one)
