"""Reconstruction error of windows of signals: a principal-component autoencoder, and LSTM inference.

The linear autoencoder is fitted from sums (one pass, size fixed by the
window's width) and so trains on all windows at any scale.  Weights of a
trained LSTM autoencoder can be applied with ``lstm_reconstruct``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import WINDOW
from .cluster import pca
from .sequence import run_order


def frames(df: DataFrame, signals: list[str], size: int = WINDOW) -> DataFrame:
    """Windows that start at each row, signals side by side: run_id, seq, v."""
    w = run_order().rowsBetween(0, size - 1)
    rows = F.collect_list(F.array(*[F.col(s).cast("double") for s in signals])).over(w)
    return df.select("run_id", "seq", F.flatten(rows).alias("v"), F.size(rows).alias("n")).where(F.col("n") == size).drop("n")


def tumbling_frames(df: DataFrame, signals: list[str], size: int = WINDOW) -> DataFrame:
    """Windows one after the other, signals side by side: run_id, win, v; an unfinished last one is dropped."""
    rows = F.sort_array(F.collect_list(F.struct("seq", F.array(*[F.col(s).cast("double") for s in signals]).alias("x"))))
    w = df.groupBy("run_id", F.floor(F.col("seq") / size).alias("win")).agg(rows.alias("r")).where(F.size("r") == size)
    return w.select("run_id", "win", F.flatten(F.transform("r", lambda x: x["x"])).alias("v"))


def fit_linear(windows: DataFrame, width: int, parts: int = 8):
    """Mean and components of the windows that count as normal."""
    mean, top, _ = pca(windows, "v", width, share=1.0, least=parts, most=parts)
    return mean, top


def window_errors(windows: DataFrame, mean: np.ndarray, top: np.ndarray, signals: int) -> DataFrame:
    """Mean absolute reconstruction error of each signal over the window."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_list()) - mean
        e = np.abs(x - x @ top @ top.T)
        return pd.Series(list(e.reshape(len(x), -1, signals).mean(axis=1)))

    return windows.withColumn("error", run("v"))


def point_errors(df: DataFrame, windows: DataFrame, mean: np.ndarray, top: np.ndarray, signals: int, size: int = WINDOW) -> DataFrame:
    """The window's reconstruction error at its middle row; null for the rows that no window has in its middle."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_list()) - mean
        e = np.abs(x - x @ top @ top.T).reshape(len(x), -1, signals)
        return pd.Series(list(e[:, size // 2]))

    at = windows.select("run_id", (F.col("seq") + size // 2).alias("seq"), run("v").alias("error"))
    return df.join(at, ["run_id", "seq"], "left")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def lstm(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """All hidden states of one LSTM layer; gates in the order input, forget, cell, output."""
    n = w["hh"].shape[1]
    h, c, out = np.zeros((len(x), n)), np.zeros((len(x), n)), []
    for t in range(x.shape[1]):
        i, f, g, o = np.split(x[:, t] @ w["ih"].T + h @ w["hh"].T + w["b"], 4, axis=1)
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        h = _sigmoid(o) * np.tanh(c)
        out.append(h)
    return np.stack(out, axis=1)


def lstm_reconstruct(x: np.ndarray, layers: dict[str, list[dict]], out: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Encoder layers, the last state repeated, decoder layers, and a linear output."""
    h = x
    for w in layers["encoder"]:
        h = lstm(h, w)
    h = np.repeat(h[:, -1:], x.shape[1], axis=1)
    for w in layers["decoder"]:
        h = lstm(h, w)
    return h @ out[0].T + out[1]


def lstm_errors(windows: DataFrame, layers: dict[str, list[dict]], out: tuple[np.ndarray, np.ndarray], signals: int, middle: bool = False) -> DataFrame:
    """Mean absolute error of each signal of a window that a trained LSTM autoencoder gives back, or its error at the middle row.

    ``windows`` has column v, signals side by side in time.  The weights, as
    large as the model, go to every task; windows come in batches.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_list()).reshape(len(v), -1, signals)
        e = np.abs(x - lstm_reconstruct(x, layers, out))
        return pd.Series(list(e[:, e.shape[1] // 2] if middle else e.mean(axis=1)))

    return windows.withColumn("error", run("v"))
