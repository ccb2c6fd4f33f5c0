"""Signal features of windows (rows with an array of values)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import SAMPLE_HZ

TIME = ["min", "max", "mean", "std", "var", "skew", "kurt", "energy", "rms", "zcr", "ptp"]
FFT = ["centroid", "rolloff", "spread", "flux", "dominant", "energy", "entropy"]
SCALES = np.arange(1, 32)


def _sum(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(F.transform(a, lambda x: f(x).cast("double")), F.lit(0.0), lambda s, x: s + x)


def time_features(a: Column) -> Column:
    """Eleven features in time, with population moments; skew and kurtosis of a flat signal are 0."""
    n = F.size(a)
    m = _sum(a) / n
    moment = lambda k: F.element_at(F.transform(F.array(m), lambda c: _sum(a, lambda x: F.pow(x - c, F.lit(k))) / n), 1)
    var, e = moment(2), _sum(a, lambda x: x * x)
    std = F.sqrt(var)
    steps = F.aggregate(F.zip_with(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, F.size(a) - 1), lambda x, y: (F.signum(x) != F.signum(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    flat = std <= 1e-8
    values = [F.array_min(a), F.array_max(a), m, std, var, F.when(flat, 0.0).otherwise(moment(3) / F.pow(std, F.lit(3))), F.when(flat, 0.0).otherwise(moment(4) / F.pow(std, F.lit(4))), e, F.sqrt(e / n), steps / n, F.array_max(a) - F.array_min(a)]
    return F.struct(*[v.cast("double").alias(k) for k, v in zip(TIME, values, strict=True)])


def shape_features(a: Column, tiny: float = 1e-8) -> Column:
    """Min, max, mean, rms, variance (n - 1), skew and kurtosis by the sample deviation, shape, crest, energy, entropy."""
    n = F.size(a)
    m = _sum(a) / n
    central = lambda k: F.element_at(F.transform(F.array(m), lambda c: _sum(a, lambda x: F.pow(x - c, F.lit(k)))), 1)
    e = _sum(a, lambda x: x * x)
    var = central(2) / (n - 1)
    std, rms, top = F.sqrt(var) + tiny, F.sqrt(e / n), F.array_max(a)
    share = F.element_at(F.transform(F.array(e), lambda t: -_sum(a, lambda x: (x * x / t) * F.log2(x * x / t + tiny))), 1)
    values = [F.array_min(a), top, m, rms, var, central(3) / n / F.pow(std, F.lit(3)), central(4) / n / F.pow(std, F.lit(4)), F.sqrt(_sum(a)) / (_sum(a, F.abs) / n), top / rms, e, share]
    names = ["min", "max", "mean", "rms", "var", "skew", "kurt", "shape", "crest", "energy", "entropy"]
    clean = lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    return F.struct(*[clean(v.cast("double")).alias(k) for k, v in zip(names, values, strict=True)])


def _stacked(values: pd.Series):
    """Rows grouped by length, as matrices."""
    size = values.map(len)
    for n in size.unique():
        at = np.flatnonzero(size == n)
        yield at, np.stack(values.iloc[at].to_list()).astype(float) if n else np.zeros((len(at), 0))


def spectrum_features(x: np.ndarray, fs: float = SAMPLE_HZ) -> np.ndarray:
    """Seven features of the first half of the spectrum, for each row."""
    n = x.shape[1]
    out = np.zeros((len(x), 7))
    if n < 2:
        return out
    mag = np.abs(np.fft.fft(x, axis=1))[:, : n // 2]
    freq = np.arange(n // 2) * fs / n
    total = mag.sum(axis=1)
    ok = total > 0
    safe = np.where(ok, total, 1)[:, None]
    centroid = (mag * freq).sum(axis=1) / safe[:, 0]
    run = np.cumsum(mag, axis=1)
    share = mag / safe
    out[:, 0] = centroid
    out[:, 1] = freq[np.argmax(run >= 0.95 * run[:, -1:], axis=1)]
    out[:, 2] = np.sqrt(((freq - centroid[:, None]) ** 2 * mag).sum(axis=1) / safe[:, 0])
    out[:, 3] = (np.diff(mag, axis=1) ** 2).sum(axis=1)
    out[:, 4] = freq[np.argmax(mag, axis=1)]
    out[:, 5] = (mag**2).sum(axis=1)
    out[:, 6] = -(share * np.log2(share + 1e-12)).sum(axis=1)
    out[~ok] = 0
    return out


def _by_length(f, width: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(values: pd.Series) -> pd.Series:
        out = np.zeros((len(values), width))
        for at, x in _stacked(values):
            out[at] = f(np.nan_to_num(x))
        return pd.Series(list(out))

    return run


fft_features = _by_length(spectrum_features, 7)


def _by_size(f):
    """As ``_by_length``, for results as long as the signal's length makes them."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(values: pd.Series) -> pd.Series:
        out = np.empty(len(values), object)
        for at, x in _stacked(values):
            for k, y in zip(at, f(np.nan_to_num(x)), strict=True):
                out[k] = y
        return pd.Series(out)

    return run


def _morlet(points: int = 1024) -> np.ndarray:
    """The running integral of the real Morlet wavelet on [-8, 8]."""
    t = np.linspace(-8, 8, points)
    return np.cumsum(np.exp(-t * t / 2) * np.cos(5 * t)) * (t[1] - t[0])


def wavelet_features(x: np.ndarray, scales: np.ndarray = SCALES, step: float = 1 / SAMPLE_HZ) -> np.ndarray:
    """39 features of the continuous Morlet transform: energies of 31 scales, and eight of their distribution."""
    out = np.zeros((len(x), len(scales) + 8))
    n = x.shape[1]
    if n < 2:
        return out
    whole = _morlet()
    span = 16 / (len(whole) - 1)
    energy = np.zeros((len(x), len(scales)))
    for k, s in enumerate(scales):
        at = (np.arange(s * 16 + 1) / (s * span)).astype(int)
        kernel = whole[at[at < len(whole)]][::-1]
        size = n + len(kernel) - 1
        conv = np.fft.irfft(np.fft.rfft(x, size, axis=1) * np.fft.rfft(kernel, size), size, axis=1)
        coef = -np.sqrt(s) * np.diff(conv, axis=1)
        cut = (coef.shape[1] - n) / 2
        coef = coef[:, int(np.floor(cut)) : coef.shape[1] - int(np.ceil(cut))]
        energy[:, k] = (coef**2).sum(axis=1)
    total = energy.sum(axis=1)
    safe = np.where(total > 0, total, 1)
    freq = 0.8125 / scales / step  # the wavelet's centre frequency
    share = energy / safe[:, None]
    rest = [total, scales[energy.argmax(axis=1)], (energy * freq).sum(axis=1) / safe, -(share * np.log2(share + 1e-12)).sum(axis=1), *np.percentile(energy, [25, 50, 75], axis=1), (energy > energy.mean(axis=1, keepdims=True)).sum(axis=1)]
    out[:, : len(scales)] = energy
    out[:, len(scales) :] = np.stack(rest, axis=1)
    return out


morlet_features = _by_length(wavelet_features, 39)


def band_pass(x: np.ndarray, low: float, high: float, fs: float, order: int = 5) -> np.ndarray:
    """Butterworth band-pass of each row, by second-order sections from the bilinear transform."""
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    lo, hi = warp(low), warp(high)
    width, mid = hi - lo, lo * hi
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = proto * width / 2
    root = np.sqrt(half * half - mid)
    poles = np.concatenate([half + root, half - root])
    gain = np.real(width**order * (2 * fs) ** order / np.prod(2 * fs - poles))
    z = (2 * fs + poles) / (2 * fs - poles)
    upper = sorted((p for p in z if p.imag > 1e-14), key=lambda p: abs(p))
    real = sorted(p.real for p in z if abs(p.imag) <= 1e-14)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(real[i] + real[i + 1]), real[i] * real[i + 1]) for i in range(0, len(real) - 1, 2)]
    y = np.array(x, dtype=float) * gain
    for a1, a2 in pairs:  # zeros at 1 and -1 in each section
        out = np.zeros_like(y)
        for t in range(y.shape[1]):
            out[:, t] = y[:, t] - (y[:, t - 2] if t > 1 else 0) - (a1 * out[:, t - 1] if t else 0) - (a2 * out[:, t - 2] if t > 1 else 0)
        y = out
    return y


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def band_passed(values: pd.Series, low: pd.Series, high: pd.Series, fs: pd.Series) -> pd.Series:
    """Windows filtered to a band, whose bounds and sampling rate are the same in all rows."""
    out = np.empty(len(values), object)
    for at, x in _stacked(values):
        for k, y in zip(at, band_pass(x, float(low.iloc[0]), float(high.iloc[0]), float(fs.iloc[0])), strict=True):
            out[k] = y
    return pd.Series(out)


def warped(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared warping cost of each row of ``x`` with the same row of ``y``, all rows at once along anti-diagonals."""
    n, m = x.shape[1], y.shape[1]
    rows = np.full((3, len(x), n + 1), np.inf)  # the diagonals i + j = s, s - 1 and s - 2, by i
    rows[1, :, 0] = 0
    for s in range(2, n + m + 1):
        lo, hi = max(1, s - m), min(n, s - 1)
        rows[2, :] = np.inf
        i = np.arange(lo, hi + 1)
        best = np.minimum(np.minimum(rows[0][:, i - 1], rows[0][:, i]), rows[1][:, i - 1])
        rows[2][:, i] = best + (x[:, i - 1] - y[:, s - i - 1]) ** 2
        rows = rows[[2, 0, 1]]
    return rows[0][:, n]


@F.pandas_udf(T.DoubleType())
def dtw_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Dynamic time warping distance of two series: root of the least sum of squared differences; null without values."""
    out = np.full(len(a), np.nan)
    sizes = [(len(x), len(y)) if x is not None and y is not None else (0, 0) for x, y in zip(a, b, strict=True)]
    for n, m in sorted({s for s in sizes if s[0] and s[1]}):
        at = [k for k, s in enumerate(sizes) if s == (n, m)]
        out[at] = np.sqrt(warped(np.stack([a.iloc[k] for k in at]).astype(float), np.stack([b.iloc[k] for k in at]).astype(float)))
    return pd.Series(out).astype("Float64").mask(np.isnan(out))


def seven_features(a: Column) -> Column:
    """Min, max, mean, rms, variance, skew, kurtosis in the first of eleven places; the others stay 0."""
    s = shape_features(a)
    return F.array(*[s[c] for c in ("min", "max", "mean", "rms", "var", "skew", "kurt")], *[F.lit(0.0)] * 4)


spectrum = _by_size(lambda x: np.abs(np.fft.rfft(x, axis=1)))


def cleaned(v: Column, top: float = 0.0) -> Column:
    """NaN and null become 0, infinities ``top`` and -``top``."""
    return F.when(v.isNull() | F.isnan(v), 0.0).when(v == float("inf"), top).when(v == float("-inf"), -top).otherwise(v)


def combined_features(a: Column) -> Column:
    """57 features of a signal: 11 in time, 7 of the spectrum, 39 of the wavelet transform; gaps count as 0, a signal without values gives zeros."""
    whole = F.transform(a, cleaned)
    t = time_features(whole)
    every = F.concat(F.array(*[t[c] for c in TIME]), fft_features(whole), morlet_features(whole))
    some = F.exists(a, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.transform(F.when(some, every).otherwise(F.array_repeat(F.lit(0.0), 57)), lambda x: cleaned(x, 1e6))


def squeezed(x: np.ndarray, fs: float = SAMPLE_HZ, voices: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude of the synchrosqueezed Morlet transform of one signal, and its frequencies.

    Each coefficient moves to the frequency that the change of its phase
    shows, so that a tone gathers in one row.
    """
    n = len(x)
    freq = np.fft.fftfreq(n, 1 / fs)
    octaves = max(1, int(np.log2(max(n, 4))) - 1)
    centre = fs / 2 * 2.0 ** (-np.arange(octaves * voices) / voices)
    window = np.exp(-0.5 * (6 * freq[None, :] / centre[:, None] - 6) ** 2) * (freq > 0)
    spectrum_ = np.fft.fft(x)[None, :] * window
    w, dw = np.fft.ifft(spectrum_, axis=1), np.fft.ifft(2j * np.pi * freq * spectrum_, axis=1)
    ok = np.abs(w) > 1e-8 * max(np.abs(w).max(), 1e-300)
    shown = np.abs(np.imag(dw / np.where(ok, w, 1))) / (2 * np.pi)
    row = np.rint(-np.log2(np.maximum(shown, 1e-12) / (fs / 2)) * voices).astype(int)
    ok &= (row >= 0) & (row < len(centre))
    out = np.zeros(w.shape, complex)
    at, t = np.nonzero(ok)
    np.add.at(out, (row[at, t], t), w[at, t])
    return np.abs(out), centre


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def squeezed_energy(values: pd.Series) -> pd.Series:
    """Mean magnitude of each row of the squeezed spectrogram, highest frequency first; null for fewer than ten values or none but 0."""
    return pd.Series([squeezed(np.asarray(v, float))[0].mean(axis=1) if v is not None and len(v) >= 10 and np.any(v) else None for v in values])
