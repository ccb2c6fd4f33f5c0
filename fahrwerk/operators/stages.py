"""Feature preparation and clustering as pyspark.ml stages: fitted on training rows, applied to others, saved and loaded.

Vectors and series are columns of array<double>.  What a model learns (means,
components, centroids) is as large as a vector's width or the number of
clusters, and is kept in its params, so that ``save`` writes it as JSON.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from . import features, warping
from .cluster import moments
from .lineage import cut
from .reduction import fit_reducer

#: Features of a window by domain.
DOMAINS = {"time": lambda v: F.slice(features.seven_features(v), 1, 7), "frequency": features.fft_features, "combined": features.combined_features}


class _Saved(DefaultParamsReadable, DefaultParamsWritable):
    pass


def _mapped(df: DataFrame, source: str, name: str, run) -> DataFrame:
    """``df`` with an array column ``name`` (one that bears it goes): ``run`` of the values of ``source``, a pandas series, gives a list."""

    def batches_(batches):
        for b in batches:
            out = run(b.column(b.schema.get_field_index(source)).to_pandas())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if v is None else np.asarray(v, float) for v in out], pa.list_(pa.float64()))], [*b.schema.names, name])

    kept = df.drop(name) if name != source else df
    return kept.mapInArrow(batches_, StructType([*kept.schema.fields, StructField(name, ArrayType(DoubleType()))]))


def _width(df: DataFrame, column: str) -> int:
    return df.agg(F.max(F.size(column))).first()[0] or 0


class WindowFeatures(Transformer, HasInputCol, HasOutputCol, _Saved):
    """Features of a window's values, in one of the domains."""

    domain = Param(Params._dummy(), "domain", "time, frequency or combined", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol="v", outputCol="features", domain="time"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._set(inputCol=self._input_kwargs.get("inputCol", inputCol), outputCol=self._input_kwargs.get("outputCol", outputCol), domain=self._input_kwargs.get("domain", domain))

    def _transform(self, df):
        v = F.col(self.getInputCol())
        return df.withColumn(self.getOutputCol(), F.when(v.isNotNull(), DOMAINS[self.getOrDefault("domain")](v)))


class WarpedDistances(Transformer, HasInputCol, HasOutputCol, _Saved):
    """Warping distances of a series to each of some given ones."""

    seeds = Param(Params._dummy(), "seeds", "series to which distances are taken", TypeConverters.identity)

    @keyword_only
    def __init__(self, *, inputCol="v", outputCol="distances", seeds=None):
        super().__init__()
        self._set(inputCol=self._input_kwargs.get("inputCol", inputCol), outputCol=self._input_kwargs.get("outputCol", outputCol), seeds=self._input_kwargs.get("seeds", seeds) or [])

    def _transform(self, df):
        seeds = [np.array(s, float) for s in self.getOrDefault("seeds")]

        def run(v: pd.Series) -> list:
            out = [None] * len(v)
            for rows, x in warping._matrices(v):
                found = np.sqrt(np.stack([warping.aligned(x, s, back=False)[0] for s in seeds], axis=1))
                for k, d in zip(rows.tolist(), found, strict=True):
                    out[k] = d
            return out

        return _mapped(df, self.getInputCol(), self.getOutputCol(), run)


class JoinedVectors(Transformer, HasInputCols, HasOutputCol, _Saved):
    """Several vectors one after the other."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="joined"):
        super().__init__()
        self._set(inputCols=self._input_kwargs.get("inputCols", inputCols) or [], outputCol=self._input_kwargs.get("outputCol", outputCol))

    def _transform(self, df):
        return df.withColumn(self.getOutputCol(), F.concat(*self.getInputCols()))


class Standardizer(Estimator, HasInputCol, HasOutputCol, _Saved):
    """Components less their mean, by their population deviation; constant ones become 0."""

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="scaled"):
        super().__init__()
        self._set(inputCol=self._input_kwargs.get("inputCol", inputCol), outputCol=self._input_kwargs.get("outputCol", outputCol))

    def _fit(self, df):
        n, mean, cov = moments(df.where(F.col(self.getInputCol()).isNotNull()), self.getInputCol(), _width(df, self.getInputCol()))
        scale = np.sqrt(np.clip(np.diag(cov), 0, None) * max(n - 1, 1) / max(n, 1))
        model = StandardizerModel()
        return model._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), mean=mean.tolist(), scale=np.where(scale > 0, scale, 1.0).tolist())


class StandardizerModel(Model, HasInputCol, HasOutputCol, _Saved):
    mean = Param(Params._dummy(), "mean", "means", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "deviations", TypeConverters.toListFloat)

    def _transform(self, df):
        v = F.col(self.getInputCol())
        pairs = zip(self.getOrDefault("mean"), self.getOrDefault("scale"), strict=True)
        return df.withColumn(self.getOutputCol(), F.when(v.isNotNull(), F.array(*[(v[i] - m) / s for i, (m, s) in enumerate(pairs)])))


class FeatureReducer(Estimator, HasInputCol, HasOutputCol, HasLabelCol, _Saved):
    """Fewer components, by one of ``reduction.fit_reducer``'s strategies."""

    strategy = Param(Params._dummy(), "strategy", "pca, anova, mutual_information, hybrid or none", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "components that are kept, by those that keep a number", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="scaled", outputCol="reduced", labelCol="label", strategy="pca", k=50):
        super().__init__()
        own = dict(inputCol=inputCol, outputCol=outputCol, labelCol=labelCol, strategy=strategy, k=k)
        self._set(**{n: self._input_kwargs.get(n, v) for n, v in own.items()})

    def _fit(self, df):
        name = self.getInputCol()
        known = df.where(F.col(name).isNotNull())
        got = fit_reducer(known, self.getOrDefault("strategy"), _width(df, name), self.getLabelCol(), name, self.getOrDefault("k"))
        model = FeatureReducerModel()
        return model._set(inputCol=name, outputCol=self.getOutputCol(), indices=got.indices, mean=None if got.mean is None else got.mean.tolist(), components=None if got.top is None else got.top.tolist())


class FeatureReducerModel(Model, HasInputCol, HasOutputCol, _Saved):
    indices = Param(Params._dummy(), "indices", "components that are picked, or None", TypeConverters.identity)
    mean = Param(Params._dummy(), "mean", "means of what is projected, or None", TypeConverters.identity)
    components = Param(Params._dummy(), "components", "principal components as columns, or None", TypeConverters.identity)

    def _transform(self, df):
        picked = self.getOrDefault("indices")
        mean, top = (None if v is None else np.array(v, float) for v in (self.getOrDefault(n) for n in ("mean", "components")))

        def run(v: pd.Series) -> list:
            out, known = [None] * len(v), np.flatnonzero(v.notna())
            if len(known):
                x = np.stack(v.iloc[known].to_list())
                x = x if picked is None else x[:, picked]
                for k, z in zip(known.tolist(), x if top is None else (x - mean) @ top, strict=True):
                    out[k] = z
            return out

        return _mapped(df, self.getInputCol(), self.getOutputCol(), run)


class SeededKMeans(Estimator, HasInputCol, HasOutputCol, _Saved):
    """Lloyd's rounds from given centroids until none moves by more than ``tol``; from sums that tasks send."""

    seeds = Param(Params._dummy(), "seeds", "centroids at the start", TypeConverters.identity)
    rounds = Param(Params._dummy(), "rounds", "most rounds", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "least move of a component", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol="reduced", outputCol="distances", seeds=None, rounds=100, tol=1e-9):
        super().__init__()
        own = dict(inputCol=inputCol, outputCol=outputCol, seeds=seeds or [], rounds=rounds, tol=tol)
        self._set(**{n: self._input_kwargs.get(n, v) for n, v in own.items()})

    def _fit(self, df):
        name, c = self.getInputCol(), np.array(self.getOrDefault("seeds"), float)
        # Made once: all rounds read them.
        points = cut(df.select(F.col(name).alias("v")))
        for _ in range(self.getOrDefault("rounds")):

            def sums(batches, c=c):
                total, n = np.zeros_like(c), np.zeros(len(c))
                for b in batches:
                    known = b["v"].dropna()
                    if len(known):
                        x = np.stack(known.to_list())
                        at = apart(x, c).argmin(axis=1)
                        np.add.at(total, at, x)
                        n += np.bincount(at, minlength=len(c))
                yield pd.DataFrame([(k, i, total[k, i], n[k]) for k in range(len(c)) if n[k] for i in range(c.shape[1])], columns=["k", "i", "s", "n"])

            new = c.copy()
            for r in points.mapInPandas(sums, "k int, i int, s double, n double").groupBy("k", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
                new[r.k, r.i] = r.s / r.n
            moved, c = float(np.abs(new - c).max(initial=0.0)), new
            if moved <= self.getOrDefault("tol"):
                break
        return SeededKMeansModel()._set(inputCol=name, outputCol=self.getOutputCol(), centroids=c.tolist())


def apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distance of each point to each centroid."""
    return np.sqrt(((x[:, None] - c) ** 2).sum(axis=2))


class SeededKMeansModel(Model, HasInputCol, HasOutputCol, _Saved):
    """Adds the distances to all centroids, and ``cluster``, the first of the nearest."""

    centroids = Param(Params._dummy(), "centroids", "centroids", TypeConverters.identity)

    def _transform(self, df):
        c = np.array(self.getOrDefault("centroids"), float)

        def run(v: pd.Series) -> list:
            return [None if x is None else apart(np.asarray(x)[None], c)[0] for x in v]

        out = _mapped(df, self.getInputCol(), self.getOutputCol(), run)
        d = F.col(self.getOutputCol())
        return out.withColumn("cluster", (F.array_position(d, F.array_min(d)) - 1).cast("int"))
