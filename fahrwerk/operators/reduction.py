"""Feature reduction by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import anova_scores, mutual_information, pca, project


def pick(indices: list[int], vector: str = "v") -> Column:
    return F.array(*[F.col(vector)[i] for i in indices])


class Reducer:
    """A fitted reduction; ``apply`` adds column z to other data."""

    def __init__(self, indices: list[int] | None, mean=None, top=None):
        self.indices, self.mean, self.top = indices, mean, top

    def apply(self, df: DataFrame, vector: str = "v") -> DataFrame:
        if self.indices is not None:
            df = df.withColumn("z", pick(self.indices, vector))
            vector = "z"
        return df if self.top is None else project(df, vector, self.mean, self.top)


def _best(df: DataFrame, label: str, vector: str, k: int) -> list[int]:
    """The k components with the highest F scores: one small row each."""
    return [r.i for r in anova_scores(df, label, vector).orderBy(F.desc_nulls_last("f"), "i").limit(k).collect()]


def fit_reducer(df: DataFrame, strategy: str, width: int, label: str | None = None, vector: str = "v", k: int = 50, select: int = 200) -> Reducer:
    if strategy in ("pca", "incremental_pca"):  # sums make both the same
        mean, top, _ = pca(df, vector, width)
        return Reducer(None, mean, top)
    if strategy == "anova":
        return Reducer(_best(df, label, vector, min(k, width)))
    if strategy == "mutual_information":
        return Reducer([r.i for r in mutual_information(df, label, vector).orderBy(F.desc("mi"), "i").limit(min(k, width)).collect()])
    if strategy == "hybrid":
        chosen = _best(df, label, vector, min(select, width))
        mean, top, _ = pca(df.withColumn("z", pick(chosen, vector)), "z", len(chosen), share=1.0, least=min(k, len(chosen)), most=k)
        return Reducer(chosen, mean, top)
    if strategy == "none":
        return Reducer(list(range(width)))
    if strategy == "umap":
        raise RuntimeError("umap is not available")
    raise ValueError(f"unknown reduction: {strategy}")
