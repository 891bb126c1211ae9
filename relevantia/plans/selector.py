"""HSIC-Lasso selection over one table, step by step or in one call."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lasso
from ..operators.info import knn_mi, preselect
from ..operators.sampling import kind_of


class Selector:
    """Selects features of df for target columns. Sizes (batch, minibatch, epochs) and the seed of batches go to each call.

    Kernels follow column types: delta for discrete, RBF for continuous columns, so mixed
    tables need no index of where one kind ends. The table is never changed.
    """

    def __init__(self, df: DataFrame, target: list[str] | str, id_col: str, features: list[str] | None = None):
        self.df, self.id_col = df, id_col
        self.target = [target] if isinstance(target, str) else list(target)
        self.features = features or [c for c, t in df.dtypes if c != id_col and c not in self.target and kind_of(t) != "ignored"]
        self._runs: DataFrame | None = None

    def projection_matrix(self, number: int, **sizes) -> DataFrame:
        """(rank, feature, weight): the share of batches in which a feature entered as the rank-th."""
        if self._runs is not None:
            self._runs.unpersist()
        # Kept, for matrix and path come from the same solves; steps x d rows a batch.
        self._runs = lasso.run_batches(self.df, self.features, self.target, self.id_col, number, **sizes).persist()
        return lasso.projection_matrix(self._runs)

    def select(self, number: int, **sizes) -> list[str]:
        """The ``number`` features with most votes."""
        return lasso.select_k(self.projection_matrix(number, **sizes), self.features, number)

    def lasso_path(self) -> DataFrame:
        """(step, feature, beta) of the last selection, averaged over batches."""
        if self._runs is None:
            raise RuntimeError("nothing has been selected yet")
        return lasso.mean_path(self._runs)

    def regularization_curve(self, **sizes) -> DataFrame:
        """(rank, feature, beta, curve) of a selection of all features but one."""
        self.projection_matrix(max(1, len(self.features) - 1), **sizes)
        return lasso.regularization_curve(self.lasso_path())

    def autoselect(self, threshold: float = 0.01, path: DataFrame | None = None, **sizes) -> list[str]:
        """The features whose coefficient at the end of the path is above threshold times the largest."""
        if path is None:
            self.projection_matrix(max(1, len(self.features) - 1), **sizes)
            path = self.lasso_path()
        return [r["feature"] for r in lasso.select_from_path(path, threshold).orderBy("rank").collect()]


@dataclass
class Selection:
    """What select() found; names in the order of their scores."""

    preselection: list[str]
    mis: dict[str, float]
    hsic_selection: list[str]
    mi_ordered_features: list[str]
    hsic_ordered_features: list[str]
    regcurve: list[float]
    features: list[str] = field(default_factory=list)
    lasso_path: DataFrame | None = None

    def select_from_lasso_path(self, threshold: float = 0.01) -> list[str]:
        return [r["feature"] for r in lasso.select_from_path(self.lasso_path, threshold).orderBy("rank").collect()]


def mi_scores(df: DataFrame, features: list[str], target: list[str], threshold: float) -> dict[str, tuple[float, bool]]:
    """Of each feature its total share of MI over targets, and whether any share is above the threshold."""
    scores = None
    for t in target:
        one = knn_mi(df, features, t, kind_of(dict(df.dtypes)[t]) == "discrete").withColumn("target", F.lit(t))
        scores = one if scores is None else scores.unionByName(one)
    return {r["feature"]: (r["total"], r["kept"]) for r in preselect(scores, threshold).collect()}


def select(df: DataFrame, target: list[str] | str, id_col: str, features: list[str] | None = None, mi_threshold: float = 1e-5, hsic_threshold: float = 0.01, use_preselection: bool = False, batch: int = 9000, minibatch: int = 800, epochs: int = 3, seed: int = 0) -> Selection:
    """Preselection by neighbour MI where asked for, HSIC-Lasso, then the orders and the curve of its path."""
    own = Selector(df, target, id_col, features)
    mis = dict.fromkeys(own.features, 0.0)
    kept = list(own.features)
    if use_preselection:
        found = mi_scores(df, own.features, own.target, mi_threshold)
        mis, kept = {f: found[f][0] for f in own.features}, [f for f in own.features if found[f][1]]
    if not kept:
        return Selection([], mis, [], sorted(mis, key=lambda f: -mis[f]), [], [])
    own = Selector(df, target, id_col, kept)
    curve = own.regularization_curve(batch=batch, minibatch=minibatch, epochs=epochs, seed=seed).orderBy("rank").collect()
    path = own.lasso_path()
    chosen = own.autoselect(hsic_threshold, path)
    return Selection(kept, mis, chosen, sorted(mis, key=lambda f: -mis[f]), [r["feature"] for r in curve][: max(1, len(kept) - 1)], [r["curve"] for r in curve], chosen, path)
