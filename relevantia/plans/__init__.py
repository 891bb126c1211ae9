"""The one-call plan: select features from a table of mixed columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.info import distinct_counts
from ..operators.sampling import discretise, kind_of
from ..operators.search import ami_metric, search
from .selector import Selection, Selector, mi_scores, select

__all__ = ["FeatureSelection", "LassoParameters", "SearchParameters", "Selection", "Selector", "categorical_select", "mi_scores", "select", "select_features"]


@dataclass(frozen=True)
class LassoParameters:
    mi_threshold: float = 1e-5
    hsic_threshold: float = 0.0075
    batch: int = 9000
    minibatch: int = 500
    epochs: int = 4
    use_preselection: bool = True
    seed: int = 0


@dataclass(frozen=True)
class SearchParameters:
    permutations: int = 1
    im_ratio: float = 0.05
    max_iter: int = 2
    seed: int = 0


@dataclass
class FeatureSelection:
    continuous: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    mis: dict[str, float] = field(default_factory=dict)
    #: Columns of neither kind, which no operator can take.
    ignored: list[str] = field(default_factory=list)
    #: What the lasso found among the continuous columns: orders, curve and path.
    lasso: Selection | None = None

    @property
    def selected(self) -> list[str]:
        return self.categorical + self.continuous


def categorical_select(df: DataFrame, features: list[str], target: list[str], p: SearchParameters = SearchParameters()) -> list[str]:
    """The union over targets of the search by adjusted MI; continuous targets are discretised."""
    found: list[str] = []
    for t in target:
        own = df.withColumn("_y", discretise(df, t)) if kind_of(dict(df.dtypes)[t]) == "continuous" else df.withColumn("_y", F.col(t))
        own = distinct_counts(own, [*features, "_y"]).persist()
        picked = search(features, ami_metric(own, "_y", "_count"), p.permutations, p.im_ratio, p.max_iter, p.seed)
        own.unpersist()
        found += [f for f in picked if f not in found]
    return found


def select_features(df: DataFrame, target: list[str], id_col: str, lasso: LassoParameters = LassoParameters(), searching: SearchParameters = SearchParameters(), categorical: list[str] | None = None, drop_nulls: bool = False) -> FeatureSelection:
    """Continuous columns by HSIC-Lasso (after preselection by neighbour MI), discrete ones and those named ``categorical`` by the search.

    Columns of other types are ignored, and listed. Rows with nulls are refused, or left out with drop_nulls.
    """
    if drop_nulls:
        df = df.dropna()
    kinds = {c: kind_of(t) for c, t in df.dtypes if c != id_col and c not in target}
    known = set(categorical or ())
    if known - kinds.keys():
        raise ValueError(f"no such columns: {sorted(known - kinds.keys())}")
    # A named column is discrete whatever its type: texts and numbers are classes by value.
    kinds |= dict.fromkeys(known, "discrete")
    out = FeatureSelection(ignored=[c for c, k in kinds.items() if k == "ignored"])
    continuous = [c for c, k in kinds.items() if k == "continuous"]
    if continuous:
        out.lasso = select(df, target, id_col, continuous, lasso.mi_threshold, lasso.hsic_threshold, lasso.use_preselection, lasso.batch, lasso.minibatch, lasso.epochs, lasso.seed)
        out.mis, out.continuous = out.lasso.mis if lasso.use_preselection else {}, out.lasso.features
    discrete = [c for c, k in kinds.items() if k == "discrete"]
    if discrete:
        out.categorical = categorical_select(df, discrete, target, searching)
    return out
