"""HSIC-Lasso: non-negative least angles on (M, g), and what is made of its paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .hsic import DELTA, RBF, hsic_statistics
from .sampling import kind_of, standardise

TINY = 1e-12


def nlars(m: np.ndarray, g: np.ndarray, most: int) -> tuple[list[int], np.ndarray]:
    """Active features in order of entry, and the coefficients after each step (steps x d), from M = X'X and g = X'y.

    At most ``most`` features. No step at all gives one row of zeros.
    """
    d = len(g)
    beta, c = np.zeros(d), g.astype(float).copy()
    idle, path = list(range(d)), []
    if not d or c.max() <= TINY:
        return [], np.zeros((1, d))
    first = idle[int(np.argmax(c[idle]))]
    active = [first]
    idle.remove(first)
    while c[active].mean() >= TINY and len(active) <= most:
        w = np.linalg.lstsq(m[np.ix_(active, active)], np.ones(len(active)), rcond=None)[0]
        gw = m[:, active] @ w
        lead = active[0]
        slope = gw[lead] - gw[idle]
        if (slope == 0).any():
            break
        steps = np.concatenate([(c[lead] - c[idle]) / slope, -beta[active] / w, [c[lead] / gw[lead]]])
        steps[~(steps > TINY)] = np.inf
        at = int(np.argmin(steps))
        if not np.isfinite(steps[at]):
            break
        leaves = len(idle) <= at < len(idle) + len(active)
        beta[active] += steps[at] * w
        gone = active[at - len(idle)] if leaves else None
        if leaves:
            beta[gone] = 0.0
        c = g - m @ beta
        path.append(beta.copy())
        if leaves:
            active.remove(gone)
            idle.append(gone)
            if not active:
                break
            continue
        if not idle:
            break
        enters = idle[int(np.argmax(c[idle]))]
        active.append(enters)
        idle.remove(enters)
    if len(active) > most:
        active = active[:most]
    return active, np.array(path) if path else np.zeros((1, d))


def kernels_of(df: DataFrame, features: list[str], target: list[str]) -> tuple[dict[str, str], str]:
    """RBF for continuous columns, delta for discrete; a target of several columns is delta if all are discrete."""
    kinds = {c: kind_of(t) for c, t in df.dtypes}
    delta = lambda c: kinds[c] == "discrete"
    return {f: DELTA if delta(f) else RBF for f in features}, DELTA if all(map(delta, target)) else RBF


def solve(stats: DataFrame, features: list[str], most: int) -> DataFrame:
    """(batch, step, feature, beta, rank) from hsic_statistics(): each batch is a task's group of d(d+3)/2 sums, solved where it lies.

    ``rank`` is a feature's place in the order of entry, null if it is not active at the end.
    """
    ship(stats.sparkSession)
    d = len(features)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m, g = np.zeros((d, d)), np.zeros(d)
        a, b, v = (pdf[c].to_numpy() for c in "abv")
        g[a[b < 0]] = v[b < 0]
        m[a[b >= 0], b[b >= 0]] = v[b >= 0]
        m = np.triu(m) + np.triu(m, 1).T
        active, path = nlars(m, g, most)
        rank = pd.array([active.index(i) if i in active else None for i in range(d)], "Int32")
        n = len(path)
        return pd.DataFrame({"batch": pdf["batch"].iloc[0], "step": np.repeat(np.arange(n), d), "feature": features * n, "beta": path.ravel(), "rank": pd.concat([pd.Series(rank)] * n, ignore_index=True)})

    return stats.groupBy("batch").applyInPandas(one, "batch long, step int, feature string, beta double, rank int")


def run_batches(df: DataFrame, features: list[str], target: list[str], id_col: str, most: int, batch: int = 1000, minibatch: int = 200, epochs: int = 1, seed: int = 0) -> DataFrame:
    """solve() of each batch of df; nothing but what is asked of the result reaches the driver. Null features or targets are refused."""
    nulls = df.select(F.count(F.when(F.greatest(*[F.col(c).isNull() for c in [*features, *target]], F.lit(False)), 1)).alias("n")).first()["n"]
    if nulls:
        raise ValueError(f"{nulls} rows have null features or targets")
    kernels, y_kernel = kernels_of(df, features, target)
    scaled = [f for f in features if kernels[f] == RBF] + ([t for t in target] if y_kernel == RBF else [])
    ready = standardise(df, scaled) if scaled else df
    return solve(hsic_statistics(ready, features, target, kernels, y_kernel, id_col, batch, minibatch, epochs, seed), features, most)


def entries(runs: DataFrame) -> DataFrame:
    """(batch, rank, feature) of the active features of run_batches()."""
    return runs.where("step = 0 AND rank IS NOT NULL").select("batch", "rank", "feature")


def mean_path(paths: DataFrame) -> DataFrame:
    """(step, feature, beta): batches' paths, each lengthened by its last row to the longest, averaged."""
    last = paths.groupBy("batch").agg(F.max("step").alias("last"))
    most = paths.agg(F.max("step").alias("most"))  # one row
    ends = paths.join(last, "batch").where("step = last").crossJoin(F.broadcast(most)).where("last < most")
    more = ends.select("batch", F.explode(F.sequence(F.col("last") + 1, F.col("most"))).alias("step"), "feature", "beta")
    return paths.select("batch", "step", "feature", "beta").unionByName(more).groupBy("step", "feature").agg(F.avg("beta").alias("beta"))


def projection_matrix(runs: DataFrame) -> DataFrame:
    """(rank, feature, weight): the share of batches in which a feature was the rank-th to enter."""
    n = runs.agg(F.greatest(F.lit(1), F.count_distinct("batch")).alias("n"))  # one row
    votes = entries(runs).groupBy("rank", "feature").agg(F.count("*").alias("votes"))
    return votes.crossJoin(F.broadcast(n)).select("rank", "feature", (F.col("votes") / F.col("n")).alias("weight"))


def select_k(matrix: DataFrame, features: list[str], k: int) -> list[str]:
    """The k features with most votes; ties, and features without votes, by descending position."""
    votes = {r["feature"]: r["v"] for r in matrix.groupBy("feature").agg(F.sum("weight").alias("v")).collect()}
    order = sorted(range(len(features)), key=lambda i: (-votes.get(features[i], 0.0), -i))
    return [features[i] for i in order[:k]]


def regularization_curve(path: DataFrame) -> DataFrame:
    """(rank, feature, beta, curve) of a path's last step: coefficients from the largest, and their running sum."""
    last = path.withColumn("end", F.max("step").over(Window.partitionBy())).where("step = end")
    order = Window.orderBy(F.desc("beta"), "feature")
    return last.select(F.row_number().over(order).alias("rank"), "feature", "beta", F.sum("beta").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("curve"))


def select_from_path(path: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(rank, feature, beta): the features whose last coefficient is above threshold times the largest."""
    curve = regularization_curve(path).withColumn("top", F.max("beta").over(Window.partitionBy()))
    return curve.where((F.col("top") > 0) & (F.col("beta") / F.col("top") > threshold)).select("rank", "feature", "beta")


def rank_features(df: DataFrame, features: list[str], target: list[str], id_col: str, most: int | None = None, threshold: float = 0.01, **sizes) -> DataFrame:
    """(rank, feature, beta) that autoselection keeps. A single feature is kept if it depends on the target at all."""
    return select_from_path(mean_path(run_batches(df, features, target, id_col, most or max(1, len(features) - 1), **sizes)), threshold)
