"""Permutation search: prefixes of sampled orders that maximise a metric."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .hsic import DELTA, RBF, hsic_b_sets
from .info import adjusted_mi, label_pairs


def haar_permutations(d: int, size: int, seed: int) -> list[tuple[int, ...]]:
    """Up to 2(d-1)*size distinct permutations: orders of points that Haar rotations spread over the sphere of zero sums."""
    if d <= 2:
        return sorted(itertools.permutations(range(d)))
    basis = np.zeros((d - 1, d))
    for k in range(1, d):
        basis[k - 1, :k], basis[k - 1, k] = 1.0, -float(k)
        basis[k - 1] /= np.linalg.norm(basis[k - 1])
    rng, found = np.random.default_rng(seed), set()
    for _ in range(size):
        q, r = np.linalg.qr(rng.standard_normal((d - 1, d - 1)))
        q *= np.sign(np.diag(r))
        if np.linalg.det(q) < 0:
            q[:, 0] *= -1
        for points in (q.T, -q.T):
            found.update(tuple(map(int, np.argsort(p, kind="stable"))) for p in points @ basis)
    return sorted(found)


def ami_metric(df: DataFrame, target: str, weight: str | None = None) -> Callable[[list[tuple[str, ...]]], dict]:
    """Adjusted MI of many tuples of features with the target, in one plan; class sizes alone reach the formula. Weights as in label_pairs()."""

    def score(sets: list[tuple[str, ...]]) -> dict:
        names = {str(i): list(s) for i, s in enumerate(sets)}
        return {tuple(sorted(names[r["feature"]])): r["ami"] for r in adjusted_mi(label_pairs(df, names, target, weight)).collect()}

    return score


def hsic_metric(df: DataFrame, target: list[str], id_col: str, kernel: str = RBF, y_kernel: str = DELTA, block: int = 1000) -> Callable:
    """Biased HSIC of many tuples of features with the target, in one plan."""

    def score(sets: list[tuple[str, ...]]) -> dict:
        found = hsic_b_sets(df, sets, target, id_col, kernel, y_kernel, block).collect()
        return {tuple(sorted(sets[r["set"]])): r["hsic"] for r in found}

    return score


def search(features: list[str], metric: Callable, permutations: int = 1, im_ratio: float = 0.05, max_iter: int = 1, seed: int = 0, add_back: bool = True, leave: int = 0) -> list[str]:
    """Features whose prefixes score best, round by round, until a round is below im_ratio times the best or ``leave`` are left.

    A prefix' score does not depend on its order, so equal sets are scored once. With
    add_back, features that score above the same bound alone are added. If nothing scores
    above 0 nothing is selected.
    """
    active, chosen, overall = list(features), [], 0.0
    for _ in range(max_iter):
        if len(active) <= leave:
            break
        n = len(active)
        size = min(max(1, permutations // n), max(1, 2 ** min(n, 60) // n))
        orders = haar_permutations(n, size, seed)
        prefixes = {tuple(sorted(active[i] for i in p[:k])) for p in orders for k in range(1, n + 1)}
        scores = metric(sorted(prefixes))
        best, value = None, 0.0
        for p in orders:
            for k in range(1, n + 1):
                s = scores.get(tuple(sorted(active[i] for i in p[:k])), 0.0)
                if s > value:
                    best, value = [active[i] for i in p[:k]], s
        if best is None or value < im_ratio * overall:
            break
        overall = max(overall, value)
        chosen += best
        active = [f for f in active if f not in best]
    if add_back and chosen:
        alone = metric([(f,) for f in features])
        chosen += [f for f in features if f not in chosen and alone.get((f,), 0.0) > im_ratio * overall]
    return chosen
