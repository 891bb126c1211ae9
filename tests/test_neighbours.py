"""Estimators by neighbours against comparing all pairs of rows."""

import numpy as np
import pytest

from relevantia.operators import info, neighbours


def psi(n):
    return np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, int(np.max(n)) + 1))])[np.asarray(n) - 1] - 0.5772156649015329


def kraskov(x, y, k):
    n = len(x)
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    d = np.maximum(dx, dy) + np.diag(np.full(n, np.inf))
    r = np.sort(d, axis=1)[:, min(k, n - 1) - 1][:, None]
    nx, ny = np.maximum((dx < r).sum(1), 1), np.maximum((dy < r).sum(1), 1)
    return max(0.0, psi(n) + psi(min(k, n - 1)) - (psi(nx) + psi(ny)).mean())


def ross(x, y, k):
    terms = []
    for i in range(len(x)):
        dx = np.abs(x - x[i])
        others = np.sort(dx[(y == y[i]) & (np.arange(len(x)) != i)])
        if len(others):
            kk = min(k, len(others))
            terms.append(psi(kk) - psi(len(others) + 1) - psi(max(1, (dx <= others[kk - 1]).sum() - 1)))
    return max(0.0, psi(len(terms)) + np.mean(terms)) if terms else 0.0


def frame(spark, columns):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(columns))


@pytest.mark.parametrize("size", [16384, 100])
def test_strips_equal_all_pairs(spark, monkeypatch, size):
    """Ties, equal rows, a value that most rows have, outliers and a constant, in one strip and in many."""
    monkeypatch.setattr(neighbours, "STRIP", size)
    rng = np.random.default_rng(21)
    n = 240
    x = {"a": rng.normal(size=n), "b": rng.integers(0, 5, n) * 0.1, "c": np.where(rng.random(n) < 0.8, 0.3, rng.random(n)), "d": rng.standard_cauchy(n), "e": np.zeros(n)}
    for y in (x["a"] - x["b"], np.where(np.arange(n) < 180, 0.0, x["d"])):
        df = frame(spark, {**x, "y": y})
        got = {r["feature"]: r["mi"] for r in info.knn_mi(df, list(x), "y", False).collect()}
        assert got == pytest.approx({c: kraskov(v, y, 3) for c, v in x.items()}, abs=1e-10)
    for y in (rng.integers(0, 3, n), np.r_[np.arange(60), np.zeros(n - 62, int), 70, 70]):
        df = frame(spark, {**x, "y": y})
        got = {r["feature"]: r["mi"] for r in info.knn_mi(df, list(x), "y", True).collect()}
        assert got == pytest.approx({c: ross(v, y, 3) for c, v in x.items()}, abs=1e-10)


def test_few_rows_strings_and_nulls(spark):
    df = frame(spark, {"x": [0.5, 0.1, 0.4, 0.2], "y": ["a", "b", "a", "b"], "z": [1.0, 2.0, 3.0, 4.0]})
    assert info.knn_mi(df, ["x"], "y", True).first()["mi"] == pytest.approx(ross(np.array([0.5, 0.1, 0.4, 0.2]), np.array([0, 1, 0, 1]), 3))
    assert info.knn_mi(df.limit(2), ["x"], "z", False).count() == 1 and info.knn_mi(df.limit(0), ["x"], "z", False).count() == 0
    assert info.knn_mi(df.limit(1), ["x"], "z", False).collect() == [("x", 0.0)]
    with pytest.raises(ValueError):
        info.knn_mi(df.selectExpr("IF(z = 1, NULL, x) AS x", "z"), ["x"], "z", False)


def test_no_task_reads_a_whole_column(spark, monkeypatch):
    """A column in one task is what made memory and time grow: the strips of one hold STRIP rows or so."""
    monkeypatch.setattr(neighbours, "STRIP", 100)
    df = frame(spark, {"f": np.zeros(3000, np.int32), "c": np.zeros(3000), "x": np.repeat(0.5, 3000), "y": np.random.default_rng(22).random(3000), "m": np.ones(3000, int)})
    kept = neighbours.strips(df, ["f", "c", "x", "y"], 3000)
    sizes = [r["count"] for r in kept.groupBy("strip").count().collect()]
    kept.unpersist()
    assert sum(sizes) == 3000 and max(sizes) <= 400
