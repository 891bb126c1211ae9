"""HSIC by sums of features against Gram matrices and against pairs of blocks."""

import numpy as np
import pytest

from relevantia.operators import hsic


def frame(spark, columns):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(next(iter(columns.values())))), **columns}))


def test_features_multiply_to_the_kernel():
    rng = np.random.default_rng(31)
    for d, far in ((1, 0.5), (1, 9.0), (2, 3.0), (3, 0.5)):
        u = rng.uniform(-far, far, (60, d))
        phi = hsic.gaussian_features(u, hsic._degree(d * far * far))
        want = np.exp(-((u[:, None, :] - u[None, :, :]) ** 2).sum(2) / 2)
        assert np.abs(phi @ phi.T - want).max() < 1e-14
    assert hsic._degree(0.0) == 0


def test_series_equal_pairs_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(32)
    n = 300
    a = rng.normal(size=n) * 2 + 1000
    df = frame(spark, {"a": a, "b": rng.random(n) - a, "s": rng.integers(0, 3, n) - 0.0, "y": np.round(a) % 3 * 0.5})
    df = df.selectExpr("id", "a", "b", "IF(s = 0 AND id % 2 = 0, -s, s) AS s", "y")
    for sets, kx, ky in (([("a",), ("a", "b"), ("s",)], hsic.RBF, hsic.RBF), ([("a",), ("b",)], hsic.RBF, hsic.DELTA), ([("s",), ("s", "y")], hsic.DELTA, hsic.RBF)):
        assert hsic._by_series(df, sets, ["y"], kx, ky) is not None
        got = {r["set"]: r["hsic"] for r in hsic.hsic_b_sets(df, sets, ["y"], "id", kx, ky).collect()}
        with monkeypatch.context() as m:
            m.setattr(hsic, "SERIES", 0)
            want = {r["set"]: r["hsic"] for r in hsic.hsic_b_sets(df, sets, ["y"], "id", kx, ky, block=100).collect()}
        assert got == pytest.approx(want, rel=1e-8, abs=1e-14) and len(got) == len(sets)
    assert hsic._by_series(df.selectExpr("id", "a * 1e6 AS a", "y"), [("a",)], ["y"], hsic.RBF, hsic.RBF) is None


def test_few_columns_meet_in_no_pairs(spark, monkeypatch):
    """Pairs of blocks are what made time grow with the square of the rows."""

    def none(*_):
        raise AssertionError("pairs of blocks")

    monkeypatch.setattr(hsic, "_blocked", none)
    rng = np.random.default_rng(33)
    df = frame(spark, {"a": rng.random(50), "b": rng.random(50), "c": rng.random(50), "y": rng.integers(0, 2, 50)})
    assert hsic.hsic_b(df, ["a", "b"], ["c"], "id").first()[0] > 0
    assert hsic.hsic_b_sets(df, [("a",), ("a", "b", "c")], ["y"], "id", hsic.RBF, hsic.DELTA).count() == 2
