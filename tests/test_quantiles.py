"""Exact quantiles without a table of all values in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relevantia.operators import sampling


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_quantiles_equal_percentile(spark, monkeypatch, few):
    monkeypatch.setattr(sampling, "FEW", few)
    rng = np.random.default_rng(41)
    at = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]
    odd = [-np.inf, np.inf, 0.0, -0.0, 5e-324, -5e-324, 1e308, 1.0, 1.0, float(np.nextafter(1, 2))]
    for values in (rng.standard_cauchy(301).tolist(), [3.5], [2.0] * 40, rng.integers(-3, 3, 200).astype(float).tolist(), odd, [1.0, None, float("nan"), 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        want = df.agg(F.percentile("x", F.array(*map(F.lit, at)))).first()[0]
        assert np.array_equal(sampling.quantiles(df, "x", at), want, equal_nan=True), values
    for kind in ("int", "bigint", "decimal(12,2)", "float"):
        df = spark.createDataFrame([(float(v),) for v in rng.integers(-900, 900, 99) / 4], "x double").selectExpr(f"CAST(x AS {kind}) AS x")
        assert sampling.quantiles(df, "x", at) == df.agg(F.percentile("x", F.array(*map(F.lit, at)))).first()[0]


def test_discretise_needs_no_table_of_all_values(spark, monkeypatch):
    def none(*_):
        raise AssertionError("percentile() counts all values in one task")

    monkeypatch.setattr(F, "percentile", none)
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS x")
    assert df.select(sampling.discretise(df, "x").alias("b")).distinct().count() == 11
    assert df.limit(0).select(sampling.discretise(df.limit(0), "x")).count() == 0
