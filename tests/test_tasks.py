"""How work is dealt to tasks."""

import math

import pytest
from pyspark.sql import functions as F

from relevantia.operators import grams, info


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """Rows before the join are few, pairs many: tasks must follow the pairs, or one task's memory grows with the table."""
    monkeypatch.setattr(grams, "PAIRS", 500)
    df = spark.range(400).selectExpr("id", "id / 7.0 AS a", "id % 20 AS mb")
    k = grams.center_gram(grams.rbf_gram(grams.long_form(df, ["a"])))
    sizes = [r["count"] for r in k.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    assert sum(sizes) == 8000 and max(sizes) <= 2400


def test_label_pairs_repeat_distinct_tuples_alone(spark):
    """What is repeated for each feature are the distinct tuples, not the rows."""
    df = spark.range(5000).selectExpr("id % 3 AS a", "IF(id % 5 = 0, NULL, id % 2) AS b", "id % 4 AS y")
    pairs = info.label_pairs(df, {"0": ["a"], "1": ["a", "b"]}, "y")
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in plan[plan.index("Generate explode") :]
    got = {(r["feature"], r["u"], r["v"]): r["n"] for r in pairs.collect()}
    assert sum(n for (f, _, _), n in got.items() if f == "1") == 5000 and len(got) == 12 + 24


def test_expected_information_of_many_and_of_few_terms_at_once(spark, monkeypatch):
    df = spark.range(700).selectExpr("id % 3 AS a", "floor(sqrt(id)) AS b", "id % 4 + floor(id / 500) AS y")
    pairs = info.label_pairs(df, {"0": ["a"], "1": ["a", "b"]}, "y")
    got = {r["feature"]: r["emi"] for r in info.expected_mi(pairs).collect()}
    monkeypatch.setattr(info, "TERMS", 10)
    assert {r["feature"]: r["emi"] for r in info.expected_mi(pairs).collect()} == pytest.approx(got)
    rows = pairs.collect()
    for f in "01":
        size = {c: {} for c in "uv"}
        for r in rows:
            if r["feature"] == f:
                for c in "uv":
                    size[c][r[c]] = size[c].get(r[c], 0) + r["n"]
        want = sum(k / 700 * math.log(700 * k / (a * b)) * math.comb(a, k) * math.comb(700 - a, b - k) / math.comb(700, b) for a in size["u"].values() for b in size["v"].values() for k in range(max(1, a + b - 700), min(a, b) + 1))
        assert got[f] == pytest.approx(want, abs=1e-9)
