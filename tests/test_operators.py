"""Planted answers and independent numpy versions."""

import numpy as np
import pytest

from relevantia.operators import grams, hsic, info, lasso, sampling, search
from relevantia.plans import LassoParameters, SearchParameters, Selector, categorical_select, select, select_features
from relevantia.sources import read_features, write_result


def frame(spark, columns):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(next(iter(columns.values())))), **columns}))


def centred(k):
    n = len(k)
    h = np.eye(n) - 1.0 / n
    return h @ k @ h


def rbf(x, scale):
    return np.exp(-((x[:, None, :] - x[None, :, :]) ** 2).sum(2) / (2 * scale * scale))


def test_planted_nonnegative_coefficients():
    rng = np.random.default_rng(3)
    for d, n in ((10, 1000), (14, 3000), (100, 3000)):
        x = rng.normal(size=(n, d))
        beta = np.zeros(d)
        beta[rng.choice(d, d // 4, replace=False)] = rng.uniform(0.5, 2, d // 4)
        y = x @ beta + rng.normal(0, 1e-2, n)
        active, path = lasso.nlars(x.T @ x, x.T @ y, d // 2)
        assert set(np.flatnonzero(beta)) <= set(active) and (path >= -1e-9).all()
        if d == 10:
            full, ends = lasso.nlars(x.T @ x, x.T @ y, d)
            assert np.allclose(ends[-1][beta > 0], beta[beta > 0], atol=0.05)


def test_nlars_stops_where_nothing_is_left():
    assert lasso.nlars(np.eye(2), np.array([-1.0, 0.0]), 2)[0] == []
    active, path = lasso.nlars(np.eye(1), np.array([2.0]), 1)
    assert active == [0] and np.allclose(path[-1], [2.0])
    assert lasso.nlars(np.ones((2, 2)), np.array([1.0, 1.0]), 2)[0][0] == 0


def test_hsic_of_many_sets_equals_that_of_each(spark):
    rng = np.random.default_rng(14)
    n = 90
    df = frame(spark, {"a": rng.integers(0, 3, n), "b": rng.integers(0, 4, n), "c": rng.integers(0, 2, n), "y": rng.integers(0, 3, n)})
    df = df.withColumn("id", df["id"].cast("string"))
    sets = [("a", "b", "c"), ("c",), ("a",), ("a", "c"), ("b",)]
    assert [[sets[i] for i in c] for c in hsic.chains(sets)] == [[("c",), ("a", "c"), ("a", "b", "c")], [("a",)], [("b",)]]
    values = {c: np.array([r[c] for r in df.orderBy(df["id"].cast("int")).collect()], float) for c in "abcy"}

    def gram(cols, kernel):
        x = np.stack([values[c] for c in cols], 1)
        if kernel == hsic.RBF:
            return rbf(x, np.sqrt(len(cols)))
        same = (x[:, None, :] == x[None, :, :]).all(2)
        return same / same.sum(1, keepdims=True)

    for kx in (hsic.RBF, hsic.DELTA):
        for ky in (hsic.RBF, hsic.DELTA):
            got = {sets[r["set"]]: r["hsic"] for r in hsic.hsic_b_sets(df, sets, ["y"], "id", kx, ky, block=40).collect()}
            want = {s: (centred(gram(s, kx)) * centred(gram(("y",), ky))).sum() / n**2 for s in sets}
            assert got == pytest.approx(want, rel=1e-9), (kx, ky)
    assert hsic.hsic_b_sets(df.limit(0), sets, ["y"], "id").count() == 0
    assert hsic.hsic_b(df.limit(0), ["a"], ["y"], "id").collect()[0][0] is None


def test_weighted_pairs_equal_those_of_the_rows(spark):
    rng = np.random.default_rng(15)
    df = frame(spark, {"a": rng.integers(0, 3, 200), "b": rng.integers(0, 4, 200), "y": rng.integers(0, 2, 200)})
    sets = {"0": ["a"], "1": ["a", "b"]}
    counted = info.label_pairs(info.distinct_counts(df, ["a", "b", "y"]), sets, "y", "_count")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, info.label_pairs(df, sets, "y").collect()))


def test_hsic_of_all_kernels_equals_the_trace(spark):
    rng = np.random.default_rng(4)
    n = 130
    cols = {"a": rng.random(n), "b": rng.random(n), "c": rng.integers(0, 4, n), "y": rng.random(n)}
    df = frame(spark, cols)
    delta = (cols["c"][:, None] == cols["c"][None, :]) / np.bincount(cols["c"])[cols["c"]][:, None]
    joint = rbf(np.stack([cols["a"], cols["b"]], 1), np.sqrt(2))
    for x, kx, gram in ((["a", "b"], hsic.RBF, joint), (["c"], hsic.DELTA, delta)):
        want = (centred(gram) * centred(rbf(cols["y"][:, None], 1))).sum() / n**2
        assert hsic.hsic_b(df, x, ["y"], "id", kx, hsic.RBF, block=50).first()[0] == pytest.approx(want, rel=1e-9)
    assert hsic.hsic_b(df, ["c"], ["c"], "id", hsic.DELTA, hsic.DELTA).first()[0] == pytest.approx((centred(delta) ** 2).sum() / n**2)


def test_statistics_are_sums_over_minibatches(spark):
    rng = np.random.default_rng(5)
    cols = {"a": rng.random(60), "k": rng.integers(0, 3, 60), "y": rng.random(60)}
    df = frame(spark, cols)
    stats = hsic.hsic_statistics(df, ["a", "k"], ["y"], {"a": hsic.RBF, "k": hsic.DELTA}, hsic.RBF, "id", 1000, 20, 2)
    m, g = np.zeros((2, 2)), np.zeros(2)
    for r in stats.collect():
        if r["b"] < 0:
            g[r["a"]] = r["v"]
        else:
            m[r["a"], r["b"]] = m[r["b"], r["a"]] = r["v"]
    want_m, want_g = np.zeros((2, 2)), np.zeros(2)
    outer = sampling.assign_batches(df, "id", 1000)
    for e in (1, 2):
        for _, p in sampling.assign_batches(outer, "id", 20, "mb", e, ["batch"]).toPandas().groupby("mb"):
            k = p["k"].to_numpy()
            phi = [centred(rbf(p[["a"]].to_numpy(), 1)), centred((k[:, None] == k[None, :]) / np.bincount(k)[k][:, None])]
            y = centred(rbf(p[["y"]].to_numpy(), 1))
            want_m += [[(u * v).sum() for v in phi] for u in phi]
            want_g += [(u * y).sum() for u in phi]
    assert np.allclose(m, want_m) and np.allclose(g, want_g)


def test_products_by_strips_equal_whole_matrices(monkeypatch):
    rng = np.random.default_rng(13)
    columns = [(rng.random((90, 1)), hsic.RBF, 1.0), (rng.integers(0, 4, (90, 1)), hsic.DELTA, 1.0), (rng.random((90, 2)), hsic.RBF, 2**0.5)]
    phi = np.stack([centred(hsic.gram(*c)).ravel() for c in columns])
    for size in (1, 8 * 90 * 3 * 7, 64 << 20):
        monkeypatch.setattr(hsic, "STRIP_BYTES", size)
        assert np.allclose(hsic.products_of(columns), phi @ phi.T)


def test_orders_of_any_ids_differ_by_epoch_and_seed(spark):
    """String ids work; no two of ten epochs or of two seeds give the same order, and an order repeats by its seed."""
    df = spark.range(60).selectExpr("concat('u', id) AS id")
    order = lambda e, s=0: [r["id"] for r in sampling.positions(df, "id", e, seed=s).orderBy("pos").collect()]
    found = [order(e) for e in range(10)] + [order(0, 1)]
    assert len(set(map(tuple, found))) == 11 and order(0) == found[0] and sorted(found[3]) == sorted(found[0])
    assert sampling.assign_batches(df, "id", 20, seed=5).groupBy("batch").count().count() == 3


def test_large_minibatches_stay_small():
    """300 features and minibatches of 800 rows: far below the 1.5 GB of all Gram matrices."""
    import tracemalloc

    rng = np.random.default_rng(14)
    columns = [(rng.random((800, 1)), hsic.RBF, 1.0) for _ in range(301)]
    tracemalloc.start()
    hsic.products_of(columns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


def test_columns_named_categorical_and_rows_with_nulls(spark):
    rng = np.random.default_rng(15)
    u = rng.integers(0, 4, 600)
    df = frame(spark, {"s": np.array(["a", "b", "c", "d"])[u], "c": rng.random(600), "y": u}).selectExpr("*", "'t' AS t")
    one = {"batch": 600, "minibatch": 100, "epochs": 1, "use_preselection": False}
    found = select_features(df, ["y"], "id", LassoParameters(**one), SearchParameters(), categorical=["s"])
    assert found.categorical == ["s"] and found.ignored == ["t"] and found.lasso.lasso_path.count() > 0
    with pytest.raises(ValueError):
        select_features(df, ["y"], "id", categorical=["none"])
    holes = df.selectExpr("id", "s", "IF(id < 5, NULL, c) AS c", "y")
    assert select_features(holes, ["y"], "id", LassoParameters(**one), categorical=["s"], drop_nulls=True).categorical == ["s"]


def test_grams_of_prefixes_equal_joint_ones(spark):
    rng = np.random.default_rng(6)
    df = frame(spark, {"a": rng.random(15), "b": rng.random(15)}).selectExpr("*", "0 AS mb")
    prefix = {(r["i"], r["j"]): r["k"] for r in grams.rbf_gram_prefix(df, ["a", "b"]).where("prefix = 2").collect()}
    joint = {(r["i"], r["j"]): r["k"] for r in grams.rbf_gram_joint(df, ["a", "b"], 2**0.5).collect()}
    assert grams.prefix_gram(df, ["a", "b"], "rbf").count() == grams.rbf_gram_prefix(df, ["a", "b"]).count() and grams.prefix_gram(df, ["a"], "delta").count() == 15
    assert prefix.keys() == joint.keys() and all(prefix[p] == pytest.approx(joint[p]) for p in joint)


def test_centring_equals_the_matrix_product(spark):
    rng = np.random.default_rng(7)
    df = frame(spark, {"a": rng.random(12)}).selectExpr("*", "0 AS mb")
    g = grams.rbf_gram(grams.long_form(df, ["a"]))
    k, c, f = (np.zeros((12, 12)) for _ in range(3))
    for out, rows in ((k, g), (c, grams.center_gram(g)), (f, grams.frobenius_gram(g))):
        for r in rows.collect():
            out[r["i"], r["j"]] = r["k"]
    assert np.allclose(c, centred(k)) and np.allclose(f, centred(k) / np.linalg.norm(centred(k)), atol=1e-6) or np.allclose(np.linalg.norm(f), np.linalg.norm(c) / np.linalg.norm(k))


def test_delta_kernels_of_three_columns_are_not_confused(spark):
    codes = [(a, b, c) for a in range(4) for b in range(4) for c in range(4)]
    df = frame(spark, {f"x{i}": np.array([t[i] for t in codes]) for i in range(3)}).selectExpr("*", "0 AS mb")
    assert grams.delta_gram_joint(df, ["x0", "x1", "x2"]).count() == 64


def test_batches_have_equal_size_and_drop_the_rest(spark):
    sizes = [r["count"] for r in sampling.assign_batches(spark.range(103), "id", 20).groupBy("batch").count().collect()]
    assert sizes == [20] * 5
    assert sampling.assign_batches(spark.range(7), "id", 20).count() == 7
    assert sampling.assign_batches(spark.range(0), "id", 20).count() == 0


def test_adjusted_mi_of_equal_and_of_unrelated_classes(spark):
    rng = np.random.default_rng(8)
    u = rng.integers(0, 5, 2000)
    df = frame(spark, {"u": u, "same": (u * 7) % 5, "other": rng.integers(0, 6, 2000), "one": np.zeros(2000, int)})
    got = {r["feature"]: r["ami"] for r in info.adjusted_mi(info.label_pairs(df, {c: [c] for c in ("same", "other", "one")}, "u")).collect()}
    assert got["same"] == pytest.approx(1) and abs(got["other"]) < 0.01 and abs(got["one"]) < 1e-9


def test_discretise_of_ties_and_spread_values(spark):
    y = np.concatenate([np.zeros(50), np.linspace(0, 1, 51)[1:]])
    df = frame(spark, {"y": y})
    bins = np.array([r[0] for r in df.select("id", sampling.discretise(df, "y").alias("b")).orderBy("id").select("b").collect()])
    cuts = sorted({q for q in np.quantile(y, np.linspace(0.1, 0.9, 10)) if q > 0})
    assert (bins == sum((y > q).astype(int) for q in cuts)).all()


def test_permutations_are_permutations_and_repeat_by_seed():
    found = search.haar_permutations(6, 3, 1)
    assert found == search.haar_permutations(6, 3, 1) and len(found) == len(set(found)) <= 30
    assert all(sorted(p) == list(range(6)) for p in found)
    assert search.haar_permutations(2, 1, 0) == [(0, 1), (1, 0)] and search.haar_permutations(1, 1, 0) == [(0,)]


def test_selection_finds_planted_continuous_features(spark):
    rng = np.random.default_rng(9)
    x = {f"x{i}": rng.random(3000) for i in range(8)}
    df = frame(spark, {**x, "y": x["x2"] - x["x5"] ** 2})
    s = Selector(df, "y", "id")
    assert set(s.select(2, batch=1500, minibatch=150, epochs=1)) == {"x2", "x5"}
    assert s.lasso_path().count() > 0
    found = select(df, "y", "id", hsic_threshold=0.1, use_preselection=True, mi_threshold=0.05, batch=1500, minibatch=150, epochs=1)
    assert set(found.features) == {"x2", "x5"} and set(found.preselection) >= {"x2", "x5"}
    assert set(found.mi_ordered_features[:2]) == {"x2", "x5"} and found.regcurve == sorted(found.regcurve)
    assert set(found.select_from_lasso_path(0.1)) == {"x2", "x5"}
    with pytest.raises(RuntimeError):
        Selector(df, "y", "id").lasso_path()


def test_a_single_relevant_feature_of_mixed_types(spark):
    rng = np.random.default_rng(10)
    cols = {**{f"d{i}": rng.integers(0, 10, 2000) for i in range(3)}, **{f"c{i}": rng.uniform(-10, 10, 2000) for i in range(3)}}
    for name, target in (("d1", (cols["d1"] % 4).astype(int)), ("c2", np.sin(cols["c2"] / 3))):
        assert Selector(frame(spark, {**cols, "y": target}), ["y"], "id").select(1, batch=1000, minibatch=200, epochs=1) == [name]


def test_marginally_blind_pair_is_found_together(spark):
    rng = np.random.default_rng(11)
    x = {f"x{i}": rng.integers(0, 3, 2000) for i in range(4)}
    df = frame(spark, {**x, "y": (x["x1"] == x["x3"]).astype(int)})
    assert {"x1", "x3"} <= set(categorical_select(df, list(x), ["y"], SearchParameters(permutations=12, max_iter=1, seed=2)))


def test_nothing_relevant_selects_nothing(spark):
    df = frame(spark, {"a": np.zeros(50, int), "b": np.zeros(50, int), "y": np.arange(50) % 3})
    assert categorical_select(df, ["a", "b"], ["y"]) == []


def test_one_call_over_mixed_columns(spark):
    rng = np.random.default_rng(12)
    c = {f"c{i}": rng.random(2000) for i in range(5)}
    d = {f"d{i}": rng.integers(0, 4, 2000) for i in range(4)}
    df = frame(spark, {**c, **d, "y": np.where(d["d1"] > 1, 3.0, -3.0) + c["c3"]})
    found = select_features(df, ["y"], "id", LassoParameters(batch=2000, minibatch=200, epochs=1, hsic_threshold=0.05), SearchParameters(seed=1, permutations=8))
    assert found.continuous[:1] == ["c3"] and "d1" in found.categorical and found.selected == found.categorical + found.continuous
    only = select_features(df.select("id", "c1", "c3", "y"), ["y"], "id", LassoParameters(batch=2000, minibatch=200, epochs=1, use_preselection=False))
    assert only.categorical == [] and "c3" in only.continuous


def test_nulls_are_refused(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, None, 3.0)], "id long, x double, y double")
    with pytest.raises(ValueError):
        Selector(df, "y", "id").select(1)


def test_csv_and_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 3)], "id long, c double, d int")
    for form in ("csv", "parquet"):
        write_result(df.coalesce(1), str(tmp_path / f"t.{form}"), form)
        assert read_features(spark, str(tmp_path / f"t.{form}")).collect()[0]["c"] == 0.5
