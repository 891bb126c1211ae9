"""The queries of the feature-selection operators over the driver's tables, and their SQL.

Tables: X = embeddings, O = orders with their customers, V = events, L = lineitem. Lasso queries
take all 64 dimensions of X; queries whose results or time are quadratic in rows (entries of Gram
matrices, HSIC of prefixes, neighbours) take three of them. The tables hold hardly any dependence,
so selections use targets planted as expressions of real columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hash_order_sql
from .operators import grams, hsic, info, lasso, sampling, search
from .plans import LassoParameters, SearchParameters, Selector, categorical_select, select, select_features
from .sources import read_features

E = ("e3", "e17", "e40")
MB = 50


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_features(spark, f"{d}/{name}.parquet")


def x_table(spark, d, dims=None) -> DataFrame:
    dims = dims or [int(e[1:]) for e in E]
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in dims])


def o_table(spark, d) -> DataFrame:
    o, c = _table(spark, d, "orders"), _table(spark, d, "customer")
    rank = lambda col, values: F.array_position(F.array(*map(F.lit, values)), F.col(col)).cast("int")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    return joined.select(
        F.col("o_orderkey").alias("id"), "o_totalprice", "c_acctbal", "o_orderstatus", "o_orderpriority", "c_mktsegment", "c_nationkey",
        rank("o_orderstatus", ["F", "O", "P"]).alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.ascii("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("int").alias("nation"),
    )


X_SQL = "x AS (SELECT vec_id AS id, label, " + ", ".join(f"embedding[{int(e[1:]) + 1}]::DOUBLE AS {e}" for e in E) + " FROM embeddings)"
O_SQL = """o AS (SELECT o_orderkey AS id, o_totalprice, c_acctbal, o_orderstatus, o_orderpriority, c_mktsegment, c_nationkey,
 CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 ELSE 0 END AS status, substr(o_orderpriority, 1, 1)::INT AS priority,
 ascii(c_mktsegment) AS segment, c_nationkey::INT AS nation FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _mb(df: DataFrame, size: int = MB) -> DataFrame:
    return sampling.assign_batches(df, "id", size, "mb")


def _mb_sql(of: str, size: int = MB, epoch: int = 0) -> str:
    return f"""p AS (SELECT *, row_number() OVER (ORDER BY {hash_order_sql('id', epoch)}, id) - 1 AS pos, count(*) OVER () AS n FROM {of}),
m AS (SELECT *, pos // least({size}, n) AS mb FROM p WHERE pos // least({size}, n) < n // least({size}, n))"""


X_LONG = "l AS (" + " UNION ALL ".join(f"SELECT mb, id AS i, '{e}' AS feature, {e} AS x FROM m" for e in E) + ")"
RBF_SQL = "g AS (SELECT a.mb, a.feature, a.i, b.i AS j, exp(-(a.x - b.x) * (a.x - b.x) / 2.0) AS k FROM l a JOIN l b ON a.mb = b.mb AND a.feature = b.feature)"
CODES = ("status", "priority")
O_LONG = "l AS (" + " UNION ALL ".join(f"SELECT mb, id AS i, '{c}' AS feature, {c} AS x FROM m" for c in ("nation",)) + ")"
CENTRED = "c AS (SELECT mb, feature, i, j, k - avg(k) OVER (PARTITION BY mb, feature, i) - avg(k) OVER (PARTITION BY mb, feature, j) + avg(k) OVER (PARTITION BY mb, feature) AS k FROM g)"


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def _planted(spark, d, dims=range(64)) -> DataFrame:
    """X with a planted target: dimensions 3 and 17 alone matter."""
    return x_table(spark, d, list(dims)).drop("label").withColumn("y", F.col("e3") - F.col("e17"))


PLANTED = [f"e{i}" for i in range(64)]
SIZES = {"batch": 250, "minibatch": 125, "epochs": 2}
#: A recorded path of two batches, for the operators that work on paths.
PATH = [(0, 0, "a", 0.5), (0, 0, "b", 0.0), (0, 0, "c", 0.0), (0, 1, "a", 0.75), (0, 1, "b", 0.25), (0, 1, "c", 0.0), (1, 0, "a", 1.0), (1, 0, "b", 0.0), (1, 0, "c", 0.004)]
PATH_SQL = "path(batch, step, feature, beta) AS (VALUES " + ", ".join(f"({b}, {s}, '{f}', {v}::DOUBLE)" for b, s, f, v in PATH) + ")"
MEAN_SQL = """e AS (SELECT *, max(step) OVER (PARTITION BY batch) AS last, max(step) OVER () AS most FROM path),
q AS (SELECT batch, step, feature, beta FROM path UNION ALL SELECT batch, unnest(range(last + 1, most + 1)), feature, beta FROM e WHERE step = last AND last < most),
mp AS (SELECT step, feature, avg(beta) AS beta FROM q GROUP BY step, feature)"""


def _path(spark):
    return spark.createDataFrame(PATH, "batch int, step int, feature string, beta double")


def q_standardise(spark, d):
    cols = ["o_totalprice", "c_acctbal"]
    return _rounded(sampling.standardise(o_table(spark, d).select("id", *cols), cols), *cols)


def q_split_by_type(spark, d):
    return sampling.split_by_type(o_table(spark, d))


def q_batch_assign(spark, d):
    return sampling.assign_batches(_table(spark, d, "events").select("event_id"), "event_id", 300)


def q_epoch_replicate(spark, d):
    return sampling.replicate_epochs(_table(spark, d, "events").select("event_id"), "event_id", 2)


def q_discretise(spark, d):
    line = _table(spark, d, "lineitem")
    return line.select("l_extendedprice", sampling.discretise(line, "l_extendedprice").cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


def q_prefix_encode(spark, d):
    o = o_table(spark, d)
    combos = o.groupBy("status", "priority", "nation").agg(F.count("*").alias("n"))
    return info.prefix_codes(combos, ["status", "priority", "nation"]).withColumns({f"code_{i}": F.col(f"code_{i}").cast("long") for i in (1, 2, 3)})


def _x_long(spark, d):
    return grams.long_form(_mb(x_table(spark, d)), list(E))


def q_rbf_gram(spark, d):
    return _rounded(grams.rbf_gram(_x_long(spark, d)), "k")


def q_rbf_gram_joint(spark, d):
    return _rounded(grams.rbf_gram_joint(_mb(x_table(spark, d)), list(E), 1.5), "k")


def q_rbf_gram_prefix(spark, d):
    return _rounded(grams.rbf_gram_prefix(_mb(x_table(spark, d)), list(E)), "k")


def _o_long(spark, d, cols=("nation",)):
    return grams.long_form(_mb(o_table(spark, d)), list(cols), cast="int")


def q_delta_gram(spark, d):
    return _rounded(grams.delta_gram(_o_long(spark, d)), "k")


def q_delta_raw(spark, d):
    return grams.delta_gram(_o_long(spark, d), "raw")


def q_delta_gram_joint(spark, d):
    return _rounded(grams.delta_gram_joint(_mb(o_table(spark, d)), ["status", "priority", "nation"]), "k")


def q_delta_gram_prefix(spark, d):
    return _rounded(grams.delta_gram_prefix(_mb(o_table(spark, d)), ["nation", "priority"]), "k")


def q_mixed_gram(spark, d):
    x = _mb(x_table(spark, d)).withColumn("label", F.col("label").cast("int"))
    return _rounded(grams.mixed_gram(x, ["label"], ["e3"]), "k")


def q_center_gram(spark, d):
    return _rounded(grams.center_gram(grams.rbf_gram(_x_long(spark, d))), "k", digits=5)


def q_gram_frobenius(spark, d):
    return _rounded(grams.frobenius_gram(grams.rbf_gram(_x_long(spark, d))), "k", digits=5)


def q_hsic_b_rbf(spark, d):
    return _rounded(hsic.hsic_b(x_table(spark, d), ["e3", "e17"], ["e40"], "id"), "hsic", digits=8)


def q_hsic_b_delta(spark, d):
    return _rounded(hsic.hsic_b(o_table(spark, d), ["status", "nation"], ["priority"], "id", hsic.DELTA, hsic.DELTA), "hsic", digits=10)


def q_hsic_b_mixed(spark, d):
    return _rounded(hsic.hsic_b(x_table(spark, d), ["e3"], ["label"], "id", hsic.RBF, hsic.DELTA), "hsic", digits=8)


def q_hsic_matrix(spark, d):
    m = _mb(o_table(spark, d), 500)
    products = hsic.delta_matrix(m, ["status", "priority", "segment", "nation"], ["mb"])
    return _rounded(products.groupBy("a", "b").agg(F.sum("product").alias("v")), "v", digits=5)


def q_hsic_vector(spark, d):
    x = x_table(spark, d).withColumn("label", F.col("label").cast("int"))
    stats = hsic.hsic_statistics(x, list(E), ["label"], dict.fromkeys(E, hsic.RBF), hsic.DELTA, "id", 1 << 40, 100, 1)
    return _rounded(stats.where("b = -1").select(F.element_at(F.array(*map(F.lit, E)), F.col("a") + 1).alias("feature"), "v"), "v", digits=5)


def q_hsic_lasso_matrix(spark, d):
    """M and g together: the products of every pair of kernels, the target's among them."""
    stats = hsic.hsic_statistics(_planted(spark, d), list(E), ["y"], dict.fromkeys(E, hsic.RBF), hsic.RBF, "id", **SIZES)
    name = lambda c: F.when(F.col(c) < 0, "y").otherwise(F.get(F.array(*map(F.lit, E)), F.col(c)))
    return _rounded(stats.select("batch", name("a").alias("a"), name("b").alias("b"), "v"), "v", digits=4)


ONE = {"status": ["status"], "priority": ["priority"], "segment": ["segment"]}
PREFIX = {"1": ["status"], "2": ["status", "priority"], "3": ["status", "priority", "segment"]}


def q_mutual_info(spark, d):
    m = info.mutual_information(info.label_pairs(o_table(spark, d), ONE, "nation"))
    return _rounded(m.select("feature", "mi", "hu", "hv"), "mi", "hu", "hv")


def q_expected_mi(spark, d):
    return _rounded(info.expected_mi(info.label_pairs(o_table(spark, d), ONE, "nation")), "emi")


def q_ami_features(spark, d):
    return _rounded(info.adjusted_mi(info.label_pairs(o_table(spark, d), ONE, "nation")), "ami")


def q_ami_prefix(spark, d):
    return _rounded(info.adjusted_mi(info.label_pairs(o_table(spark, d), PREFIX, "nation")), "ami")


def q_featurewise_ami_select(spark, d):
    o = o_table(spark, d).withColumn("y", F.col("status") + F.col("priority"))
    return info.adjusted_mi(info.label_pairs(o, ONE, "y")).where("ami > 0.05").select("feature")


def q_knn_mi_regression(spark, d):
    return _rounded(info.knn_mi(_planted(spark, d), ["e3", "e17", "e40"], "y", False), "mi")


def q_knn_mi_classif(spark, d):
    return _rounded(info.knn_mi(x_table(spark, d).withColumn("y", (F.col("e3") > F.col("e17")).cast("int")), list(E), "y", True), "mi")


def q_mi_preselect(spark, d):
    scores = info.knn_mi(_planted(spark, d), ["e3", "e17", "e40"], "y", False).withColumn("target", F.lit("y"))
    return _rounded(info.preselect(scores, 0.3), "total", digits=5)


def _runs(spark, d, most=2):
    return lasso.run_batches(_planted(spark, d), PLANTED, ["y"], "id", most, **SIZES)


def q_nlars_path(spark, d):
    return _rounded(_runs(spark, d).select("batch", F.col("step").cast("long").alias("step"), "feature", "beta"), "beta")


def q_nlars_active(spark, d):
    return lasso.entries(_runs(spark, d)).withColumn("rank", F.col("rank").cast("long"))


def q_lasso_path_mean(spark, d):
    return _rounded(lasso.mean_path(_path(spark)), "beta").withColumn("step", F.col("step").cast("long"))


def q_projection_matrix(spark, d):
    return lasso.projection_matrix(_runs(spark, d)).withColumn("rank", F.col("rank").cast("long"))


def q_select_k(spark, d):
    return spark.createDataFrame([(f,) for f in lasso.select_k(lasso.projection_matrix(_runs(spark, d)), PLANTED, 2)], "feature string")


def q_selector_select(spark, d):
    return spark.createDataFrame([(f,) for f in Selector(_planted(spark, d), "y", "id").select(2, **SIZES)], "feature string")


def q_select(spark, d):
    """The staged selection of three features, of which two matter."""
    found = select(_planted(spark, d), "y", "id", list(E), hsic_threshold=0.05, **SIZES)
    return spark.createDataFrame([(k + 1, f) for k, f in enumerate(found.features)], "rank long, feature string")


def q_regularization_curve(spark, d):
    return _rounded(lasso.regularization_curve(lasso.mean_path(_path(spark))), "beta", "curve").withColumn("rank", F.col("rank").cast("long"))


def q_select_threshold(spark, d):
    return _rounded(lasso.select_from_path(lasso.mean_path(_path(spark)), 0.01), "beta").withColumn("rank", F.col("rank").cast("long"))


def q_haar_permutations(spark, d):
    perms = search.haar_permutations(6, 3, 7)
    return spark.createDataFrame([(n, k, f) for n, p in enumerate(perms) for k, f in enumerate(p)], "perm_id int, pos int, feature int")


def q_ami_search(spark, d):
    o = o_table(spark, d).withColumn("y", F.col("status") * 10 + F.col("priority"))
    names = ["status", "priority", "segment", "nation"]
    o = info.distinct_counts(o, [*names, "y"]).persist()
    found = search.search(names, search.ami_metric(o, "y", "_count"), 1, seed=3)
    o.unpersist()
    return spark.createDataFrame([(f,) for f in found], "feature string")


def q_hsic_search(spark, d):
    x = x_table(spark, d).withColumn("y", (F.col("e3") > F.col("e17")).cast("int"))
    found = search.search(list(E), search.hsic_metric(x, ["y"], "id"), 1, im_ratio=0.1, max_iter=1, seed=3, add_back=False, leave=1)
    return spark.createDataFrame([(f,) for f in found], "feature string")


def q_categorical_select(spark, d):
    o = o_table(spark, d).withColumn("y", F.col("status") * 10.0 + F.col("priority"))
    found = categorical_select(o, ["status", "priority", "segment"], ["y"], SearchParameters(seed=3))
    return spark.createDataFrame([(f,) for f in found], "feature string")


def q_hsic_lasso_rank(spark, d):
    return _rounded(lasso.rank_features(_planted(spark, d), PLANTED, ["y"], "id", 2, 0.05, **SIZES), "beta").withColumn("rank", F.col("rank").cast("long"))


def q_select_features(spark, d):
    o = o_table(spark, d).select("id", "o_totalprice", "c_acctbal", "status", "priority", "segment")
    o = o.withColumn("y", F.col("status") * 10 + F.col("priority") + F.when(F.col("c_acctbal") > 4500, 100).otherwise(0))
    found = select_features(o, ["y"], "id", LassoParameters(batch=5000, minibatch=250, epochs=1, use_preselection=False, hsic_threshold=0.2), SearchParameters(seed=3))
    return spark.createDataFrame([(n, f) for n, f in enumerate(found.selected)], "rank int, feature string")


def queries() -> dict:
    return {k[2:]: v for k, v in globals().items() if k.startswith("q_")}


_MI = """t AS (SELECT feature, sum(n) AS t FROM c GROUP BY feature),
nu AS (SELECT feature, u, sum(n) AS n_u FROM c GROUP BY feature, u), nv AS (SELECT feature, v, sum(n) AS n_v FROM c GROUP BY feature, v),
hu AS (SELECT feature, -sum(n_u / t * ln(n_u / t)) AS hu FROM nu JOIN t USING (feature) GROUP BY feature),
hv AS (SELECT feature, -sum(n_v / t * ln(n_v / t)) AS hv FROM nv JOIN t USING (feature) GROUP BY feature),
mi AS (SELECT feature, sum(n / t * ln(n * t / (n_u::DOUBLE * n_v))) AS mi FROM c JOIN nu USING (feature, u) JOIN nv USING (feature, v) JOIN t USING (feature) GROUP BY feature),
su AS (SELECT feature, n_u AS a, count(*) AS ma FROM nu GROUP BY ALL), sv AS (SELECT feature, n_v AS b, count(*) AS mb FROM nv GROUP BY ALL),
k0 AS (SELECT *, unnest(range(greatest(1, a + b - t)::BIGINT, least(a, b)::BIGINT + 1)) AS k FROM su JOIN sv USING (feature) JOIN t USING (feature)),
emi AS (SELECT feature, sum(ma * mb * k / t * ln(t * k / (a::DOUBLE * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1)
        - lgamma(t + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(t - a - b + k + 1))) AS emi FROM k0 GROUP BY feature),
ami AS (SELECT feature, (mi - emi) / ((hu + hv) / 2 - emi) AS ami FROM mi JOIN emi USING (feature) JOIN hu USING (feature) JOIN hv USING (feature))"""


def _pairs_sql(sets: dict[str, list[str]], target: str, source: str = "o") -> str:
    return "c AS (" + " UNION ALL ".join(f"SELECT '{name}' AS feature, concat_ws('|', {', '.join(cols)}) AS u, {target} AS v, count(*) AS n FROM {source} GROUP BY ALL" for name, cols in sets.items()) + ")"


def _lasso_sql(features: list[str], standardised: bool = True) -> str:
    """CTEs up to c (centred Gram entries by batch, epoch, minibatch and feature), with SIZES; the target is y."""
    batch, size, n_epochs = SIZES["batch"], SIZES["minibatch"], SIZES["epochs"]
    each = " UNION ALL ".join(
        f"SELECT *, {e} AS epoch, pos // least({size}, n) AS mb FROM (SELECT id, batch, row_number() OVER (PARTITION BY batch ORDER BY {hash_order_sql('id', e)}, id) - 1 AS pos, count(*) OVER (PARTITION BY batch) AS n FROM b)"
        for e in range(1, n_epochs + 1)
    )
    scale = "(x - avg(x) OVER (PARTITION BY feature)) / (1e-9 + stddev_pop(x) OVER (PARTITION BY feature))" if standardised else "x"
    cell = "batch, epoch, mb, feature"
    return f"""l AS (SELECT vec_id AS id, 'e' || k AS feature, embedding[k + 1]::DOUBLE AS x FROM embeddings, unnest([{", ".join(f[1:] for f in features)}]) r(k)
 UNION ALL SELECT vec_id, 'y', embedding[4]::DOUBLE - embedding[18]::DOUBLE FROM embeddings),
z AS (SELECT id, feature, {scale} AS x FROM l),
o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {hash_order_sql('vec_id')}, vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings),
b AS (SELECT id, pos // least({batch}, n) AS batch FROM o WHERE pos // least({batch}, n) < n // least({batch}, n)),
p AS ({each}), r AS (SELECT batch, epoch, mb, id, feature, x FROM p JOIN z USING (id) WHERE mb < n // least({size}, n)),
k AS (SELECT a.batch, a.epoch, a.mb, a.feature, a.id AS i, b.id AS j, exp(-(a.x - b.x) * (a.x - b.x) / 2.0) AS k FROM r a JOIN r b ON a.batch = b.batch AND a.epoch = b.epoch AND a.mb = b.mb AND a.feature = b.feature),
km AS (SELECT {cell}, i, avg(k) AS m FROM k GROUP BY ALL), ka AS (SELECT {cell}, avg(m) AS m FROM km GROUP BY ALL),
c AS (SELECT k.batch, k.epoch, k.mb, k.feature, k.i, k.j, k.k - u.m - v.m + ka.m AS k FROM k JOIN km u ON (k.batch, k.epoch, k.mb, k.feature, k.i) = (u.batch, u.epoch, u.mb, u.feature, u.i)
 JOIN km v ON (k.batch, k.epoch, k.mb, k.feature, k.j) = (v.batch, v.epoch, v.mb, v.feature, v.i) JOIN ka ON (k.batch, k.epoch, k.mb, k.feature) = (ka.batch, ka.epoch, ka.mb, ka.feature))"""


_CELL = "s.batch = t.batch AND s.epoch = t.epoch AND s.mb = t.mb AND s.i = t.i AND s.j = t.j"


def _lars_sql(features: list[str]) -> str:
    """CTEs up to path(batch, step, feature, beta) and active(batch, rank, feature): two steps of the path, by hand, with M's columns of the two features that enter."""
    return f"""WITH {_lasso_sql(features)},
g AS (SELECT s.batch, s.feature, sum(s.k * t.k) AS g FROM c s JOIN c t ON {_CELL} WHERE s.feature <> 'y' AND t.feature = 'y' GROUP BY ALL),
f1 AS (SELECT batch, arg_max(feature, g) AS f, max(g) AS g1 FROM g GROUP BY batch),
m1 AS (SELECT s.batch, t.feature, sum(s.k * t.k) AS m FROM (SELECT c.* FROM c JOIN f1 ON c.batch = f1.batch AND c.feature = f1.f) s JOIN c t ON {_CELL} WHERE t.feature <> 'y' GROUP BY ALL),
d1 AS (SELECT m1.batch, m1.m AS m11 FROM m1 JOIN f1 ON m1.batch = f1.batch AND m1.feature = f1.f),
a1 AS (SELECT g.batch, g.feature, g.g, m1.m, m11, g1, f, (g1 - g.g) / (1.0 - m1.m / m11) AS step FROM g JOIN m1 USING (batch, feature) JOIN d1 USING (batch) JOIN f1 USING (batch)),
b1 AS (SELECT batch, least(any_value(g1), coalesce(min(step) FILTER (feature <> f AND step > 1e-12), any_value(g1))) / any_value(m11) AS b FROM a1 GROUP BY batch),
c1 AS (SELECT a1.*, g - m * b AS c, b FROM a1 JOIN b1 USING (batch)),
f2 AS (SELECT batch, arg_max(feature, c) AS f2 FROM c1 WHERE feature <> f GROUP BY batch),
m2 AS (SELECT s.batch, t.feature, sum(s.k * t.k) AS m2 FROM (SELECT c.* FROM c JOIN f2 ON c.batch = f2.batch AND c.feature = f2.f2) s JOIN c t ON {_CELL} WHERE t.feature <> 'y' GROUP BY ALL),
d2 AS (SELECT f2.batch, f2, m2.m2 AS m22, c1.m AS m12 FROM f2 JOIN m2 ON m2.batch = f2.batch AND m2.feature = f2.f2 JOIN c1 ON c1.batch = f2.batch AND c1.feature = f2.f2),
w AS (SELECT d2.*, m11, (m22 - m12) / (m11 * m22 - m12 * m12) AS w1, (m11 - m12) / (m11 * m22 - m12 * m12) AS w2 FROM d2 JOIN d1 USING (batch)),
a2 AS (SELECT c1.batch, c1.feature, c1.f, w.f2, c1.b, w1, w2, l.c AS lead, (l.c - c1.c) / (1.0 - (c1.m * w1 + m2.m2 * w2)) AS step
       FROM c1 JOIN m2 USING (batch, feature) JOIN w USING (batch) JOIN c1 l ON l.batch = c1.batch AND l.feature = c1.f),
s2 AS (SELECT batch, any_value(f) AS f, any_value(f2) AS f2, any_value(b) AS b, any_value(w1) AS w1, any_value(w2) AS w2,
              least(any_value(lead), coalesce(min(step) FILTER (feature <> f AND feature <> f2 AND step > 1e-12), any_value(lead))) AS step FROM a2 GROUP BY batch),
path AS (SELECT g.batch, n AS step, g.feature, CASE WHEN g.feature = f THEN b + n * s2.step * w1 WHEN g.feature = f2 THEN n * s2.step * w2 ELSE 0.0 END AS beta FROM g JOIN s2 USING (batch), range(2) x(n)),
active AS (SELECT batch, 0::BIGINT AS rank, f AS feature FROM s2 UNION ALL SELECT batch, 1, f2 FROM s2),
mean AS (SELECT feature, avg(beta) AS beta FROM path WHERE step = 1 GROUP BY feature),
ranked AS (SELECT row_number() OVER (ORDER BY beta DESC, feature) AS rank, feature, beta FROM mean WHERE beta / (SELECT max(beta) FROM mean) > 0.05)"""


def _prefix_sets(names: list[str], permutations: int, seed: int) -> list[tuple[str, ...]]:
    """The sets of features that a search's first round scores."""
    n = len(names)
    orders = search.haar_permutations(n, min(max(1, permutations // n), max(1, 2**n // n)), seed)
    return sorted({tuple(sorted(names[i] for i in p[:k])) for p in orders for k in range(1, n + 1)})


def _search_sql(names: list[str], permutations: int, seed: int, target: str, source: str, rounds: int = 1) -> str:
    """The search by adjusted MI with add_back over its listed prefixes; a second round takes any set of what the first leaves (of two features at most)."""
    listed = _prefix_sets(names, permutations, seed)
    every = [tuple(sorted(n for k, n in enumerate(names) if i >> k & 1)) for i in range(1, 2 ** len(names))]
    sets = {str(i): list(s) for i, s in enumerate(every)}
    members = ", ".join(f"('{i}', '{f}')" for i, s in sets.items() for f in s)
    first = ", ".join(f"'{i}'" for i, s in enumerate(every) if s in listed)
    alone = ", ".join(f"'{i}'" for i, s in enumerate(every) if len(s) == 1)
    second = f"SELECT arg_max(feature, ami) AS id, max(ami) AS v FROM ami WHERE feature NOT IN (SELECT id FROM e WHERE f IN (SELECT f FROM e JOIN best USING (id))) HAVING max(ami) >= 0.05 * (SELECT v FROM best) AND max(ami) > 0"
    return f"""{_pairs_sql(sets, target, source)}, {_MI},
e(id, f) AS (VALUES {members}), best AS (SELECT arg_max(feature, ami) AS id, max(ami) AS v FROM ami WHERE feature IN ({first})),
next AS ({second if rounds > 1 else "SELECT * FROM best WHERE false"}), picked AS (SELECT * FROM best WHERE v > 0 UNION ALL SELECT * FROM next)
SELECT DISTINCT f AS feature FROM e WHERE id IN (SELECT id FROM picked) OR id IN (SELECT feature FROM ami WHERE feature IN ({alone}) AND ami > 0.05 * (SELECT max(v) FROM picked))"""


_LEVELS = ", ".join(repr(0.1 + 0.8 * i / 9) for i in range(10))
_DIGAMMA = "h AS (SELECT i, sum(1.0 / i) OVER (ORDER BY i) - 1.0 / i - 0.5772156649015329 AS psi FROM range(1, (SELECT count(*) + 2 FROM embeddings)) r(i))"
_KSG = f"""y AS (SELECT id, e3, e17, e40, e3 - e17 AS y FROM x),
l AS ({" UNION ALL ".join(f"SELECT '{e}' AS feature, id, {e} AS x, y FROM y" for e in E)}),
d AS (SELECT a.feature, a.id, b.id AS j, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS dz FROM l a JOIN l b ON a.feature = b.feature),
r AS (SELECT feature, id, dz AS radius FROM (SELECT *, row_number() OVER (PARTITION BY feature, id ORDER BY dz, j) AS rn FROM d WHERE j <> id) WHERE rn = 3),
n AS (SELECT d.feature, d.id, count(*) FILTER (dx < radius) AS nx, count(*) FILTER (dy < radius) AS ny FROM d JOIN r ON d.feature = r.feature AND d.id = r.id GROUP BY ALL),
k AS (SELECT n.feature, greatest(0, (SELECT psi FROM h WHERE i = (SELECT count(*) FROM x)) + (SELECT psi FROM h WHERE i = 3) - avg(p.psi + q.psi)) AS mi
      FROM n JOIN h p ON p.i = greatest(nx, 1) JOIN h q ON q.i = greatest(ny, 1) GROUP BY n.feature)"""
_ROSS = f"""y AS (SELECT id, e3, e17, e40, (e3 > e17)::INT AS y FROM x),
l AS ({" UNION ALL ".join(f"SELECT '{e}' AS feature, id, {e} AS x, y FROM y" for e in E)}),
d AS (SELECT a.feature, a.id, b.id AS j, a.y = b.y AS same, abs(a.x - b.x) AS dx FROM l a JOIN l b ON a.feature = b.feature),
r AS (SELECT feature, id, dx AS radius FROM (SELECT *, row_number() OVER (PARTITION BY feature, id ORDER BY dx, j) AS rn FROM d WHERE same AND j <> id) WHERE rn = 3),
n AS (SELECT d.feature, d.id, count(*) FILTER (same) AS c, count(*) FILTER (dx <= radius) - 1 AS m FROM d JOIN r ON d.feature = r.feature AND d.id = r.id GROUP BY ALL),
k AS (SELECT n.feature, greatest(0, (SELECT psi FROM h WHERE i = (SELECT count(*) FROM x)) + (SELECT psi FROM h WHERE i = 3) - avg(p.psi) - avg(q.psi)) AS mi
      FROM n JOIN h p ON p.i = c JOIN h q ON q.i = greatest(m, 1) GROUP BY n.feature)"""
_HSIC = """s AS (SELECT i, sum(k) AS k, sum(l) AS l, sum(k * l) AS kl FROM g GROUP BY i)
SELECT round((sum(kl) - 2.0 / count(*) * sum(k * l) + sum(k) * sum(l) / (count(*)::DOUBLE * count(*))) / (count(*)::DOUBLE * count(*)), 8) + 0.0 AS hsic FROM s"""


def _delta_pairs(a: list[str], b: list[str], by: str = "") -> str:
    key, comma, using = by, f"{by}, " if by else "", f"{by}, " if by else ""
    ca, cb = f"concat_ws('|', {', '.join(a)})", f"concat_ws('|', {', '.join(b)})"
    group = f"GROUP BY {key}" if by else ""
    return f"""SELECT {comma}sum(nab * nab / (na * nb::DOUBLE)) - 1.0 AS product FROM (SELECT {comma}{ca} AS a, {cb} AS b, count(*) AS nab FROM @ GROUP BY ALL)
 JOIN (SELECT {comma}{ca} AS a, count(*) AS na FROM @ GROUP BY ALL) USING ({using}a) JOIN (SELECT {comma}{cb} AS b, count(*) AS nb FROM @ GROUP BY ALL) USING ({using}b) {group}"""


def oracle_sql() -> dict[str, str]:
    xm, om = f"WITH {X_SQL}, {_mb_sql('x')}, {X_LONG}, {RBF_SQL}", f"WITH {O_SQL}, {_mb_sql('o')}, {O_LONG}"
    delta = "g AS (SELECT a.mb, a.feature, a.i, b.i AS j, {k} AS k FROM (SELECT *, count(*) OVER (PARTITION BY mb, feature, x) AS n FROM l) a JOIN l b ON a.mb = b.mb AND a.feature = b.feature AND a.x = b.x)"
    square = " + ".join(f"(a.{e} - b.{e}) * (a.{e} - b.{e})" for e in E)
    prefix = " UNION ALL ".join(f"SELECT a.mb, {n} AS prefix, a.id AS i, b.id AS j, round(exp(-({' + '.join(f'(a.{e} - b.{e}) * (a.{e} - b.{e})' for e in E[:n])}) / {2.0 * n}), 6) + 0.0 AS k FROM m a JOIN m b ON a.mb = b.mb" for n in (1, 2, 3))
    joint = lambda cols, extra="": f"SELECT a.mb{extra}, a.id AS i, b.id AS j, round(1.0 / a.same, 6) + 0.0 AS k FROM (SELECT *, count(*) OVER (PARTITION BY mb, {', '.join(cols)}) AS same FROM m) a JOIN m b ON a.mb = b.mb AND {' AND '.join(f'a.{c} = b.{c}' for c in cols)}"
    events = f"SELECT event_id, row_number() OVER (ORDER BY {hash_order_sql('event_id')}, event_id) - 1 AS pos, count(*) OVER () AS n FROM events"
    names = ["status", "priority", "segment", "nation"]
    info_of = lambda sets: f"WITH {O_SQL}, {_pairs_sql(sets, 'nation')}, {_MI}"
    planted_y = _pairs_sql(ONE, "status + priority")
    lars, lars_e = _lars_sql(PLANTED), _lars_sql(list(E))
    by_set = " UNION ALL ".join(
        f"SELECT '{','.join(s)}' AS fs, a.id AS i, exp(-({' + '.join(f'(a.{e} - b.{e}) ** 2' for e in s)}) / {2.0 * len(s)}) AS k, CASE WHEN a.y = b.y THEN 1.0 / a.n ELSE 0 END::DOUBLE AS l FROM y a CROSS JOIN y b"
        for s in _prefix_sets(list(E), 1, 3)
    )
    return {
        "standardise": f"WITH {O_SQL} SELECT id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / (1e-9 + stddev_pop({c}) OVER ()), 6) + 0.0 AS {c}" for c in ("o_totalprice", "c_acctbal")) + " FROM o",
        "split_by_type": "SELECT * FROM (VALUES ('id', 'discrete'), ('o_totalprice', 'continuous'), ('c_acctbal', 'continuous'), ('o_orderstatus', 'ignored'), ('o_orderpriority', 'ignored'), ('c_mktsegment', 'ignored'), ('c_nationkey', 'discrete'), ('status', 'discrete'), ('priority', 'discrete'), ('segment', 'discrete'), ('nation', 'discrete')) v(feature, kind)",
        "batch_assign": f"WITH p AS ({events}) SELECT event_id, pos // least(300, n) AS batch FROM p WHERE pos // least(300, n) < n // least(300, n)",
        "epoch_replicate": " UNION ALL ".join(f"SELECT event_id, row_number() OVER (ORDER BY {hash_order_sql('event_id', e)}, event_id) - 1 AS pos, {e} AS epoch FROM events" for e in (0, 1)),
        "discretise": f"""WITH q AS (SELECT unnest(quantile_cont(l_extendedprice, [{_LEVELS}])) AS q, min(l_extendedprice) AS low FROM lineitem),
c AS (SELECT DISTINCT q FROM q WHERE q > low), b AS (SELECT l_extendedprice AS x, (SELECT count(*) FROM c WHERE l_extendedprice > c.q) AS bin FROM lineitem)
SELECT bin, count(*) AS n, min(x) AS low, max(x) AS high FROM b GROUP BY bin""",
        "prefix_encode": f"""WITH {O_SQL}, g AS (SELECT status, priority, nation, count(*) AS n FROM o GROUP BY ALL)
SELECT *, dense_rank() OVER (ORDER BY status) - 1 AS code_1, dense_rank() OVER (ORDER BY status, priority) - 1 AS code_2, dense_rank() OVER (ORDER BY status, priority, nation) - 1 AS code_3 FROM g""",
        "rbf_gram": f"{xm} SELECT mb, feature, i, j, round(k, 6) + 0.0 AS k FROM g",
        "rbf_gram_joint": f"WITH {X_SQL}, {_mb_sql('x')} SELECT a.mb, a.id AS i, b.id AS j, round(exp(-({square}) / {2 * 1.5 * 1.5}), 6) + 0.0 AS k FROM m a JOIN m b ON a.mb = b.mb",
        "rbf_gram_prefix": f"WITH {X_SQL}, {_mb_sql('x')} {prefix}",
        "delta_gram": f"{om}, {delta.format(k='1.0 / a.n')} SELECT mb, feature, i, j, round(k, 6) + 0.0 AS k FROM g",
        "delta_raw": f"{om}, {delta.format(k='1.0::DOUBLE')} SELECT * FROM g",
        "delta_gram_joint": f"WITH {O_SQL}, {_mb_sql('o')} {joint(['status', 'priority', 'nation'])}",
        "delta_gram_prefix": f"WITH {O_SQL}, {_mb_sql('o')} {joint(['nation'], ', 1 AS prefix')} UNION ALL {joint(['nation', 'priority'], ', 2 AS prefix')}",
        "mixed_gram": f"""WITH {X_SQL}, {_mb_sql('x')} SELECT a.mb, 'e3' AS feature, a.id AS i, b.id AS j, round(exp(-(a.e3 - b.e3) * (a.e3 - b.e3) / 2.0), 6) + 0.0 AS k FROM m a JOIN m b ON a.mb = b.mb
UNION ALL {joint(['label'], ", 'label'")}""",
        "center_gram": f"{xm}, {CENTRED} SELECT mb, feature, i, j, round(k, 5) + 0.0 AS k FROM c",
        "gram_frobenius": f"{xm}, {CENTRED} SELECT mb, feature, i, j, round(k / (sqrt(sum(k * k) OVER (PARTITION BY mb, feature)) + 1e-9), 5) + 0.0 AS k FROM c",
        "hsic_b_rbf": f"WITH {X_SQL}, g AS (SELECT a.id AS i, exp(-((a.e3 - b.e3) ** 2 + (a.e17 - b.e17) ** 2) / 4.0) AS k, exp(-((a.e40 - b.e40) ** 2) / 2.0) AS l FROM x a CROSS JOIN x b), {_HSIC}",
        "hsic_b_mixed": f"WITH {X_SQL}, c AS (SELECT label, count(*) AS n FROM x GROUP BY label), g AS (SELECT a.id AS i, exp(-((a.e3 - b.e3) ** 2) / 2.0) AS k, CASE WHEN a.label = b.label THEN 1.0 / c.n ELSE 0 END::DOUBLE AS l FROM x a JOIN c ON a.label = c.label CROSS JOIN x b), {_HSIC}",
        "hsic_b_delta": f"WITH {O_SQL} SELECT round(product / ((SELECT count(*) FROM o)::DOUBLE * (SELECT count(*) FROM o)), 10) + 0.0 AS hsic FROM ({_delta_pairs(['status', 'nation'], ['priority']).replace('@', 'o')})",
        "hsic_matrix": f"WITH {O_SQL}, {_mb_sql('o', 500)} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum(product), 5) + 0.0 AS v FROM ({_delta_pairs([a], [b], 'mb').replace('@', 'm')})" for i, a in enumerate(names) for b in names[i:]),
        "hsic_vector": f"""WITH {X_SQL}, {_mb_sql('x', 100, 1)}, {X_LONG}, {RBF_SQL}, {CENTRED}, y AS (SELECT mb, id, label, count(*) OVER (PARTITION BY mb, label) AS same FROM m)
SELECT feature, round(sum(k / y.same), 5) + 0.0 AS v FROM c JOIN y ON c.mb = y.mb AND c.i = y.id JOIN y z ON c.mb = z.mb AND c.j = z.id AND y.label = z.label GROUP BY feature""",
        "knn_mi_classif": f"WITH {X_SQL}, {_DIGAMMA}, {_ROSS} SELECT feature, round(mi, 6) + 0.0 AS mi FROM k",
        "mutual_info": f"{info_of(ONE)} SELECT feature, round(mi, 6) + 0.0 AS mi, round(hu, 6) + 0.0 AS hu, round(hv, 6) + 0.0 AS hv FROM mi JOIN hu USING (feature) JOIN hv USING (feature)",
        "expected_mi": f"{info_of(ONE)} SELECT feature, round(emi, 6) + 0.0 AS emi FROM emi",
        "ami_features": f"{info_of(ONE)} SELECT feature, round(ami, 6) + 0.0 AS ami FROM ami",
        "ami_prefix": f"{info_of(PREFIX)} SELECT feature, round(ami, 6) + 0.0 AS ami FROM ami",
        "featurewise_ami_select": f"WITH {O_SQL}, {planted_y}, {_MI} SELECT feature FROM ami WHERE ami > 0.05",
        "knn_mi_regression": f"WITH {X_SQL}, {_DIGAMMA}, {_KSG} SELECT feature, round(mi, 6) + 0.0 AS mi FROM k",
        "mi_preselect": f"WITH {X_SQL}, {_DIGAMMA}, {_KSG} SELECT feature, round(mi / max(mi) OVER (), 5) + 0.0 AS total, mi / max(mi) OVER () > 0.3 AS kept FROM k",
        "hsic_lasso_matrix": f"""WITH {_lasso_sql(list(E), False)} SELECT s.batch, s.feature AS a, t.feature AS b, round(sum(s.k * t.k), 4) + 0.0 AS v
FROM c s JOIN c t ON {_CELL} WHERE s.feature <> 'y' AND (t.feature = 'y' OR array_position({list(E)}, t.feature) >= array_position({list(E)}, s.feature)) GROUP BY ALL""",
        "nlars_path": f"{lars} SELECT batch, step, feature, round(beta, 6) + 0.0 AS beta FROM path",
        "nlars_active": f"{lars} SELECT batch, rank, feature FROM active",
        "projection_matrix": f"{lars} SELECT rank, feature, count(*) / (SELECT count(DISTINCT batch) FROM active)::DOUBLE AS weight FROM active GROUP BY rank, feature",
        "select_k": f"{lars} SELECT feature FROM active GROUP BY feature ORDER BY count(*) DESC, substr(feature, 2)::INT DESC LIMIT 2",
        "selector_select": f"{lars} SELECT feature FROM active GROUP BY feature ORDER BY count(*) DESC, substr(feature, 2)::INT DESC LIMIT 2",
        "hsic_lasso_rank": f"{lars} SELECT rank, feature, round(beta, 6) + 0.0 AS beta FROM ranked",
        "select": f"{lars_e} SELECT rank, feature FROM ranked",
        "ami_search": f"WITH {O_SQL}, {_search_sql(names, 1, 3, 'status * 10 + priority', 'o')}",
        "categorical_select": f"""WITH {O_SQL}, q AS (SELECT unnest(quantile_cont(status * 10.0::DOUBLE + priority, [{_LEVELS}])) AS q, min(status * 10.0::DOUBLE + priority) AS low FROM o), cut AS (SELECT DISTINCT q FROM q WHERE q > low),
oy AS (SELECT *, (SELECT count(*) FROM cut WHERE status * 10.0::DOUBLE + priority > cut.q) AS y FROM o), {_search_sql(names[:3], 1, 3, 'y', 'oy', 2)}""",
        "hsic_search": f"""WITH {X_SQL}, y AS (SELECT *, (e3 > e17)::INT AS y, count(*) OVER (PARTITION BY e3 > e17) AS n FROM x), g AS ({by_set}),
s AS (SELECT fs, i, sum(k) AS k, sum(l) AS l, sum(k * l) AS kl FROM g GROUP BY fs, i),
h AS (SELECT fs, sum(kl) - 2.0 / count(*) * sum(k * l) + sum(k) * sum(l) / (count(*)::DOUBLE * count(*)) AS h FROM s GROUP BY fs)
SELECT unnest(string_split(arg_max(fs, h), ',')) AS feature FROM h""",
        "lasso_path_mean": f"WITH {PATH_SQL}, {MEAN_SQL} SELECT step, feature, round(beta, 6) + 0.0 AS beta FROM mp",
        "regularization_curve": f"WITH {PATH_SQL}, {MEAN_SQL}, z AS (SELECT * FROM mp WHERE step = (SELECT max(step) FROM mp)) SELECT row_number() OVER (ORDER BY beta DESC, feature) AS rank, feature, round(beta, 6) + 0.0 AS beta, round(sum(beta) OVER (ORDER BY beta DESC, feature), 6) + 0.0 AS curve FROM z",
        "select_threshold": f"WITH {PATH_SQL}, {MEAN_SQL}, z AS (SELECT * FROM mp WHERE step = (SELECT max(step) FROM mp)) SELECT row_number() OVER (ORDER BY beta DESC, feature) AS rank, feature, round(beta, 6) + 0.0 AS beta FROM z WHERE beta / (SELECT max(beta) FROM z) > 0.01",
    }
