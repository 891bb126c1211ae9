"""Kernel (Gram) matrices in long form, and their centring.

A row is (mb, feature, i, j, k): entry (i, j) of the Gram matrix of a feature within a
minibatch. Pairs come from an equi-join on the minibatch, whose size bounds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of rows that one task makes.
PAIRS = 1 << 19


def long_form(df: DataFrame, features: list[str], id_col: str = "id", mb: str = "mb", cast: str = "double") -> DataFrame:
    """(mb, i, feature, x) of each feature."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast(cast).alias("x")) for f in features])
    return df.select(F.col(mb).alias("mb"), F.col(id_col).alias("i"), F.explode(pairs).alias("p")).select("mb", "i", "p.*")


def _paired(a: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pairs of rows of equal keys, in tasks of PAIRS pairs or so: by the rows before the join, far fewer, Spark would deal them to too few."""
    pairs = a.groupBy(*keys).count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
    a = a.repartition(max(1, -(-pairs // PAIRS)), *keys)
    b = a.select(*keys, F.col("i").alias("j"), F.col(value).alias("_other"))
    return a.join(b, keys)


def rbf_gram(x: DataFrame, scale: float = 1.0) -> DataFrame:
    """exp(-(x_i - x_j)^2 / (2 scale^2)) of long-form features."""
    d = F.col("x") - F.col("_other")
    return _paired(x, ["mb", "feature"], "x").select("mb", "feature", "i", "j", F.exp(-(d * d) / (2.0 * scale * scale)).alias("k"))


def _square(a, b):
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def rbf_gram_joint(df: DataFrame, features: list[str], scale: float, id_col: str = "id", mb: str = "mb") -> DataFrame:
    """One Gram matrix of all features together."""
    v = df.select(F.col(mb).alias("mb"), F.col(id_col).alias("i"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    return _paired(v, ["mb"], "x").select("mb", "i", "j", F.exp(-_square(F.col("x"), F.col("_other")) / (2.0 * scale * scale)).alias("k"))


def rbf_gram_prefix(df: DataFrame, features: list[str], id_col: str = "id", mb: str = "mb") -> DataFrame:
    """The joint Gram matrix of each prefix of the features, the n-th with scale sqrt(n): distances are a running sum."""
    v = df.select(F.col(mb).alias("mb"), F.col(id_col).alias("i"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    pairs = _paired(v, ["mb"], "x").select("mb", "i", "j", F.zip_with("x", "_other", lambda p, q: (p - q) * (p - q)).alias("d"))
    prefix = F.transform(F.sequence(F.lit(1), F.lit(len(features))), lambda n: F.struct(n.alias("prefix"), F.aggregate(F.slice(F.col("d"), F.lit(1), n), F.lit(0.0), lambda s, x: s + x).alias("s")))
    return pairs.select("mb", "i", "j", F.explode(prefix).alias("p")).select("mb", "p.prefix", "i", "j", F.exp(-F.col("p.s") / (2.0 * F.col("p.prefix"))).alias("k"))


def delta_gram(x: DataFrame, form: str = "mean") -> DataFrame:
    """Entries of equal values only: 1/count (mean), or 1 (raw). Counts are within the minibatch."""
    n = F.count("*").over(Window.partitionBy("mb", "feature", "x"))
    k = 1.0 / F.col("n") if form == "mean" else F.lit(1.0)
    return _paired(x.withColumn("n", n), ["mb", "feature", "x"], "n").select("mb", "feature", "i", "j", k.alias("k"))


def delta_gram_joint(df: DataFrame, features: list[str], id_col: str = "id", mb: str = "mb") -> DataFrame:
    """Delta Gram matrix of the tuple of features: the tuple itself is the key, so no two tuples are confused."""
    v = df.select(F.col(mb).alias("mb"), F.lit("joint").alias("feature"), F.col(id_col).alias("i"), F.struct(*features).alias("x"))
    return delta_gram(v).drop("feature")


def delta_gram_prefix(df: DataFrame, features: list[str], id_col: str = "id", mb: str = "mb") -> DataFrame:
    out = None
    for n in range(1, len(features) + 1):
        one = delta_gram_joint(df, features[:n], id_col, mb).select("mb", F.lit(n).alias("prefix"), "i", "j", "k")
        out = one if out is None else out.unionByName(one)
    return out


def prefix_gram(df: DataFrame, features: list[str], kernel: str, id_col: str = "id", mb: str = "mb") -> DataFrame:
    """(mb, prefix, i, j, k) of each prefix of the features by the kernel named: rbf or delta."""
    if kernel not in ("rbf", "delta"):
        raise ValueError(f"no kernel {kernel!r}")
    return (rbf_gram_prefix if kernel == "rbf" else delta_gram_prefix)(df, features, id_col, mb)


def mixed_gram(df: DataFrame, discrete: list[str], continuous: list[str], id_col: str = "id", mb: str = "mb") -> DataFrame:
    """Delta kernels of the discrete and RBF kernels of the continuous features."""
    return delta_gram(long_form(df, discrete, id_col, mb, "long")).unionByName(rbf_gram(long_form(df, continuous, id_col, mb)))


def center_gram(g: DataFrame) -> DataFrame:
    """k less its row's and column's means plus the mean, of full Gram matrices."""
    mean = lambda *by: F.avg("k").over(Window.partitionBy("mb", "feature", *by))
    return g.select("mb", "feature", "i", "j", (F.col("k") - mean("i") - mean("j") + mean()).alias("k"))


def frobenius_gram(g: DataFrame) -> DataFrame:
    """Centred Gram matrices divided by their Frobenius norm."""
    norm = F.sqrt(F.sum(F.col("k") * F.col("k")).over(Window.partitionBy("mb", "feature"))) + 1e-9
    return center_gram(g).withColumn("k", F.col("k") / norm)
