"""HSIC: the dependence of kernels, from sums over pairs or from contingency counts.

For centred Gram matrices <HKH, HLH> = sum K.L - 2/n sum_i r_i s_i + (sum K)(sum L)/n^2, r and
s being row sums: additive over blocks of pairs. Gaussian kernels of few columns are products of a few
features instead, whose sums are additive over rows. Between two delta kernels it is chi^2/n of the
contingency table; no pair is formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .info import label_pairs
from .sampling import assign_batches

RBF, DELTA = "rbf", "delta"
STRIP_BYTES = 64 << 20
#: How many sums of products of features a task may hold.
SERIES = 1 << 18


def delta_product(df: DataFrame, a: list[str], b: list[str], by: list[str] = ()) -> DataFrame:
    """<HK_aH, HK_bH> of the delta kernels of two tuples of columns: sum n_ab^2/(n_a n_b) - 1, for each group."""
    ab = df.groupBy(*by, F.struct(*a).alias("a"), F.struct(*b).alias("b")).agg(F.count("*").alias("nab"))
    na = ab.groupBy(*by, "a").agg(F.sum("nab").alias("na"))
    nb = ab.groupBy(*by, "b").agg(F.sum("nab").alias("nb"))
    terms = ab.join(na, [*by, "a"]).join(nb, [*by, "b"])
    return terms.groupBy(*by).agg((F.sum(F.col("nab") * F.col("nab") / (F.col("na") * F.col("nb").cast("double"))) - 1.0).alias("product"))


def delta_matrix(df: DataFrame, features: list[str], by: list[str] = ()) -> DataFrame:
    """(*by, a, b, product): delta_product() of every pair of columns a <= b, from one scan."""
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("u"), F.col(b).cast("string").alias("v")) for i, a in enumerate(features) for b in features[i:]]
    cells = df.select(*by, F.explode(F.array(*each)).alias("p")).groupBy(*by, "p.a", "p.b", "p.u", "p.v").agg(F.count("*").alias("nab"))
    key = [*by, "a", "b"]
    na, nb = cells.groupBy(*key, "u").agg(F.sum("nab").alias("na")), cells.groupBy(*key, "v").agg(F.sum("nab").alias("nb"))
    terms = cells.join(na, [*key, "u"]).join(nb, [*key, "v"])
    return terms.groupBy(*key).agg((F.sum(F.col("nab") * F.col("nab") / (F.col("na") * F.col("nb").cast("double"))) - 1.0).alias("product"))


def gram(values: np.ndarray, kernel: str, scale: float, rows: slice = slice(None)) -> np.ndarray:
    """Rows of the Gram matrix of rows of values under one joint kernel."""
    if kernel == DELTA:
        _, code, n = np.unique(values, axis=0, return_inverse=True, return_counts=True)
        code = code.ravel()
        return (code[rows, None] == code[None, :]) / n[code][rows, None]
    d = 0.0
    for c in values.T:
        d = d + (c[rows, None] - c[None, :]) ** 2
    return np.exp(-d / (2.0 * scale * scale))


def products_of(columns: list[tuple[np.ndarray, str, float]]) -> np.ndarray:
    """All products <HK_aH, HK_bH> of the kernels of (values, kernel, scale), by strips of rows of the Gram matrices.

    A first pass over the strips finds the means that centre them.
    """
    n, d = len(columns[0][0]), len(columns)
    step = max(1, STRIP_BYTES // (8 * n * d))
    strips = [slice(i, i + step) for i in range(0, n, step)]
    means = np.empty((d, n))
    for rows in strips:
        for i, c in enumerate(columns):
            means[i, rows] = gram(*c, rows).mean(axis=1)
    m = np.zeros((d, d))
    for rows in strips:
        phi = np.empty((d, len(range(*rows.indices(n))), n))
        for i, c in enumerate(columns):
            phi[i] = gram(*c, rows) - means[i, rows, None] - means[i][None, :] + means[i].mean()
        phi = phi.reshape(d, -1)
        m += phi @ phi.T
    return m


def _blocked(df: DataFrame, x: list[str], y: list[str], id_col: str, block: int) -> DataFrame:
    """(p, q, side, id, x, y): rows of each pair of blocks p <= q."""
    n = max(1, -(-df.count() // block))
    rows = df.select(F.col(id_col).alias("id"), F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("b"), F.array(*[F.col(c).cast("double") for c in x]).alias("x"), F.array(*[F.col(c).cast("double") for c in y]).alias("y"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return rows.select("*", other.alias("o")).select(F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "id", "x", "y")


def chains(sets: list[tuple[str, ...]]) -> list[list[int]]:
    """Positions of sets, dealt to chains in which each set holds the one before it."""
    out: list[list[int]] = []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        own = next((c for c in out if set(sets[c[-1]]) <= set(sets[i])), None)
        if own is None:
            out.append([i])
        else:
            own.append(i)
    return out


def _delta_b_sets(df: DataFrame, sets: list[tuple[str, ...]], y: list[str]) -> DataFrame:
    target = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(y)]), {"ignoreNullFields": "false"})
    cells = label_pairs(df.withColumn("_target", target), {str(i): list(s) for i, s in enumerate(sets)}, "_target")
    na, nb = cells.groupBy("feature", "u").agg(F.sum("n").alias("na")), cells.groupBy("feature", "v").agg(F.sum("n").alias("nb"))
    terms = cells.join(na, ["feature", "u"]).join(nb, ["feature", "v"])
    product, n = F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb").cast("double"))) - 1.0, F.sum("n")
    return terms.groupBy(F.col("feature").cast("int").alias("set")).agg((product / (n * n)).alias("hsic"))


def _degree(radius2: float) -> int:
    """Where a Gaussian kernel's series may end for points within that squared radius (in scales): what is left out of any entry is below 1e-17.

    That is the tail of a Poisson variable of that mean beyond the degree.
    """
    if not radius2:
        return 0
    m, log_p = 0, -radius2
    while m < radius2 or np.exp(log_p) * (m + 1) / (m + 1 - radius2) > 1e-17:
        m += 1
        log_p += np.log(radius2 / m)
    return m


def gaussian_features(u: np.ndarray, degree: int) -> np.ndarray:
    """Columns phi with phi(u).phi(w) = exp(-|u - w|^2 / 2) up to the degree's tail: exp(-|u|^2 / 2) u^a / sqrt(a!) for all powers a up to the degree."""
    phi, of = np.exp(-(u * u).sum(1) / 2)[:, None], np.zeros(1, int)
    k = np.arange(degree + 1)
    for c in u.T:
        powers = np.cumprod(np.concatenate([np.ones((len(c), 1)), c[:, None] / np.sqrt(k[None, 1:])], axis=1), axis=1)
        a, b = np.nonzero(of[:, None] + k[None, :] <= degree)
        phi, of = phi[:, a] * powers[:, b], of[a] + b
    return phi


def _by_series(df: DataFrame, sets: list[tuple[str, ...]], y: list[str], x_kernel: str, y_kernel: str) -> DataFrame | None:
    """hsic_b_sets() from sums of products of features, one pass and no pairs; None where a kernel has too many features.

    With K = P P' and L = Q Q', HSIC is |P'HQ|^2 / n^2. A delta kernel's features are its classes' indicators over the roots of their sizes.
    """
    real = lambda c: F.col(c) + F.lit(0.0) if df.schema[c].dataType.simpleString() in ("float", "double") else F.col(c)
    code = lambda cols: F.to_json(F.struct(*[real(c).alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"})
    columns = list(dict.fromkeys(c for s in sets for c in s))
    smooth = (columns if x_kernel == RBF else []) + (y if y_kernel == RBF else [])
    classes = [code(s).alias(f"k{i}") for i, s in enumerate(sets)] if x_kernel == DELTA else [code(y).alias("k")] if y_kernel == DELTA else []
    values = {c: f"v{i}" for i, c in enumerate(dict.fromkeys(smooth))}
    df = df.dropna(subset=[*(columns if x_kernel == DELTA else []), *(y if y_kernel == DELTA else [])]) if classes else df
    rows = df.select(*[F.col(c).cast("double").alias(v) for c, v in values.items()], *classes)
    keys = [c for c in rows.columns if c.startswith("k")]
    seen = rows.agg(*[f(v).alias(f"{n}_{v}") for v in values.values() for n, f in (("low", F.min), ("high", F.max))], *[F.approx_count_distinct(k).alias(k) for k in keys]).first()
    ends = {c: (seen[f"low_{v}"], seen[f"high_{v}"]) for c, v in values.items()}
    if not all(low is not None and np.isfinite(high - low) for low, high in ends.values()):
        return None

    def expansion(cols: tuple[str, ...]) -> tuple[list[str], np.ndarray, float, int]:
        degree = _degree(min(1e6, sum(((ends[c][1] - ends[c][0]) / 2) ** 2 for c in cols) / len(cols)))
        return [values[c] for c in cols], np.array([(ends[c][0] + ends[c][1]) / 2 for c in cols]), len(cols) ** 0.5, degree

    size = lambda e: math.comb(e[3] + len(e[0]), len(e[0]))
    of_y = expansion(tuple(y)) if y_kernel == RBF else None
    of_x = [expansion(s) for s in sets] if x_kernel == RBF else [None] * len(sets)
    widths = [(size(e) if e else seen[f"k{i}"]) * (size(of_y) if of_y else seen["k"]) for i, e in enumerate(of_x)]
    if sum(widths) > SERIES:
        return None
    chunk = max(64, STRIP_BYTES // 8 // max(map(size, [e for e in [*of_x, of_y] if e])))

    def features(pdf: pd.DataFrame, e: tuple) -> np.ndarray:
        phi = gaussian_features((pdf[e[0]].to_numpy() - e[1]) / e[2], e[3])
        return np.concatenate([np.ones((len(phi), 1)), phi], axis=1)

    def sums(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, str], np.ndarray] = {}
        for whole in pdfs:
            for at in range(0, len(whole), chunk):
                pdf = whole.iloc[at : at + chunk]
                q = features(pdf, of_y) if of_y else None
                for i, e in enumerate(of_x):
                    p = features(pdf, e) if e else q
                    if e and of_y:
                        names, part = ["", *map(str, range(1, q.shape[1]))], q.T @ p
                    else:
                        names, which = np.unique(pdf[f"k{i}" if of_y else "k"].to_numpy(), return_inverse=True)
                        order = np.argsort(which, kind="stable")
                        part = np.add.reduceat(p[order], np.searchsorted(which[order], np.arange(len(names))), axis=0)
                        names, part = ["", *names], np.concatenate([part.sum(0, keepdims=True), part])
                    for name, row in zip(names, part):
                        found[i, name] = found.get((i, name), 0.0) + row
        for (i, name), row in found.items():
            yield pd.DataFrame({"set": i, "key": name, "k": np.arange(len(row)), "v": row})

    over = lambda keep, *by: F.sum(F.when(keep, F.col("v"))).over(Window.partitionBy("set", *by))
    out = rows.mapInPandas(sums, "set int, key string, k int, v double").groupBy("set", "key", "k").agg(F.sum("v").alias("v"))
    out = out.withColumns({"of_k": over(F.col("key") == "", "k"), "of_key": over(F.col("k") == 0, "key"), "n": over((F.col("key") == "") & (F.col("k") == 0))})
    weight = F.lit(1.0) if x_kernel == y_kernel == RBF else F.col("of_key")
    gap = F.col("v") - F.col("of_k") * F.col("of_key") / F.col("n")
    return out.where("k > 0 AND key <> ''").groupBy("set").agg(F.sum(gap * gap / (weight * F.col("n") * F.col("n"))).alias("hsic"))


def hsic_b_sets(df: DataFrame, sets: list[tuple[str, ...]], y: list[str], id_col: str, x_kernel: str = RBF, y_kernel: str = RBF, block: int = 1000) -> DataFrame:
    """(set, hsic) for each position in sets: biased HSIC trace(KHLH)/n^2 of its columns with y over the whole table, in one plan.

    Scales are the square roots of the numbers of columns. Two delta kernels use counts. Gaussian kernels are
    summed by their series, to double precision, where SERIES sums of products are enough for it: time in proportion to the rows.
    Otherwise (many columns, or values far apart in scales) pairs of blocks are tasks of block^2 pairs, which meet each set in turn: sets
    that hold another one go on from its distances. They give row sums, which meet by row. An empty table gives no row.
    """
    if x_kernel == y_kernel == DELTA:
        return _delta_b_sets(df, sets, y)
    ship(df.sparkSession)
    found = _by_series(df, sets, y, x_kernel, y_kernel)
    if found is not None:
        return found
    columns = list(dict.fromkeys(c for s in sets for c in s))
    at = [[columns.index(c) for c in s] for s in sets]
    order, kind = chains(sets), df.schema[id_col].dataType.simpleString()
    counts = []
    for i, s in enumerate(sets if x_kernel == DELTA else ()):
        counts.append(f"_n{i}")
        df = df.join(df.groupBy(*s).agg(F.count("*").alias(f"_n{i}")), list(s))
    if y_kernel == DELTA:
        df = df.join(df.groupBy(*y).agg(F.count("*").alias("_ny")), list(y))
    rows = _blocked(df, [*columns, *counts], [*y, *(["_ny"] if y_kernel == DELTA else [])], id_col, block)

    def kernel_of(d: np.ndarray, size: int, n: np.ndarray | None) -> np.ndarray:
        return np.exp(-d / (2.0 * size)) if n is None else (d == 0) / n[:, None]

    def apart(a: np.ndarray, b: np.ndarray, which: list[int]) -> np.ndarray:
        d = np.zeros((len(a), len(b)))
        for c in which:
            d += (a[:, c, None] - b[None, :, c]) ** 2
        return d

    def terms(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        left, right = pdf[pdf["b"] == p], pdf[pdf["b"] == q]
        if left.empty or right.empty:
            none = np.empty(0)
            return pd.DataFrame({"set": np.empty(0, np.int32), "id": pdf["id"].iloc[:0], "k": none, "l": none, "kl": none})
        xa, ya, xb, yb = (np.stack(rows[c].to_numpy()) for rows, c in ((left, "x"), (left, "y"), (right, "x"), (right, "y")))
        m = kernel_of(apart(ya, yb, list(range(len(y)))), len(y), ya[:, -1] if y_kernel == DELTA else None)
        out = []
        for chain in order:
            d, known = np.zeros(m.shape), set()
            for i in chain:
                d += apart(xa, xb, [c for c in at[i] if c not in known])
                known |= set(at[i])
                k = kernel_of(d, len(at[i]), xa[:, len(columns) + i] if counts else None)
                for side, axis in ((left, 1), (right, 0))[: 1 if p == q else 2]:
                    out.append(pd.DataFrame({"set": np.int32(i), "id": side["id"].to_numpy(), "k": k.sum(axis), "l": m.sum(axis), "kl": (k * m).sum(axis)}))
        return pd.concat(out)

    sums = rows.groupBy("p", "q").applyInPandas(terms, f"set int, id {kind}, k double, l double, kl double")
    sums = sums.groupBy("set", "id").agg(F.sum("k").alias("k"), F.sum("l").alias("l"), F.sum("kl").alias("kl"))
    n = F.count("*").cast("double")
    trace = F.sum("kl") - 2.0 / n * F.sum(F.col("k") * F.col("l")) + F.sum("k") * F.sum("l") / (n * n)
    return sums.groupBy("set").agg((trace / (n * n)).alias("hsic"))


def hsic_b(df: DataFrame, x: list[str], y: list[str], id_col: str, x_kernel: str = RBF, y_kernel: str = RBF, block: int = 1000) -> DataFrame:
    """One row ``hsic``: hsic_b_sets() of one set of columns; null for an empty table."""
    if x_kernel == y_kernel == DELTA:
        return delta_product(df, x, y).crossJoin(F.broadcast(df.agg(F.count("*").alias("n")))).select((F.col("product") / (F.col("n") * F.col("n"))).alias("hsic"))
    return hsic_b_sets(df, [tuple(x)], y, id_col, x_kernel, y_kernel, block).agg(F.first("hsic").alias("hsic"))


def hsic_statistics(df: DataFrame, features: list[str], target: list[str], kernels: dict[str, str], y_kernel: str, id_col: str, batch: int, minibatch: int, epochs: int, seed: int = 0) -> DataFrame:
    """(batch, a, b, v): sums over minibatches of <HK_aH, HK_bH>; b = -1 is the target. Features are standardised already.

    The only tables that grow are the rows, once an epoch, and d*(d+3)/2 sums a minibatch, added up map-side.
    A minibatch' Gram matrices are worked out in strips of STRIP_BYTES, never all at once.
    """
    ship(df.sparkSession)
    outer = assign_batches(df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, *target])]), "id", batch, seed=seed)
    parts = None
    for e in range(epochs):
        one = assign_batches(outer, "id", minibatch, "mb", e + 1, ["batch"], seed).withColumn("epoch", F.lit(e))
        parts = one if parts is None else parts.unionByName(one)
    y_scale, kinds = float(np.sqrt(len(target))), [kernels[f] for f in features]

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        d = len(features)
        columns = [(pdf[[f]].to_numpy(), kind, 1.0) for f, kind in zip(features, kinds)] + [(pdf[target].to_numpy(), y_kernel, y_scale)]
        m = products_of(columns)
        a, b = np.triu_indices(d + 1)
        keep = a < d
        a, b = a[keep], b[keep]
        return pd.DataFrame({"batch": pdf["batch"].iloc[0], "a": a, "b": np.where(b == d, -1, b), "v": m[a, b]})

    out = parts.groupBy("batch", "epoch", "mb").applyInPandas(products, "batch long, a int, b int, v double")
    return out.groupBy("batch", "a", "b").agg(F.sum("v").alias("v"))
