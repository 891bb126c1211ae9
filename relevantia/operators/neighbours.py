"""Distances to nearest neighbours and counts within them, over strips of a sorted table.

A strip is a range of the table's sorted distinct rows, of STRIP rows or so: what one task holds. A
point's neighbours are sought in its own strip first; only where they are farther than another strip's
bounding box does the point go there too. A count within a distance is the difference of two ranks, each of them looked up
in the one strip where the interval ends. Comparisons are those of |a - b| in double precision,
which grows with b, so that counts at the very edge of an interval are those of comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIP = 16384
_POINT = "f int, c double, x double, y double, m long"


def strips(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df, of so many rows at most, with ``strip``: its range in the order of the keys. It is kept, for ranges may differ if worked out again."""
    return df.repartitionByRange(max(1, -(-rows // STRIP)), *keys).withColumn("strip", F.spark_partition_id()).persist()


def smallest(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, r: np.ndarray, k: int, skip: int = 0) -> np.ndarray:
    """The k smallest Chebyshev distances of each query (qx, qy) to the points, after the ``skip`` smallest; those above r need not be found."""
    by_y = len(np.unique(py)) > len(np.unique(px))
    order = np.argsort(py if by_y else px)
    px, py = px[order], py[order]
    a, qa = (py, qy) if by_y else (px, qx)
    out = np.full((len(qx), k), np.inf)
    # Wider than r by more than rounding can lose.
    reach = r + 1e-12 * (np.abs(qa) + r)
    for own in np.array_split(np.argsort(qa), max(1, -(-len(qa) // 64))):
        lo, hi = np.searchsorted(a, (qa[own] - reach[own]).min(), "left"), np.searchsorted(a, (qa[own] + reach[own]).max(), "right")
        d = np.maximum(np.abs(px[None, lo:hi] - qx[own, None]), np.abs(py[None, lo:hi] - qy[own, None]))
        if d.shape[1] > k + skip:
            d = np.partition(d, k + skip - 1, axis=1)[:, : k + skip]
        d.sort(axis=1)
        out[own, : max(0, d.shape[1] - skip)] = d[:, skip:]
    return out


def _bound(px: np.ndarray, py: np.ndarray, k: int) -> np.ndarray:
    """Upper bounds of each point's distance to its k-th neighbour, from the points around it in one order."""
    order = np.argsort(py if len(np.unique(py)) > len(np.unique(px)) else px)
    x, y = px[order], py[order]
    best = np.full((k, len(x)), np.inf)

    def put(at: slice, d: np.ndarray) -> None:
        for row in best[:, at]:
            low = np.minimum(row, d)
            d = np.maximum(row, d)
            row[:] = low

    for step in range(1, min(k + 6, len(x))):
        d = np.maximum(np.abs(x[step:] - x[:-step]), np.abs(y[step:] - y[:-step]))
        put(slice(step, None), d)
        put(slice(0, -step), d)
    out = np.empty(len(x))
    out[order] = best[k - 1]
    return out


def _copies(pdf: pd.DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    times = np.minimum(pdf["m"].to_numpy(), most)
    return np.repeat(pdf["x"].to_numpy(), times), np.repeat(pdf["y"].to_numpy(), times)


def neighbour_distances(points: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(f, c, x, y, m, near), and what is kept for it: of each point the k smallest distances to others of its group (f, c), in order, infinite where there are fewer.

    ``points`` are strips() of distinct (f, c, x, y) in that order, of which m rows are equal. Distances are max(|dx|, |dy|).
    """
    boxes: dict[tuple, list] = {}
    corners = points.groupBy("f", "c", "strip").agg(*[g(v).alias(f"{n}_{v}") for v in "xy" for n, g in (("low", F.min), ("high", F.max))])
    # Only groups of several strips: twice as many rows as there are strips at most.
    several = points.groupBy("f", "c").agg(F.min("strip").alias("_a"), F.max("strip").alias("_b")).where("_a < _b").select("f", "c")
    for r in corners.join(several, ["f", "c"]).collect():
        boxes.setdefault((r["f"], r["c"]), []).append((r["strip"], r["low_x"], r["high_x"], r["low_y"], r["high_y"]))

    def inside(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(pdfs)
        if not whole:
            return
        whole = pd.concat(whole)
        for (f, c), pdf in whole.groupby(["f", "c"], sort=False):
            px, py = _copies(pdf, k + 1)
            x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
            first = np.cumsum(np.minimum(pdf["m"].to_numpy(), k + 1)) - 1
            near = smallest(px, py, x, y, _bound(px, py, k)[first], k, 1)
            ask: list[list[int]] = [[] for _ in x]
            for strip, x0, x1, y0, y1 in boxes.get((f, c), ()):
                if strip != pdf["strip"].iloc[0]:
                    gap = np.maximum(np.maximum(x0 - x, x - x1), np.maximum(y0 - y, y - y1))
                    for i in np.flatnonzero(np.maximum(gap, 0.0) < near[:, -1]):
                        ask[i].append(strip)
            yield pdf[["f", "c", "x", "y", "m"]].assign(near=list(near), ask=ask)

    def there(asking: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or pdf.empty:
            return pd.DataFrame({n: pd.Series(dtype=object) for n in ("f", "c", "x", "y", "m", "near")})
        near = smallest(*_copies(pdf, k), *(asking[n].to_numpy() for n in ("x", "y", "r")), k)
        return asking[["f", "c", "x", "y", "m"]].assign(near=list(near))

    own = points.select("f", "c", "x", "y", "m", "strip").mapInPandas(inside, f"{_POINT}, near array<double>, ask array<int>").persist()
    if not boxes:
        return own.drop("ask"), own
    asking = own.where(F.size("ask") > 0).select("f", "c", "x", "y", "m", F.element_at("near", k).alias("r"), F.explode("ask").alias("strip"))
    key = ["strip", "f", "c"]
    found = asking.groupBy(*key).cogroup(points.groupBy(*key)).applyInPandas(there, f"{_POINT}, near array<double>")
    met = own.where(F.size("ask") > 0).drop("ask").unionByName(found).groupBy("f", "c", "x", "y").agg(F.max("m").alias("m"), F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return own.where(F.size("ask") == 0).drop("ask").unionByName(met.select("f", "c", "x", "y", "m", "near")), own


def _leading(values: np.ndarray, v: np.ndarray, r: np.ndarray, left: bool, closed: bool) -> np.ndarray:
    """How many of the ascending values lie before the interval of radius r around each v (left), or before its end."""
    lo, hi = np.zeros(len(v), np.int64), np.full(len(v), len(values), np.int64)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        t = values[np.minimum(mid, len(values) - 1)] - v
        if left:
            ok = (t < -r) if closed else (t <= -r)
        else:
            ok = (t <= r) if closed else (t < r) | (t <= 0)
        ok &= lo < hi
        lo, hi = np.where(ok, mid + 1, lo), np.where(ok | (lo >= hi), hi, mid)
    return lo


def counts_within(values: DataFrame, points: DataFrame, axes: dict[int, list[tuple[int, str]]], closed: bool) -> DataFrame:
    """(a, f, c, x, y, m, n): of each point and axis how many values are nearer than its radius r (or, closed, as near).

    ``values`` are strips() of distinct (a, v), each n times, in that order. ``axes`` holds for each f pairs of an axis a and the point's
    coordinate on it (x or y), which is among that axis' values.
    """
    table: dict[int, list] = {}
    for r in values.groupBy("a", "strip").agg(F.min("v").alias("v"), F.sum("n").alias("n")).orderBy("a", "strip").collect():
        table.setdefault(r["a"], []).append((r["strip"], r["v"], r["n"]))
    known = {}
    for a, rows in table.items():
        n = np.array([r[2] for r in rows])
        # Where few values have many rows, as many points may end there: they are dealt to several tasks.
        known[a] = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.cumsum(n) - n, 1 + n // (4 * STRIP)
    salts = values.sparkSession.createDataFrame([(a, int(s), int(t)) for a, k in known.items() for s, t in zip(k[0], k[3])], "a int, strip int, salts int")

    def route(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in pdfs:
            for f, pdf in whole.groupby("f", sort=False):
                for a, column in axes[f]:
                    strip, first, base, n_salts = known[a]
                    v, r = pdf[column].to_numpy(), pdf["r"].to_numpy()
                    low, high = (_leading(first, v, r, left, closed) - 1 for left in (True, False))
                    for at, end, pick in ((high, 2, high != low), (low, 1, (high != low) & (low >= 0)), (high, 3, high == low)):
                        i = at[pick]
                        moved = base[i] * {1: -1, 2: 1, 3: 0}[end]
                        yield pdf[pick].assign(a=a, v=v[pick], strip=strip[i], end=end, base=moved, salt=np.flatnonzero(pick) % n_salts[i])

    def answer(asking: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or own.empty:
            return pd.DataFrame({n: pd.Series(dtype=object) for n in ("a", "f", "c", "x", "y", "m", "n")})
        own = own.sort_values("v")
        values, upto = own["v"].to_numpy(), np.concatenate([[0], np.cumsum(own["n"].to_numpy())])
        v, r, end = (asking[n].to_numpy() for n in ("v", "r", "end"))
        low, high = (upto[_leading(values, v, r, left, closed)] for left in (True, False))
        return asking[["a", "f", "c", "x", "y", "m"]].assign(n=asking["base"] + np.where(end & 2, high, 0) - np.where(end & 1, low, 0))

    ends = points.select("f", "c", "x", "y", "m", "r").mapInPandas(route, f"{_POINT}, r double, a int, v double, strip int, end int, base long, salt int")
    own = values.join(F.broadcast(salts), ["a", "strip"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    key = ["a", "strip", "salt"]
    parts = ends.groupBy(*key).cogroup(own.groupBy(*key)).applyInPandas(answer, f"a int, {_POINT}, n long")
    return parts.groupBy("a", "f", "c", "x", "y").agg(F.max("m").alias("m"), F.sum("n").alias("n"))
