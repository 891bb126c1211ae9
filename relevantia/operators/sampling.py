"""Types, standardisation, batches and epochs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash_order
from ..shipping import ship

CONTINUOUS, DISCRETE = ("float", "double", "decimal"), ("boolean", "tinyint", "smallint", "int", "bigint")
#: Bits by which order_statistics() narrows its ranges in a pass, and how many rows in them it counts by whole values.
BITS, FEW = 12, 1 << 17


def kind_of(dtype: str) -> str:
    """continuous, discrete or ignored, by Spark type name."""
    head = dtype.split("(")[0]
    return "continuous" if head in CONTINUOUS else "discrete" if head in DISCRETE else "ignored"


def split_by_type(df: DataFrame) -> DataFrame:
    """(feature, kind) of each column."""
    return df.sparkSession.createDataFrame([(c, kind_of(t)) for c, t in df.dtypes], "feature string, kind string")


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns shifted to mean 0 and scaled by 1e-9 + the population deviation; one aggregate, then a scan."""
    stats = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(stats[f"m_{i}"])) / F.lit(1e-9 + (stats[f"s_{i}"] or 0.0)) for i, c in enumerate(columns)})


def positions(df: DataFrame, id_col: str, epoch: int = 0, within: list[str] = (), seed: int = 0) -> DataFrame:
    """df with ``pos``, each row's place (from 0) in the hash order of its ids.

    Rows are numbered within 4096 ranges of the hash, and ranges start where the counts of
    those before end, so that no task orders the whole table.
    """
    df = df.withColumn("_h", hash_order(F.col(id_col), epoch, seed)).withColumn("_r", F.substring("_h", 1, 3))
    counts = df.groupBy(*within, "_r").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*within, "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(*within, "_r").orderBy("_h", id_col)) - 1
    return df.withColumn("_own", own).join(counts, [*within, "_r"]).withColumn("pos", F.col("_base") + F.col("_own")).drop("_h", "_r", "_own", "_base")


def assign_batches(df: DataFrame, id_col: str, size: int, name: str = "batch", epoch: int = 0, within: list[str] = (), seed: int = 0) -> DataFrame:
    """df with a batch number; batches have equal size and the remainder of each group is dropped. A size above the group's is the group's."""
    n = df.groupBy(*within).agg(F.count("*").alias("_total")) if within else None
    out = positions(df, id_col, epoch, within, seed)
    out = out.join(n, list(within)) if within else out.withColumn("_total", F.lit(df.count()))
    b = F.greatest(F.lit(1), F.least(F.lit(size), F.col("_total")))
    return out.withColumn(name, F.floor(F.col("pos") / b).cast("long")).where(F.col(name) < F.floor(F.col("_total") / b)).drop("pos", "_total")


def replicate_epochs(df: DataFrame, id_col: str, epochs: int, seed: int = 0) -> DataFrame:
    """Every row once an epoch with ``epoch`` and its place ``pos`` in that epoch's order."""
    out = None
    for e in range(epochs):
        one = positions(df, id_col, e, seed=seed).withColumn("epoch", F.lit(e))
        out = one if out is None else out.unionByName(one)
    return out


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values at the ranks (from 0) among the column's values that are not null, as doubles.

    Each pass over the table counts values by the next BITS bits of an integer in the same order, within the ranges that hold a rank, and
    the last one, by all bits, comes when the ranges hold FEW rows: 64 / BITS passes at most, of a bounded number of counts, whatever the values are.
    """
    ship(df.sparkSession)
    values = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    #: Of each range that holds ranks: its leading bits, and the ranks within it.
    open_ranges, bits, found, held = {0: {r: r for r in ranks}} if ranks else {}, 0, {}, FEW + 1
    while open_ranges:
        width = min(BITS if held > FEW else 64, 64 - bits)
        prefixes = np.array(sorted(open_ranges), np.uint64)

        def count(pdfs: Iterator[pd.DataFrame], bits: int = bits, width: int = width, prefixes: np.ndarray = prefixes) -> Iterator[pd.DataFrame]:
            def merged(parts: list) -> list:
                keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                return [(keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64))]

            parts, size = [(np.empty(0, np.uint64), np.empty(0, np.int64))], 0
            for pdf in pdfs:
                # The bits of a double, turned so that unsigned integers have its order; both zeros are one value, all NaNs the largest.
                x = pdf["x"].to_numpy() + 0.0
                u = np.where(np.isnan(x), np.nan, x).view(np.uint64)
                u = np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))
                if bits:
                    own = u >> np.uint64(64 - bits)
                    u = u[prefixes[np.minimum(np.searchsorted(prefixes, own), len(prefixes) - 1)] == own]
                parts.append(np.unique(u >> np.uint64(64 - bits - width), return_counts=True))
                size += len(parts[-1][0])
                if size > 1 << 20:
                    parts, size = merged(parts), 0
            keys, n = merged(parts)[0]
            # As signed integers, which Spark has.
            yield pd.DataFrame({"key": keys.view(np.int64), "n": n})

        counted = values.mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
        keys = counted["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, n = keys[order], counted["n"].to_numpy()[order]
        bits += width
        left: dict[int, dict[int, int]] = {}
        of_key = dict(zip(keys.tolist(), n.tolist()))
        for prefix, wanted in open_ranges.items():
            mine = np.flatnonzero((keys >> np.uint64(width)) == np.uint64(prefix)) if bits > width else np.arange(len(keys))
            upto = np.cumsum(n[mine])
            for rank, within in wanted.items():
                i = int(np.searchsorted(upto, within, "right"))
                key = int(keys[mine[i]])
                if bits == 64:
                    u = np.array([key], np.uint64)
                    found[rank] = float(np.where(u >> np.uint64(63), u ^ np.uint64(1 << 63), ~u).view(np.float64)[0])
                else:
                    left.setdefault(key, {})[rank] = within - int(upto[i - 1] if i else 0)
        open_ranges, held = left, sum(of_key[key] for key in left)
    return [found[r] for r in ranks]


def quantiles(df: DataFrame, column: str, at: list[float]) -> list[float]:
    """Exact quantiles of the values that are not null, interpolated as percentile() does; no task holds the distinct values."""
    n = df.agg(F.count(column)).first()[0]
    places = [(n - 1) * p for p in at]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    value = dict(zip(ranks, order_statistics(df, column, ranks)))
    out = []
    for p in places:
        low, high = math.floor(p), math.ceil(p)
        out.append(value[low] if value[low] == value[high] else (high - p) * value[low] + (p - low) * value[high])
    return out


def discretise(df: DataFrame, column: str, levels: int = 10) -> Column:
    """Bins of a column by its distinct quantiles .1 to .9: how many of them, above the minimum, a value exceeds."""
    at = [0.1 + 0.8 * i / (levels - 1) for i in range(levels)] if levels > 1 else [0.1]
    low = df.agg(F.min(column)).first()[0]
    if low is None:
        return F.lit(None).cast("int")
    cuts, last = [], low
    for q in quantiles(df, column, at):
        if q > last:
            cuts.append(q)
            last = q
    total = F.lit(0)
    for q in cuts:
        total = total + (F.col(column) > F.lit(float(q))).cast("int")
    return total
