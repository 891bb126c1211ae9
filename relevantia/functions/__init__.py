"""Scalar building blocks shared by the operators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def hash_order(row_id: Column, epoch: int = 0, seed: int = 0) -> Column:
    """A pseudo-random order of ids of any type that reads as a string; another one for each seed and epoch, and any SQL engine computes it alike."""
    return F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), row_id.cast("string")))


def hash_order_sql(row_id: str, epoch: int = 0, seed: int = 0) -> str:
    return f"md5('{seed}:{epoch}:' || ({row_id})::VARCHAR)"


#: ln k! below the point from which Stirling's series is exact to double precision.
_SMALL = [math.lgamma(k + 1) for k in range(16)]


def log_factorial(k: Column) -> Column:
    """ln k! of non-negative integers: a table of the first 16, then Stirling's series; no join, whatever the range."""
    x = F.greatest(k, F.lit(len(_SMALL))).cast("double")
    r = 1.0 / (x * x)
    series = x * F.log(x) - x + 0.5 * F.log(2.0 * math.pi * x) + (1.0 / 12 - r * (1.0 / 360 - r * (1.0 / 1260 - r / 1680))) / x
    table = F.array(*map(F.lit, _SMALL))
    return F.when(k < len(_SMALL), F.get(table, F.least(k, F.lit(len(_SMALL) - 1)).cast("int"))).otherwise(series)


def log_factorials(k: np.ndarray) -> np.ndarray:
    """log_factorial() of an array."""
    x = np.maximum(k, len(_SMALL)).astype(float)
    r = 1.0 / (x * x)
    series = x * np.log(x) - x + 0.5 * np.log(2.0 * math.pi * x) + (1.0 / 12 - r * (1.0 / 360 - r * (1.0 / 1260 - r / 1680))) / x
    return np.where(k < len(_SMALL), np.array(_SMALL)[np.minimum(k, len(_SMALL) - 1)], series)


def digamma(n: Column) -> Column:
    """At positive integers: the harmonic sum less Euler's constant, by a table below 16 and its asymptotic series, exact to double precision, from there on."""
    table, total = [], -EULER
    for i in range(1, 17):
        table.append(total)
        total += 1.0 / i
    x = F.greatest(n, F.lit(len(table))).cast("double")
    r = 1.0 / (x * x)
    series = F.log(x) - 0.5 / x - r * (1.0 / 12 - r * (1.0 / 120 - r * (1.0 / 252 - r * (1.0 / 240 - r / 132))))
    return F.when(n <= len(table), F.get(F.array(*map(F.lit, table)), F.least(n, F.lit(len(table))).cast("int") - 1)).otherwise(series)
