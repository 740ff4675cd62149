"""Scalar rules of the evaluation protocol, as columns and, where the driver needs them, in Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# 32-bit FNV-1a, the campaign's base seed and its stride between folds.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
BASE_SEED, FOLD_STRIDE = 20260723, 1000003


def fold_seed(name: Column, fold: Column) -> Column:
    """Seed of a dataset's fold: FNV-1a of the name, offset by base seed and fold, modulo 2**31."""
    codes = F.transform(F.sequence(F.lit(1), F.char_length(name)), lambda i: F.ascii(F.substring(name, i, F.lit(1))).cast("long"))
    h = F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(FNV_PRIME), F.lit(2**32)))
    return F.pmod(F.lit(BASE_SEED) + h + F.lit(FOLD_STRIDE) * fold, F.lit(2**31))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def n_intervals(n: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(F.pow(8.0 * n, F.lit(0.2)))).cast("int")


def min_cluster_size(n: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(15.0), 0.005 * n)).cast("int")


def py_n_intervals(n: int) -> int:
    return max(2, math.ceil((8.0 * n) ** 0.2))


def py_min_cluster_size(n: int) -> int:
    return int(min(100.0, max(15.0, 0.005 * n)))


def logistic_slope(mu: Column, s: float) -> Column:
    """Derivative of the logistic function of s*mu."""
    z = 1 / (1 + F.exp(-s * mu))
    return s * z * (1 - z)


def margin(d1: Column, d2: Column) -> Column:
    return F.when(d1 + d2 > 0, (d1 - d2) / (d1 + d2)).otherwise(F.lit(0.0))


def snap(x: Column, digits: int = 12, tiny: float = 1e-290) -> Column:
    """Round to significant digits; what is next to zero is zero."""
    e = F.floor(F.log10(F.abs(x)))
    return F.when(F.abs(x) < tiny, F.lit(0.0)).otherwise(F.round(x * F.pow(F.lit(10.0), digits - 1 - e)) / F.pow(F.lit(10.0), digits - 1 - e))


def py_snap(x, digits: int = 12, tiny: float = 1e-290):
    import numpy as np

    x = np.asarray(x, dtype=float)
    ok = np.isfinite(x) & (np.abs(x) >= tiny)
    e = np.floor(np.log10(np.where(ok, np.abs(x), 1.0)))
    f = 10.0 ** (digits - 1 - e)
    return np.where(ok, np.round(np.where(ok, x, 0.0) * f) / f, np.where(np.isfinite(x), 0.0, x))


def slug(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", "_"))


def passes(k: Column, n: Column, every: int = 100) -> Column:
    """Passes over n points that insert k units, one in so many presentations, two at the start."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0), k - 2) * every / F.greatest(F.lit(1), n))).cast("int")
