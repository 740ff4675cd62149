"""Lenses and covers: one-dimensional views of a class and overlapping slabs over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.registry import Registry
from tessera.functions.scalars import min_cluster_size, n_intervals
from tessera.functions.vectors import dot

GAIN = 0.25


def average_rank(value: str, keys: list[str], descending: bool = False):
    """Rank from 1 with ties averaged, within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value) if descending else F.asc(value))
    same = Window.partitionBy(*keys, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0)


def rank_parameter(df: DataFrame, value: str, keys: list[str], name: str = "q") -> DataFrame:
    """(average rank - 1) / (n - 1) within a class; 0 for a single row."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn(name, F.when(n < 2, F.lit(0.0)).otherwise((average_rank(value, keys) - 1) / (n - 1)))


def uniform_slabs(df: DataFrame, value: str, keys: list[str], gain: float = GAIN) -> DataFrame:
    """(keys, slab, lo, hi): equal steps over the range, each slab widened by ``gain``; a constant
    value gives one slab of half width 0.5."""
    s = df.groupBy(*keys).agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count(F.lit(1)).alias("n")).withColumn("m", n_intervals(F.col("n")))
    return _slabs(s, keys, gain)


def _slabs(s: DataFrame, keys: list[str], gain: float) -> DataFrame:
    flat = F.col("b") <= F.col("a")
    s = s.withColumn("slab", F.explode(F.when(flat, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("m") - 1))))
    step = (F.col("b") - F.col("a")) / F.col("m")
    mid = F.when(flat, F.col("a")).otherwise(F.col("a") + step * (F.col("slab") + 0.5))
    half = F.when(flat, F.lit(0.5)).otherwise(step * (1 + gain) / 2)
    return s.select(*keys, "slab", (mid - half).alias("lo"), (mid + half).alias("hi"))


def members(df: DataFrame, slabs: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Rows in the closed interval of each slab; a slab table has a few rows a class."""
    return df.join(F.broadcast(slabs), keys).where(F.col(value).between(F.col("lo"), F.col("hi")))


def populations(df: DataFrame, slabs: DataFrame, value: str, keys: list[str]) -> DataFrame:
    n = members(df, slabs, value, keys).groupBy(*keys, "slab").agg(F.count(F.lit(1)).alias("n"))
    return slabs.join(n, [*keys, "slab"], "left").na.fill(0, ["n"])


def cover(df: DataFrame, value: str, keys: list[str], gain: float = GAIN) -> tuple[DataFrame, DataFrame]:
    """(rows with their effective coordinate ``f``, slabs with ``placement``): uniform slabs, or
    slabs over the rank parameter for a class in which a uniform slab holds fewer than twice the
    least cluster size (of all rows)."""
    total = df.groupBy().agg(F.count(F.lit(1)).alias("_t")).select(min_cluster_size(F.col("_t")).alias("mcs"))
    uni = uniform_slabs(df, value, keys, gain)
    starved = populations(df, uni, value, keys).crossJoin(F.broadcast(total)).groupBy(*keys).agg((F.min("n") < 2 * F.first("mcs")).alias("starved"))
    r = rank_parameter(df, value, keys).join(F.broadcast(starved), keys)
    r = r.withColumn("f", F.when(F.col("starved"), F.col("q")).otherwise(F.col(value)))
    slabs = uniform_slabs(r, "f", keys, gain).join(starved, keys)
    slabs = slabs.withColumn("placement", F.when(F.col("starved"), F.lit("quantile")).otherwise(F.lit("uniform"))).drop("starved")
    return r.drop("starved", "q"), slabs


def principal_axis(df: DataFrame, dims: int) -> tuple[list[float], list[float]]:
    """(mean, first principal direction) of x from one aggregate of d(d+1)/2 moments; the direction's
    largest entry is positive."""
    x = F.col("x")
    moments = [F.avg(x[i]).alias(f"m{i}") for i in range(dims)] + [F.avg(x[i] * x[j]).alias(f"c{i}_{j}") for i in range(dims) for j in range(i, dims)]
    r = df.agg(*moments).first()
    mean = np.array([r[f"m{i}"] for i in range(dims)])
    cov = np.empty((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] - mean[i] * mean[j]
    axis = np.linalg.eigh(cov)[1][:, -1]
    return mean.tolist(), (axis * np.sign(axis[np.abs(axis).argmax()])).tolist()


def pc1_lens(df: DataFrame, dims: int) -> DataFrame:
    """Adds f, the projection on the first principal direction; the value of largest magnitude is
    positive, the earliest on ties."""
    mean, axis = principal_axis(df, dims)
    a = F.array(*[F.lit(v) for v in axis])
    d = df.withColumn("f", dot(F.col("x"), a) - sum(m * v for m, v in zip(mean, axis, strict=True)))
    return fix_sign(d, "f")


def fix_sign(df: DataFrame, value: str, row_id: str = "row_id") -> DataFrame:
    top = df.groupBy().agg(F.max(F.struct(F.round(F.abs(value), 9).alias("m"), (-F.col(row_id)).alias("r"), F.col(value).alias("v"))).alias("_top"))
    return df.crossJoin(F.broadcast(top.select((F.when(F.col("_top.v") < 0, -1.0).otherwise(1.0)).alias("_sign")))).withColumn(value, F.col(value) * F.col("_sign")).drop("_sign")


#: Lenses by name: (rows with row_id and x, dimensions) to the rows with a value f.
LENSES = Registry("lens")
LENSES.register("pc1")(pc1_lens)


@LENSES.register("eccentricity")
def eccentricity_lens(df: DataFrame, dims: int) -> DataFrame:
    """f is the mean distance to the other rows."""
    from tessera.operators.neighbors import eccentricity

    return df.join(eccentricity(df.select("row_id", "x")).withColumnRenamed("ecc", "f"), "row_id")


@LENSES.register("fiedler")
def fiedler_lens(df: DataFrame, dims: int) -> DataFrame:
    """f is the second eigenvector of the neighbour graph's normalised Laplacian."""
    from tessera.operators.spectral import fiedler

    one = df.select(F.lit(0).alias("_all"), "row_id", "x")
    return df.join(fiedler(one, "_all").select("row_id", "f"), "row_id")


def lens(df: DataFrame, name: str, dims: int) -> DataFrame:
    """Rows with the value f of a registered lens."""
    return LENSES[name](df, dims)


def nerve(membership: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters a < b that share a row; membership(keys, cluster, row_id).  A row lies in at most two
    slabs of a cover, so the self-join on rows has at most one pair a row."""
    a = membership.select(*keys, "row_id", F.col("cluster").alias("a"))
    b = membership.select(*keys, "row_id", F.col("cluster").alias("b"))
    return a.join(b, [*keys, "row_id"]).where("a < b").select(*keys, "a", "b").distinct()
