"""Point clouds of known shape, made by the executors from seeded columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _frame(df: DataFrame, x, y, label) -> DataFrame:
    return df.select(F.col("id").alias("row_id"), label.cast("int").alias("label"), F.array(x, y).alias("x"))


def annulus(spark: SparkSession, n: int = 350, seed: int = 7, tilt: float = 0.6) -> DataFrame:
    t, r = F.rand(seed) * 2 * math.pi, 1 + 0.08 * F.randn(seed + 1)
    d = spark.range(n).withColumns({"a": 1.6 * r * F.cos(t), "b": r * F.sin(t)})
    c, s = math.cos(tilt), math.sin(tilt)
    return _frame(d, c * F.col("a") - s * F.col("b"), s * F.col("a") + c * F.col("b"), F.lit(0))


def ring_and_blob(spark: SparkSession, ring: int = 400, blob: int = 200, seed: int = 3) -> DataFrame:
    t = F.rand(seed) * 2 * math.pi
    d = spark.range(ring + blob).withColumns({"t": t, "u": F.randn(seed + 1), "v": F.randn(seed + 2)})
    on = F.col("id") < ring
    x = F.when(on, F.cos("t") + 0.08 * F.col("u")).otherwise(0.18 * F.col("u"))
    y = F.when(on, F.sin("t") + 0.08 * F.col("v")).otherwise(0.18 * F.col("v"))
    return _frame(d, x, y, (~on).cast("int"))


def moons(spark: SparkSession, n: int = 600, noise: float = 0.1, seed: int = 11) -> DataFrame:
    d = spark.range(n).withColumns({"t": F.rand(seed) * math.pi, "u": F.randn(seed + 1), "v": F.randn(seed + 2)})
    odd = F.col("id") % 2 == 1
    x = F.when(odd, 1 - F.cos("t")).otherwise(F.cos("t")) + noise * F.col("u")
    y = F.when(odd, 0.5 - F.sin("t")).otherwise(F.sin("t")) + noise * F.col("v")
    return _frame(d, x, y, odd.cast("int"))
