"""Quantiles by brackets and class statistics at scale: exact values, no class in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import prepare as P


@pytest.mark.parametrize("accuracy", [10_000, 40])
def test_quantiles(spark, accuracy):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), None if i % 3 else float(c), None, int(b)) for i, (a, b, c) in enumerate(zip(rng.standard_normal(999), rng.integers(0, 4, 999), rng.standard_normal(999) ** 3, strict=True))]
    d = spark.createDataFrame(rows, "a double, b double, c double, e double, i int").repartition(3)
    at = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = P.quantiles(d, ["a", "b", "c", "e", "i"], at, accuracy)
    for k, c in enumerate(["a", "b", "c"]):
        assert got[c] == pytest.approx(np.percentile([r[k] for r in rows if r[k] is not None], [0, 25, 50, 75, 100]), abs=1e-12)
    assert got["i"] == got["b"] and got["e"] == [None] * 5


def test_robust_scaling_builds_no_table_of_values(spark):
    d = spark.range(1000).select((F.col("id") % 7).cast("double").alias("a"), F.lit(2.0).alias("b"))
    out = P.scale_robust(d, ["a", "b"])
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r.b for r in out.collect()} == {0.0}


def test_class_statistics_are_sent_not_shuffled(spark):
    d = spark.createDataFrame([("x", 1.0), ("x", 3.0), (None, 5.0), (None, 9.0)], "label string, v double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.class_zscore(d, ["v"])
        assert "BroadcastHashJoin" in out._jdf.queryExecution().sparkPlan().toString()
        assert sorted(((r.label or ""), r.v) for r in out.collect()) == [("", -1.0), ("", 1.0), ("x", -1.0), ("x", 1.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
