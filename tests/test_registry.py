"""What a user registers takes part like what is built in; what is malformed is refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cover as C
from tessera.operators import segments as G
from tessera.plans import campaign as K


def sites(spark, oracle):
    own = spark.createDataFrame([(1, 0, 0, 0, 5.0), (2, 0, 1, 0, 1.0), (3, 0, 1, 0, 1.0), (4, 0, 0, 1, 0.5)], "row_id long, label int, kind int, id long, d double")
    other = spark.createDataFrame([(1, 0, 9.0, 1), (2, 0, 0.5, 1), (3, 0, 1.0, 1), (4, 0, 0.9, 1)], "row_id long, label int, other_min double, other_arg int")
    return {(r.kind, r.id): (r.errors, r.is_site) for r in G.growth_sites(own, other, ["row_id", "label"], oracle).collect()}


def test_a_users_oracle_moves_the_site(spark):
    assert sites(spark, "misclassified") == {(0, 0): (0, False), (1, 0): (1, True), (0, 1): (0, False)}
    assert sites(spark, "distortion")[0, 0] == (25.0, True)

    @G.ERROR_ORACLES.register("close_call")
    def close_call(own, other, own_cls, other_cls):
        return F.when(F.abs(own - other) < 0.45, 1.0).otherwise(0.0)

    try:
        assert sites(spark, "close_call")[0, 1] == (1.0, False) and sites(spark, "close_call")[1, 0] == (1.0, True)
    finally:
        del G.ERROR_ORACLES["close_call"]
    with pytest.raises(ValueError, match="there are distortion, misclassified"):
        sites(spark, "close_call")


def test_lenses(spark):
    x = np.random.default_rng(0).normal(size=(30, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).sum(axis=1) / 29
    assert np.allclose([r.f for r in C.lens(df, "eccentricity", 3).orderBy("row_id").collect()], d)
    C.LENSES.register("first")(lambda rows, dims: rows.withColumn("f", F.col("x")[0]))
    try:
        assert np.allclose([r.f for r in C.lens(df, "first", 3).orderBy("row_id").collect()], x[:, 0])
    finally:
        del C.LENSES["first"]


@pytest.mark.parametrize("edge", [(0, 7, 0, 5), (0, 7, 1, 1), (1, 7, 0, 1)])
def test_bad_edges_are_refused(spark, edge):
    vertex = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "label int, vid long")
    kind = "label int, eid long, i long, j long"
    good = spark.createDataFrame([(0, 0, 0, 1)], kind)
    assert G.checked_edges(good, vertex) is good
    with pytest.raises(ValueError, match="without two vertices"):
        G.checked_edges(good.unionByName(spark.createDataFrame([edge], kind)), vertex)


@pytest.mark.parametrize("budgets", [[0.0], [1.5], [-0.1], [0.2, 0.2]])
def test_bad_fractions_are_refused(spark, budgets):
    df = spark.createDataFrame([("d", 0, 0, 0, [1.0])], "dataset string, row_id long, label int, fold int, x array<double>")
    with pytest.raises(ValueError, match="fractions"):
        K.run_campaign(df, 2, budgets=budgets)
