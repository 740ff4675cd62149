"""The row of the least mean distance by bounds, and gains where all points go to the tasks, against all distances."""

import numpy as np
import pytest

from tessera.operators import balls


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>")


@pytest.mark.parametrize("kind", ["noise", "grid", "equal", "one"])
def test_least_sum(spark, kind):
    rng = np.random.default_rng(5)
    x = {"noise": rng.normal(size=(900, 3)), "grid": rng.integers(0, 3, (400, 2)).astype(float), "equal": np.ones((50, 3)) * 0.1, "one": np.ones((1, 2))}[kind]
    cost = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).mean(axis=1), 9)
    for rounds in (40, 1, 0):
        seen = []
        got = balls.least_sum(frame(spark, x), rounds, 16, seen)
        assert got == (int(cost.argmin()), pytest.approx(cost.min(), abs=2e-9))
        if kind == "noise" and rounds == 40:
            assert seen[0] < 450  # all 900 were summed
    assert balls.least_sum(frame(spark, x[:0])) is None


def test_gains_of_all(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(300, 4)), np.zeros((40, 4))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    p = spark.createDataFrame([(i, v.tolist(), float(d[i, 7])) for i, v in enumerate(x)], "row_id long, x array<double>, cur_min double")
    g = {r.proto_id: r.g for r in balls.gains_of_all(p.selectExpr("row_id AS proto_id", "x AS v"), p, 32).collect()}
    assert np.allclose([g[i] for i in range(len(x))], np.maximum(d[:, 7][:, None] - d, 0).sum(axis=0), rtol=0, atol=1e-9)
