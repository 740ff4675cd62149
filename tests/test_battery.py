"""The pairwise matrix, the family check and the cost table."""

import pytest

from tessera.operators import stats as T
from tessera.plans import battery


def _scores(spark):
    rows = [(b, m, s) for b, line in enumerate([(0.9, 0.8, 0.7), (0.8, 0.85, 0.6), (0.95, 0.9, 0.5), (0.7, 0.6, 0.65)]) for m, s in zip("ABC", line, strict=True)]
    return spark.createDataFrame(rows, "block long, treatment string, score double")


def test_matrix(spark):
    got = {(r.a, r.b): r.p_raw for r in T.conover_matrix(_scores(spark)).collect()}
    assert len(got) == 9 and all(got[a, a] == pytest.approx(1.0) for a in "ABC") and all(got[a, b] == got[b, a] for a, b in got)
    control = {r.treatment: r.p_raw for r in T.conover(_scores(spark), "A").collect()}
    assert control == {t: pytest.approx(got["A", t]) for t in "BC"}


def test_family_and_matrix_of_a_battery(spark):
    rows = [(f"d{r.block}", 0, {"A": "Skeleton+1NN", "B": "KMeans", "C": "Random"}[r.treatment], r.score) for r in _scores(spark).collect()]
    df = spark.createDataFrame(rows, "dataset string, fold int, method string, acc_1nn double")
    out = battery.battery(df, "Skeleton+1NN")
    assert out["comparison"].count() == 2 and all(r.significant is not None for r in out["comparison"].collect())
    m = {r.a: r for r in out["conover_matrix"].collect()}
    assert len(m) == 3 and m["KMeans"]["Random"] == m["Random"]["KMeans"]


def test_cost_ratios(spark):
    df = spark.createDataFrame([("x", "A", 2.0), ("x", "A", 4.0), ("x", "B", 1.5), ("y", "A", 1.0), ("z", "A", 1.0), ("z", "B", 0.0)], "dataset string, method string, cpu_seconds double")
    got = {r.dataset: r for r in T.cost_ratios(df, ["A", "B"], "A", ["B"]).collect()}
    assert (got["x"].A, got["x"].ratio_B, got["y"].ratio_B, got["z"].ratio_B) == (3.0, 2.0, None, None)
    with pytest.raises(ValueError, match="roster"):
        T.cost_ratios(df, ["A"], "A", ["B"])
