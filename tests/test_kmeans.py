"""K-means over tables against the array form."""

import numpy as np
import pytest

from tessera.operators import kmeans as M
from tessera.operators import reducers as R
from tessera.operators.density import squared


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    mids = rng.normal(size=(12, 3)) * 6
    x = np.concatenate([m + rng.normal(size=(40, 3)) for m in mids])
    y = np.repeat(np.arange(12) % 2, 40)
    return x, y, spark.createDataFrame([(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y, strict=True))], "row_id long, label int, x array<double>").repartition(4).cache()


def test_inertia_and_reruns(data):
    x, y, points = data
    want = {0: 6, 1: 6}
    centres, cost = M.kmeans(points, want, starts=4, seed=7)
    again, _ = M.kmeans(points.repartition(3), want, starts=4, seed=7)
    for (c, s), v in centres.items():
        own = x[y == c]
        best = squared(own, R.lloyd(own, 6, np.random.default_rng(1))).min(axis=1).sum()
        assert cost[c, s] <= 1.01 * best and cost[c, s] == pytest.approx(squared(own, v).min(axis=1).sum())
        assert np.allclose(again[c, s], v)


@pytest.mark.parametrize("gather", [0, M.GATHER])
def test_one_round(data, monkeypatch, gather):
    monkeypatch.setattr(M, "GATHER", gather)
    x, y, points = data
    rows = points.selectExpr("row_id", "cast(label as long) label", "x")
    given = {(0, 0): x[y == 0][:5], (1, 0): np.concatenate([x[y == 1][:3], [[99.0] * 3]])}
    new, cost = M.lloyd_round(rows, given)
    for (c, s), v in given.items():
        d = squared(x[y == c], v)
        at = d.argmin(axis=1)
        assert cost[c, s] == pytest.approx(d.min(axis=1).sum())
        assert np.allclose(new[c, s], [x[y == c][at == k].mean(axis=0) if (at == k).any() else v[k] for k in range(len(v))])


def test_rows_that_coincide(spark):
    points = spark.createDataFrame([(i, 0, [1.0, 2.0]) for i in range(5)], "row_id long, label int, x array<double>")
    got = M.prototypes(points, {0: 3}, starts=2).collect()
    assert len(got) == 3 and all(r.features == [1.0, 2.0] and r.label == 0 for r in got)


def test_bound(monkeypatch):
    monkeypatch.setattr(M, "CELLS", 5)
    with pytest.raises(ValueError):
        M.bounded({(0, 0): np.zeros((3, 2))})


def test_sums_of_many_tasks_are_added_before_the_driver(spark, monkeypatch):
    """Tasks' sums of up to two million numbers a pass, over hundreds of passes, went to the driver."""
    import numpy as np

    from tessera.operators import kmeans as KM

    x = np.random.default_rng(1).standard_normal((400, 5))
    d = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "row_id long, label long, x array<double>").repartition(7, "row_id")
    centres = {(c, s): x[[c + s, c + s + 6, c + s + 10]] for c in (0, 1) for s in (0, 1)}
    assert KM.GATHER * 8 * 300 < 300e6
    want = KM.one_pass(d, centres)
    seen, added = [], KM.added
    monkeypatch.setattr(KM, "added", lambda p, w: seen.append(added(p, w)) or seen[-1])
    monkeypatch.setattr(KM, "GATHER", 0)
    got = KM.one_pass(d, centres)
    assert seen[0].count() == 12  # one row a centre
    assert got.keys() == want.keys()
    for k, (n, s, cost) in got.items():
        assert (n == want[k][0]).all() and np.allclose(s, want[k][1]) and abs(cost - want[k][2]) < 1e-9
