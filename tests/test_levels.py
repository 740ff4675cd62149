"""The level-wise partition against the one that holds all rows."""

import numpy as np
import pytest

from tessera.operators import levels
from tessera.operators import reducers as R


def points(spark, x, y):
    return spark.createDataFrame([(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y, strict=True))], "row_id long, label int, x array<double>").repartition(3)


@pytest.mark.parametrize("subset_rows,pair_rows", [(20, 1000), (60, 70), (1000, 1000)])
def test_levels_are_the_partition(spark, subset_rows, pair_rows):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(150, 2)).round(2), rng.integers(0, 3, 150)
    x[100:125] = x[0]  # rows that coincide, of several classes
    cut = []
    got = levels.rsp3(points(spark, x, y), subset_rows, pair_rows, cut).orderBy("proto_id").collect()
    p, labels, _ = R.partition(x, y)
    assert [r.proto_id for r in got] == list(range(len(p))) and [r.label for r in got] == labels.tolist()
    assert np.allclose([r.features for r in got], p)
    assert (len(cut) > 2) == (subset_rows < 150) and cut[-1] == 0


def test_levels_of_few_rows(spark):
    one = levels.rsp3(points(spark, np.ones((5, 2)), [0, 0, 1, 1, 1]), subset_rows=2).collect()
    assert sorted((r.label, tuple(r.features)) for r in one) == [(0, (1.0, 1.0)), (1, (1.0, 1.0))]
    assert levels.rsp3(points(spark, np.ones((2, 2)), [0, 0]).where("false")).collect() == []


@pytest.mark.parametrize("n,digits", [(60, None), (400, 1), (2600, 1)])
def test_farthest_by_tiles(n, digits):
    """Against all differences, whole and in two chunks; rounded rows tie and repeat, and the least ids win."""
    x = np.random.default_rng(n).normal(size=(n, 2))
    x = x if digits is None else x.round(digits)
    least = {}
    for k, v in enumerate(map(tuple, x.tolist())):
        least.setdefault(v, k)
    at = np.array(sorted(least.values()))
    d = np.triu(np.round(np.sqrt(((x[at, None] - x[None, at]) ** 2).sum(axis=2)), 12), 1)
    i, j = np.unravel_index(d.argmax(), d.shape)
    want = (pytest.approx(d.max(), abs=1e-11), at[i], at[j])
    ids = np.arange(n)
    assert R.farthest(x, ids) == want
    a, b = ids[ids % 3 == 0], ids[ids % 3 > 0]
    parts = [R.farthest(x[a], a), R.farthest(x[b], b), R.farthest(x[a], a, x[b], b)]
    assert max((d, -i, -j) for d, i, j in parts) == (want[0], -want[1], -want[2])


def test_farthest_is_by_products():
    """20,000 wide rows in one task: all differences took minutes.  A row that is not finite is in no pair."""
    import time

    x = np.random.default_rng(0).normal(size=(20_000, 64))
    x[7] = np.nan
    x[11], x[19_000] = 9.0, -9.0
    begun = time.process_time()
    assert R.diameter(x)[:2] == (11, 19_000)
    assert time.process_time() - begun < 60
