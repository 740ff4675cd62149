"""Ball-partitioned searches and spanning edges against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import balls, neighbors, spanning


def cloud(seed, n=300, d=3, copies=60):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n // 2, d)), rng.normal(size=(n // 2, d)) * 0.2 + 4])
    x[rng.integers(0, n, copies)] = x[7]  # one vector many rows share
    return x.round(3)


def frame(spark, rows, **names):
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "row_id long, x array<double>")
    return d.withColumnsRenamed(names)


def d2(x, v):
    return ((x[:, None, :] - v[None, :, :]) ** 2).sum(axis=2).round(9)


@pytest.mark.parametrize("k,others", [(1, False), (3, True), (70, False)])
def test_k_nearest(spark, k, others):
    x = cloud(1)
    p, m = frame(spark, x), frame(spark, x, row_id="proto_id", x="v")
    d = d2(x, x)
    want = []
    for i, row in enumerate(d):
        order = [j for j in np.lexsort((np.arange(len(x)), row)).tolist() if not (others and i == j)][:k]
        want += [(i, r, j, row[j]) for r, j in enumerate(order, 1)]
    got = balls.k_nearest(p, m, k, others, ball_rows=16)
    assert sorted((r.row_id, r["rank"], r.proto_id, round(r.d2, 9)) for r in got.collect()) == sorted((a, b, c, round(float(e), 9)) for a, b, c, e in want)


def test_k_nearest_over_the_bound(spark, monkeypatch):
    """A model over the bound of what may be sent takes the balls, with the same rows and carried columns."""
    x = cloud(2, n=120)
    p = frame(spark, x)
    m = frame(spark, x, row_id="proto_id", x="v").withColumn("label", F.col("proto_id") % 5)
    small = {tuple(r) for r in neighbors.k_nearest(p, m, 2, ["label"], others=True).collect()}
    monkeypatch.setattr(neighbors, "MODEL_CELLS", 10)
    assert {tuple(r) for r in neighbors.k_nearest(p, m, 2, ["label"], others=True).collect()} == small


@pytest.mark.parametrize("seed,n", [(3, 300), (4, 40)])
def test_farthest_pair(spark, seed, n):
    x = cloud(seed, n=n, copies=n // 5)
    d = d2(x, x)
    i, j = min((i, j) for i, j in zip(*np.nonzero(d == d.max()), strict=True) if i < j)
    seen = []
    assert balls.farthest_pair(frame(spark, x), ball_rows=8, batch=4, seen=seen) == (i, j, pytest.approx(d.max()))
    if n == 300:  # most pairs of balls cannot hold the pair and are never looked at
        assert seen[0][0] < 0.2 * seen[0][1]


def test_farthest_pair_of_few(spark):
    p = frame(spark, np.array([[1.0, 1.0]] * 3))
    assert balls.farthest_pair(p) == (0, 1, 0.0)
    assert balls.farthest_pair(p.where("row_id = 1")) is None and balls.farthest_pair(p.where("false")) is None
    assert neighbors.farthest_pair(p.where("false")).collect() == []


def test_sums_and_gains(spark):
    x = cloud(5, n=200)
    p = frame(spark, x)
    d = np.sqrt(d2(x, x))
    m = frame(spark, x, row_id="proto_id", x="v")
    got = {r.row_id: r.s for r in balls.distance_sums(p, m, cells=90).collect()}
    assert np.allclose([got[i] for i in range(len(x))], d.sum(axis=1))
    cur = np.where(np.arange(len(x)) % 3 == 0, 0.3, 0.0)
    current = spark.createDataFrame([(i, float(c)) for i, c in enumerate(cur)], "row_id long, cur_min double")
    want = np.maximum(cur[:, None] - d, 0).sum(axis=0)
    away = spark.createDataFrame([(999, [90.0] * 3)], "proto_id long, v array<double>")
    g = {r.proto_id: r.g for r in balls.gains(m.unionByName(away), p.join(current, "row_id"), ball_rows=8).collect()}
    assert np.allclose([g.get(i, 0.0) for i in range(len(x))], want)
    assert 999 not in g  # a candidate that reaches nothing goes nowhere
    gain = {r.proto_id: r.gain for r in neighbors.facility_gains(p, current).collect()}
    assert np.allclose([gain[i] for i in range(len(x))], want / len(x))


def prim(x, comp):
    """Bridges one component at a time, as the definition has it."""
    d, merged, out = d2(x, x), {min(comp)}, []
    while merged != set(comp):
        best = min((d[i, j], i, j) for i in range(len(x)) for j in range(len(x)) if comp[i] in merged and comp[j] not in merged)
        merged.add(comp[best[2]])
        out.append((best[1], best[2], float(best[0])))
    return sorted(out)


@pytest.mark.parametrize("seed", [6])
def test_bridges(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 2)) * 3
    ends = [(i, i + 1) for i in range(0, 60, 3)] + [(20, 40)]
    comp = list(range(60))
    for i, j in ends * 5:
        comp[i] = comp[j] = min(comp[i], comp[j])
    rounds = []
    got = spanning.bridges(frame(spark, x), spark.createDataFrame(ends, "i long, j long"), ball_rows=8, rounds=rounds)
    assert sorted((r.a, r.b, r.d2) for r in got.collect()) == [(a, b, pytest.approx(c)) for a, b, c in prim(x, comp)]
    assert rounds[0] == len(set(comp)) and all(b <= -(-a // 2) for a, b in itertools.pairwise(rounds))


def test_bridges_of_one_component(spark):
    p = frame(spark, np.eye(3))
    assert spanning.bridges(p, spark.createDataFrame([(0, 1), (1, 2)], "i long, j long")).collect() == []


def test_turned(spark):
    """A random tree turned away from its root is what a walk from the root gives."""
    rng = np.random.default_rng(8)
    up = {i: int(rng.integers(0, i)) for i in range(1, 30)}
    rows = [(i, p, i) if rng.random() < 0.5 else (p, i, i) for i, p in up.items()]
    got = spanning.turned(spark.createDataFrame(rows, "u long, v long, eid long"), 0)
    assert {r.eid: (r.u, r.v) for r in got.collect()} == {i: (p, i) for i, p in up.items()}


def test_facility_gain_sums_all_distances_once(spark, sf, monkeypatch):
    """The first row was found anew, over all pairs, by every step that read it."""
    from tessera import queries as Q

    d = Q.facility_gain(spark, sf)
    assert "MapInArrow" not in d._jdf.queryExecution().optimizedPlan().toString()
