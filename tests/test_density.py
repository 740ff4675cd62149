"""Density clusters in memory that grows with the rows, not with their square."""

import tracemalloc

import numpy as np

from tessera.operators import density as D


def dense_tree(x, core):
    d = D.pairwise(x, x)
    w, n = np.maximum(d, np.maximum(core[:, None], core[None, :])), len(x)
    best, via, todo = w[0].copy(), np.zeros(n, dtype=int), np.arange(n) > 0
    rows = np.empty((n - 1, 3))
    for k in range(n - 1):
        j = int(np.where(todo, best, np.inf).argmin())
        rows[k] = best[j], via[j], j
        todo[j] = False
        closer = todo & (w[j] < best)
        best[closer], via[closer] = w[j][closer], j
    return rows[np.argsort(rows[:, 0], kind="stable")]


def test_the_tree_equals_that_of_the_dense_matrix(monkeypatch):
    monkeypatch.setattr(D, "HELD", 500)
    for seed, dims in ((0, 2), (1, 5), (2, 64)):
        x = np.random.default_rng(seed).standard_normal((150, dims)).round(1)
        x[:10] = x[10:20]  # copies and ties
        core = D.blocks(x, x, lambda d: np.sort(d, axis=1)[:, 4])
        assert np.array_equal(core, np.sort(D.pairwise(x, x), axis=1)[:, 4])
        assert np.array_equal(D._spanning_tree(x, core), dense_tree(x, core))


def test_memory_is_not_the_square(monkeypatch):
    monkeypatch.setattr(D, "HELD", 300_000)
    x = np.random.default_rng(0).standard_normal((3000, 4))
    tracemalloc.start()
    assert len(D.density_clusters(x, 20, 5)) == 3000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # one matrix of all pairs takes 72 MB here
