"""The Fiedler lens over tables against dense eigenvectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cover as C
from tessera.operators import spectral as Z
from tessera.operators.skeleton import lens


def _table(spark, classes):
    rows = []
    for c, x in classes.items():
        rows += [(c, len(rows) + i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "cls string, row_id long, x array<double>").repartition(3)


def test_classes_at_once(spark):
    """Classes that overlap, one in two parts (a bridge joins them), and those of one and two rows."""
    rng = np.random.default_rng(5)
    two = np.concatenate([rng.normal(size=(9, 2)), rng.normal(size=(8, 2)) + 60])
    classes = {"a": rng.normal(size=(16, 2)), "b": two, "one": np.ones((1, 2)), "pair": np.array([[0.0, 0.0], [1.0, 1.0]])}
    got = {}
    for r in Z.fiedler(_table(spark, classes), "cls", 4).collect():
        got.setdefault(r.cls, []).append((r.row_id, r.f))
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in classes.items()}
    for c in ("a", "b"):
        want = lens(classes[c], "fiedler", 4)
        assert np.allclose([f for _, f in sorted(got[c])], want, atol=1e-7)
    assert all(f == 0 for c in ("one", "pair") for _, f in got[c])


def test_restarts(spark):
    """A long thin class takes more vectors than the basis holds; a round one is done before it and rests."""
    rng = np.random.default_rng(6)
    thin = np.stack([np.linspace(0, 9, 24) + rng.normal(size=24) * 0.01, rng.normal(size=24) * 0.01], axis=1)
    classes = {"thin": thin, "few": rng.normal(size=(5, 2))}
    seen = []
    got = {}
    for r in Z.fiedler(_table(spark, classes), "cls", 3, standardize=False, basis=10, seen=seen).collect():
        got.setdefault(r.cls, []).append((r.row_id, r.f))
    assert len(seen) > 10
    assert np.allclose([f for _, f in sorted(got["thin"])], lens(thin, "fiedler", 3, standardize=False), atol=1e-6)
    few = lens(classes["few"], "fiedler", 3, standardize=False)
    assert np.allclose([f for _, f in sorted(got["few"])], few, atol=1e-6)


def test_edges_of_input(spark):
    t = _table(spark, {"a": np.zeros((0, 2))})
    assert Z.fiedler(t, "cls").isEmpty()
    with pytest.raises(ValueError, match="basis"):
        Z.second_vectors(t.select("cls", "row_id"), t, "cls", basis=4)


def test_registered_lens(spark):
    x = np.random.default_rng(7).normal(size=(14, 2))  # more rows than neighbours: of a complete graph the eigenvalue is multiple
    t = _table(spark, {"a": x})
    got = [r.f for r in C.lens(t, "fiedler", 2).orderBy("row_id").collect()]
    assert np.allclose(got, lens(x, "fiedler"), atol=1e-7)


def _dense(n, edges):
    a = np.zeros((n, n))
    for i, j in edges:
        a[i, j] = a[j, i] = 1.0
    return a / np.sqrt(np.outer(a.sum(axis=0), a.sum(axis=0)))


def test_products_over_blocks(spark):
    """Two classes in three blocks and one: one product and a polynomial of the matrix, against dense ones."""
    rng = np.random.default_rng(8)
    pairs = {(i, i + 1) for i in range(39) if i != 24} | {tuple(sorted(rng.choice(25, 2, False).tolist())) for _ in range(40)}
    v = spark.createDataFrame([(0 if i < 25 else 3, i % 3 if i < 25 else 3, i, float(rng.normal())) for i in range(40)], "code long, block long, vid long, start double")
    graph = Z._graph(v, spark.createDataFrame(sorted(pairs), "i long, j long"))
    x = np.array([r.start for r in v.orderBy("vid").collect()])
    m, ids = _dense(40, pairs), {r.block: r.vids for r in graph.collect()}
    t0, t1 = np.empty(40), np.empty(40)
    middle, half = np.where(np.arange(40) < 25, -0.2, -0.1), np.where(np.arange(40) < 25, 0.8, 0.9)
    for ends, steps in (({}, 1), ({0: (-0.2, 0.8), 3: (-0.1, 0.9)}, 3)):
        got = np.zeros(40)
        for r in Z._products(graph, graph.select("block", F.col("w").alias("t")), ends, steps, False).collect():
            got[ids[r.block]] = np.frombuffer(r.t)
        shift = lambda u: (m @ u - middle * u) / half
        t0, t1 = (x, m @ x) if not ends else (x, shift(x))
        for _ in range(steps - 1):
            t0, t1 = t1, 2 * shift(t1) - t0
        assert np.allclose(got, t1, atol=1e-12)


def test_vectors_over_blocks(spark, monkeypatch):
    """A path in blocks of which the rounds need the filter."""
    monkeypatch.setattr(Z, "FILTER", 4)
    edges, seen = [(i, i + 1) for i in range(29)], []
    vertex = spark.createDataFrame([("a", i) for i in range(30)], "cls string, vid long")
    got = Z.second_vectors(vertex, spark.createDataFrame(edges, "i long, j long"), "cls", basis=10, seen=seen, block_rows=12)
    f = np.array([r.f for r in got.orderBy("vid").collect()])
    want = np.linalg.eigh(_dense(30, edges))[1][:, -2]
    assert len(seen) > 10 and np.allclose(f * np.sign(f @ want), want, atol=1e-7)


def test_classes_are_searched_apart(spark, monkeypatch):
    """Neighbours come from a search within the class: none passes by the rows of all classes."""
    monkeypatch.setattr(Z.N, "knn_graph", None)
    x = np.random.default_rng(9).normal(size=(20, 2))
    edges = Z.neighbour_graph(_table(spark, {"a": x, "b": x + 0.001}), "cls", 3)
    got = {(r.i, r.j) for r in edges.collect()}
    assert {(i - 20, j - 20) for i, j in got if i >= 20} == {(i, j) for i, j in got if j < 20} and all((i < 20) == (j < 20) for i, j in got)
