"""Hop distances of paths over 40 hops, which were cut there, and the walk by arrays against the walk by tables."""

import duckdb
import numpy as np

from tessera.operators import topology as H
from tessera.queries import ORACLES, QUERIES


def test_a_path_is_walked_to_its_end(spark, tmp_path):
    rows = [(i, 0, [float(i), 0.0, 0.0, 0.0]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = {(r.src, r.dst): r.hop for r in QUERIES["hop_distance"](spark, str(tmp_path)).collect()}
    assert got == {(i, j): h for i, j, h in c.sql(f"SELECT src, dst, hop FROM ({ORACLES['hop_distance']})").fetchall()}
    assert max(got.values()) > 40 and 60 not in got.values()


def test_arrays_and_tables_agree(spark):
    rng = np.random.default_rng(3)
    v = spark.range(40).withColumnRenamed("id", "vid")
    e = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 40, (36, 2))], "i long, j long")
    for most in (None, 3):
        one, two = (sorted(map(tuple, H.hops(v, e, most, cells).collect())) for cells in (H.GRAPH_CELLS, 0))
        assert one == two and len(one) == 1600


def test_no_pair_is_shuffled(spark):
    v = spark.range(50).withColumnRenamed("id", "vid")
    e = spark.createDataFrame([(i, i + 1) for i in range(49)], "i long, j long")
    assert "Join" not in H.hops(v, e)._jdf.queryExecution().optimizedPlan().toString()


def test_walk():
    first, to = np.array([0, 1, 3, 4, 4]), np.array([1, 0, 2, 1])
    assert H.walk(np.array([0, 3]), first, to).tolist() == [[0, 1, 2, -1], [-1, -1, -1, 0]]
