"""Hop distances of a path longer than the 40 hops that the query's SQL walks."""

import duckdb

from tessera.operators import topology as H
from tessera.queries import ORACLES, QUERIES


def test_a_long_path_against_sql(spark, tmp_path):
    rows = [(i, 0, [float(i), 0.0, 0.0, 0.0]) for i in range(46)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted((r.src, r.dst, r.hop) for r in QUERIES["hop_distance"](spark, str(tmp_path)).collect())
    assert got == sorted(c.sql(f"SELECT src, dst, hop FROM ({ORACLES['hop_distance']})").fetchall())


def test_most(spark):
    v = spark.range(5).withColumnRenamed("id", "vid")
    e = spark.createDataFrame([(i, i + 1) for i in range(4)], "i long, j long")
    assert {(r.src, r.dst): r.hop for r in H.hops(v, e).collect()}[0, 4] == 4
    got = {(r.src, r.dst): r.hop for r in H.hops(v, e, most=2).collect()}
    assert got[0, 2] == 2 and got[0, 3] == got[0, 4] == 5
