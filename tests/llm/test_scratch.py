"""Disk of the near-duplicates: shuffle files and tables go when nothing reads them any more."""

import os

from pyspark.sql import functions as F

from tessera.llm import setjoin
from tessera.llm.common import FREE_SHUFFLES, Scratch


def shuffles(spark) -> int:
    """Shuffles with files that a block manager holds."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).name().startswith("shuffle_") for i in range(blocks.length()))


def test_a_kept_table_leaves_no_shuffle_files(spark):
    import time

    before, held = shuffles(spark), spark.conf.get(FREE_SHUFFLES, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    kept = Scratch(spark).keep(df, "sums")
    for _ in range(50):  # files are deleted behind the query's back
        if shuffles(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffles(spark) <= before
    assert kept.count() == 7 and spark.conf.get(FREE_SHUFFLES, None) == held


def test_near_duplicates_leave_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tessera.llm.common.scratch_root", lambda _: f"file://{tmp_path}")
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " eleven"), (4, "another text"), (5, None), (6, "")], "doc_id long, text string")
    out = setjoin.near_duplicates(docs)
    assert {tuple(r) for r in out.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)}
    tables = [t for top in os.listdir(tmp_path) for t in os.listdir(tmp_path / top)]
    assert [t.split("-", 1)[1] for t in tables] == ["components"]


def test_sketches_let_every_alike_pair_through(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64)) for _ in range(6)]
    every = [np.unique(np.concatenate([b[k:], rng.integers(0, 2**64, k, dtype=np.uint64)])) for b in base for k in range(0, 12)] + [np.empty(0, np.uint64)] * 2
    thinned = [setjoin.thin(s) for s in every]
    rows = [(i, len(t) // 5, setjoin.odd_sketch(setjoin.wide(t)), t) for i, t in enumerate(thinned)]
    sets = spark.createDataFrame(rows, "id long, size long, sketch binary, hashes binary")
    ids = range(len(rows))
    pairs = spark.createDataFrame([(i, j) for i in ids for j in ids if i < j], "a long, b long")
    want = {(i, j) for i in ids for j in ids if i < j and setjoin.alike(setjoin.wide(thinned[i]), setjoin.wide(thinned[j]))}
    maybe = {tuple(r) for r in setjoin.possible(pairs, sets).collect()}
    assert want <= maybe and len(maybe) < pairs.count() / 4
    assert {tuple(r) for r in setjoin.confirmed(pairs, sets, Scratch(spark)).collect()} == want
