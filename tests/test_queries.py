"""Every query with SQL against that SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))


def test_entry_without_llm(spark):
    import subprocess
    import sys

    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 80 and not any(q.startswith('op') for q in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["label", "predicted", "n"] and df.count() > 0
