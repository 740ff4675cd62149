"""Partition archives: ten folds before five, and what stands in for an absent one."""

import zipfile

import pytest

from tessera.sources import keel

HEAD = "@relation r\n@attribute a real\n@attribute class {u, v}\n@data\n"


def _archive(path, k, rows=20):
    with zipfile.ZipFile(path, "w") as z:
        for f in range(1, k + 1):
            for part, keep in (("tra", lambda i, f=f: i % k != f - 1), ("tst", lambda i, f=f: i % k == f - 1)):
                z.writestr(f"r/r-{k}-{f}{part}.dat", HEAD + "".join(f"{i}.0, {'uv'[i // 10]}\n" for i in range(rows) if keep(i)))


def _folds(df):
    return {(r.n_folds, r.fold, r.is_test): r.n for r in df.groupBy("n_folds", "fold", "is_test").count().withColumnRenamed("count", "n").collect()}


@pytest.mark.parametrize("stand_in", [None, "", "<html>not found</html>"])
def test_five_stand_in_for_ten(spark, tmp_path, stand_in):
    _archive(tmp_path / "r-5-fold.zip", 5)
    if stand_in is not None:
        (tmp_path / "r-10-fold.zip").write_text(stand_in)
    got = _folds(keel.read_partition_archives(spark, str(tmp_path), "r"))
    assert got == {(5, f, t): 4 if t else 16 for f in range(1, 6) for t in (True, False)}


def test_ten_come_first(spark, tmp_path):
    _archive(tmp_path / "r-5-fold.zip", 5)
    _archive(tmp_path / "r-10-fold.zip", 10)
    df = keel.read_partition_archives(spark, str(tmp_path), "r")
    assert set(_folds(df).values()) == {2, 18} and {r.n_folds for r in df.collect()} == {10}
    assert {(r.raw_label, r.label) for r in df.collect()} == {("u", 0), ("v", 1)}


def test_none(spark, tmp_path):
    (tmp_path / "other.txt").write_text("x")
    with pytest.raises(FileNotFoundError, match="no ten or five folds"):
        keel.read_partition_archives(spark, str(tmp_path), "r")
