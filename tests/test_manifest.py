"""A manifest's checks: each departure is refused."""

import hashlib
import json
import zipfile

import pytest

from tessera.plans import campaign as K
from tessera.sources import manifest as M

HEAD = "@relation r\n@attribute a real\n@attribute b real\n@attribute class {u, v}\n@data\n"
ROWS = "1.0, 2.0, v\n3.5, 4.0, u\n\n% remark\n5.0, 6.0, v\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "plain.dat").write_text(HEAD + ROWS)
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("in/one.dat", HEAD + "".join(f"{i}.0, {i % 3}.5, {'uv'[i % 2]}\n" for i in range(20)))
        z.writestr("readme.txt", "no")
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a/two.dat", HEAD + ROWS)
        z.writestr("b/two.dat", HEAD + ROWS)
    (tmp_path / "broken.zip").write_text("not found")
    return tmp_path


PLAIN = {"file": "plain.dat", "n": 3, "d": 2, "classes": 2}
ONE = {"file": "one.zip", "member": "one.dat", "n": 20, "classes": 2}


def _load(spark, folder, entries, names=()):
    (folder / "m.json").write_text(json.dumps(entries))
    return M.load(spark, str(folder / "m.json"), str(folder), names)


def test_all_sets_at_once(spark, folder):
    sha = hashlib.sha256((folder / "plain.dat").read_bytes()).hexdigest()
    df = _load(spark, folder, {"plain": {**PLAIN, "sha256": sha, "class_names": ["class"]}, "one": ONE})
    got = sorted((r.row_id, r.label, r.raw_label, list(r.x)) for r in df.where("dataset = 'plain'").collect())
    assert got == [(0, 1, "v", [1.0, 2.0]), (1, 0, "u", [3.5, 4.0]), (2, 1, "v", [5.0, 6.0])]
    assert df.count() == 23 and df.rdd.getNumPartitions() >= 1
    rows = K.run_campaign(K.with_folds(df.where("dataset = 'one'"), 2), 2, ("Random",)).collect()
    assert {(r.dataset, r.n_train) for r in rows} == {("one", 10)}
    assert _load(spark, folder, {"plain": PLAIN, "gone": {**PLAIN, "file": "gone.dat"}}, ("plain",)).count() == 3  # only what is named is read


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"n": 4}, "3 rows, the manifest has 4"),
        ({"d": 3}, "2 inputs, the manifest has 3"),
        ({"classes": 3}, "2 classes, the manifest has 3"),
        ({"classes": 1}, "more than 1 classes"),
        ({"sha256": "0" * 64}, "sha256"),
        ({"class_names": ["target"]}, "class column"),
        ({"file": "gone.dat"}, "there is no"),
        ({"file": "two.zip", "member": "two.dat"}, "holds 2 members"),
        ({"file": "two.zip", "member": "other.dat"}, "holds 0 members"),
        ({"file": "broken.zip", "member": "x.dat"}, "no zip archive"),
    ],
)
def test_refusals(folder, change, message):
    entry = M.check_manifest({"x": {**PLAIN, **change}})["x"]
    with pytest.raises((ValueError, FileNotFoundError), match=message):
        list(M.checked_rows("x", entry, str(folder)))


@pytest.mark.parametrize(("row", "message"), [("1.0, nan, u", "not finite"), ("1.0, u", "expected 3 cells"), ("1.0, ?, u", "could not convert")])
def test_bad_rows(folder, row, message):
    (folder / "plain.dat").write_text(HEAD + ROWS + row + "\n")
    with pytest.raises(ValueError, match=message):
        list(M.checked_rows("x", PLAIN, str(folder)))


def test_a_refusal_fails_the_read(spark, folder):
    with pytest.raises(Exception, match="3 rows, the manifest has 4"):
        _load(spark, folder, {"plain": {**PLAIN, "n": 4}}).collect()
    with pytest.raises(Exception, match="not in the manifest"):
        _load(spark, folder, {"plain": PLAIN}, ("other",)).collect()


@pytest.mark.parametrize(("entry", "message"), [({"file": "a.dat", "n": 1}, "lacks"), ({**PLAIN, "rows": 1}, "unknown"), ({"file": "a.zip", "n": 1, "classes": 1}, "archive needs")])
def test_bad_manifests(entry, message):
    with pytest.raises(ValueError, match=message):
        M.check_manifest({"x": entry})
