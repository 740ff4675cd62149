"""Data sets that a manifest describes, read with its checks.

A manifest is JSON: a name to ``file`` (.dat, .arff, or .zip with ``member``, the end of its one member's name), ``n`` rows, ``classes``, and
where known ``d`` inputs, ``sha256`` of the file and ``class_names`` (what the class column may be called).  ``register(spark)``, then

    spark.read.format("manifest").option("manifest", m).option("folder", f).option("names", "a,b").load()

gives (dataset, row_id, raw_label, features).  A file is a partition and is streamed line by line; whatever differs from the
manifest fails the task, and with it the read.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import math
import os
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.keel import parse_header

SCHEMA = "dataset string, row_id long, raw_label string, features array<double>"
FIELDS = {"file", "member", "n", "d", "classes", "sha256", "class_names"}


def check_manifest(entries: dict) -> dict:
    """The entries, if each has its fields and none that is unknown."""
    for name, e in entries.items():
        if absent := [f for f in ("file", "n", "classes") if f not in e]:
            raise ValueError(f"{name}: the manifest lacks {absent}")
        if more := sorted(set(e) - FIELDS):
            raise ValueError(f"{name}: unknown manifest fields {more}")
        if e["file"].endswith(".zip") and not e.get("member"):
            raise ValueError(f"{name}: an archive needs the name of its member")
    return entries


def digest(path: str, block: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(block):
            h.update(data)
    return h.hexdigest()


@contextlib.contextmanager
def opened(path: str, member: str | None) -> Iterator:
    """The text of a file, or of the one member of an archive whose name ends so."""
    if not path.endswith(".zip"):
        with open(path, encoding="utf-8") as f:
            yield f
        return
    if not zipfile.is_zipfile(path):
        raise ValueError(f"{path} is no zip archive")
    with zipfile.ZipFile(path) as z:
        found = [m for m in z.namelist() if m.endswith(member)]
        if len(found) != 1:
            raise ValueError(f"{path} holds {len(found)} members that end in {member}: {found}")
        with z.open(found[0]) as raw:
            yield io.TextIOWrapper(raw, encoding="utf-8")


def checked_rows(name: str, entry: dict, folder: str) -> Iterator[tuple]:
    """Rows of one data set in the order of its lines; the counts are checked behind the last."""
    path = os.path.join(folder, entry["file"])
    if not os.path.exists(path):
        raise FileNotFoundError(f"{name}: there is no {path}")
    if entry.get("sha256") and (got := digest(path)) != entry["sha256"]:
        raise ValueError(f"{name}: the file's sha256 is {got}, the manifest's {entry['sha256']}")
    n, classes = 0, set()
    with opened(path, entry.get("member")) as lines:
        head = []
        for line in lines:
            head.append(line)
            if line.strip().lower().startswith("@data"):
                break
        h = parse_header(head)
        if bad := [c for c, nominal in zip(h.names, h.nominal, strict=True) if nominal and c != h.output]:
            raise ValueError(f"{name}: nominal inputs {bad}")
        if entry.get("class_names") and h.output.lower() not in entry["class_names"]:
            raise ValueError(f"{name}: the class column is {h.output!r}, not one of {entry['class_names']}")
        if entry.get("d") is not None and len(h.inputs) != entry["d"]:
            raise ValueError(f"{name}: {len(h.inputs)} inputs, the manifest has {entry['d']}")
        at = h.names.index(h.output)
        for line in lines:
            if not (line := line.strip()) or line.startswith("%"):
                continue
            cells = [c.strip() for c in line.split(",")]
            if len(cells) != len(h.names):
                raise ValueError(f"{name}: expected {len(h.names)} cells: {line}")
            values = [float(c) for i, c in enumerate(cells) if i != at]
            if not all(map(math.isfinite, values)):
                raise ValueError(f"{name}: a value is not finite: {line}")
            label = cells[at].strip("'\"")
            classes.add(label)
            if len(classes) > entry["classes"]:
                raise ValueError(f"{name}: more than {entry['classes']} classes")
            yield name, n, label, values
            n += 1
    if n != entry["n"]:
        raise ValueError(f"{name}: {n} rows, the manifest has {entry['n']}")
    if len(classes) != entry["classes"]:
        raise ValueError(f"{name}: {len(classes)} classes, the manifest has {entry['classes']}")


class ManifestReader(DataSourceReader):
    def __init__(self, options):
        with open(options["manifest"], encoding="utf-8") as f:
            entries = check_manifest(json.load(f))
        wanted = [s for s in options.get("names", "").split(",") if s] or sorted(entries)
        if unknown := [s for s in wanted if s not in entries]:
            raise KeyError(f"not in the manifest: {unknown}; it has {sorted(entries)}")
        self.folder, self.entries = options["folder"], {s: entries[s] for s in wanted}

    def partitions(self):
        return [InputPartition(s) for s in self.entries]

    def read(self, partition):
        yield from checked_rows(partition.value, self.entries[partition.value], self.folder)


class ManifestSource(DataSource):
    @classmethod
    def name(cls):
        return "manifest"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ManifestReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ManifestSource)


def load(spark: SparkSession, manifest: str, folder: str, names: tuple[str, ...] = ()) -> DataFrame:
    """(dataset, row_id, label, raw_label, x): the named data sets, or all; labels are coded within a data set in the order of their text."""
    register(spark)
    rows = spark.read.format("manifest").option("manifest", manifest).option("folder", folder).option("names", ",".join(names)).load()
    labels = rows.select("dataset", "raw_label").distinct()
    codes = labels.withColumn("label", (F.row_number().over(Window.partitionBy("dataset").orderBy("raw_label")) - 1).cast("int"))
    return rows.join(codes, ["dataset", "raw_label"]).select("dataset", "row_id", "label", "raw_label", F.col("features").alias("x"))
