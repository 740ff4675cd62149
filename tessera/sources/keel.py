"""KEEL ``.dat`` and ARFF text as tables.

The header is a few lines, read first and checked strictly; the data lines are split and cast by
Spark, and a line of another width or a cell that is no number stops the read with its text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ATTRIBUTE = re.compile(r"@attribute\s+('[^']*'|\"[^\"]*\"|[^\s{\[]+)\s*(.*)$", re.IGNORECASE)


@dataclass
class Header:
    names: list[str] = field(default_factory=list)
    nominal: list[bool] = field(default_factory=list)
    inputs: list[str] = field(default_factory=list)
    output: str = ""


def parse_header(lines: list[str]) -> Header:
    """The header lines up to @data.  The class is the declared output or the last attribute."""
    h, outputs, ended = Header(), [], False
    for raw in lines:
        line = raw.strip()
        if not line or line.startswith("%"):
            continue
        word = line.split(None, 1)[0].lower()
        rest = line[len(word) :].strip()
        if word == "@relation":
            continue
        if word == "@attribute":
            m = _ATTRIBUTE.match(line)
            if not m:
                raise ValueError(f"cannot read the attribute line {line!r}")
            kind = m[2].strip().lower()
            h.names.append(m[1].strip("'\""))
            h.nominal.append(kind.startswith("{") or kind.startswith("string"))
        elif word in ("@inputs", "@input"):
            h.inputs = [x.strip() for x in rest.split(",") if x.strip()]
        elif word in ("@outputs", "@output"):
            outputs = [x.strip() for x in rest.split(",") if x.strip()]
        elif word == "@data":
            ended = True
            break
        else:
            raise ValueError(f"unknown header line {line!r}")
    if not ended or not h.names:
        raise ValueError("no attributes or no @data line")
    if len(outputs) > 1:
        raise ValueError(f"more than one output: {outputs}")
    h.output = outputs[0] if outputs else h.names[-1]
    if h.output not in h.names:
        raise ValueError(f"the output {h.output!r} is no attribute")
    rest = [n for n in h.names if n != h.output]
    if h.inputs and h.inputs != rest:
        raise ValueError(f"inputs {h.inputs} differ from the attributes {rest}")
    h.inputs = rest
    return h


def parse_rows(lines: DataFrame, header: Header, line: str = "value") -> DataFrame:
    """raw_label and features from data lines; other columns stay."""
    cells = F.transform(F.split(F.trim(line), ","), lambda c: F.trim(c))
    width = len(header.names)
    wrong = F.concat(F.lit(f"expected {width} cells: "), F.col(line))
    d = lines.where((F.trim(line) != "") & ~F.trim(line).startswith("%")).withColumn("_c", F.when(F.size(cells) == width, cells).otherwise(F.raise_error(wrong).cast("array<string>")))
    at = header.names.index(header.output)
    number = lambda i: F.coalesce(F.expr(f"try_cast(_c[{i}] AS DOUBLE)"), F.raise_error(F.concat(F.lit(f"column {header.names[i]} is not numeric: "), F.get("_c", i))).cast("double"))
    features = F.array(*[number(i) for i in range(width) if i != at])
    return d.withColumns({"raw_label": F.trim(F.col("_c")[at], F.lit("'\"")), "features": features}).drop("_c", line)


def _header_of(text: DataFrame) -> Header:
    """Header lines of the first file: those before its @data line, few by the format."""
    head = text.where(F.col("value").rlike(r"^\s*@")).limit(10_000).collect()
    lines = [r.value for r in head]
    stop = next((i for i, x in enumerate(lines) if x.strip().lower().startswith("@data")), len(lines) - 1)
    return parse_header(lines[: stop + 1])


def read_keel(spark: SparkSession, path: str, numeric_only: bool = True) -> DataFrame:
    """(raw_label, features) of a .dat or .arff file."""
    text = spark.read.text(path)
    header = _header_of(text)
    if numeric_only and any(n for n, name in zip(header.nominal, header.names, strict=True) if name != header.output):
        raise ValueError("nominal inputs are not supported")
    return parse_rows(text.where(~F.col("value").rlike(r"^\s*@")), header)


def read_arff(spark: SparkSession, path: str, class_names: tuple[str, ...] = ()) -> DataFrame:
    """ARFF with a nominal class in the last column; ``class_names``: what that column may be called."""
    text = spark.read.text(path)
    header = _header_of(text)
    if class_names and header.output.lower() not in class_names:
        raise ValueError(f"the class column is {header.output!r}, not one of {class_names}")
    return parse_rows(text.where(~F.col("value").rlike(r"^\s*@")), header)


#: Names of partition files: dataset, number of folds, fold, training or test part.
PARTITION = r"([^/]+)-(\d+)-(\d+)t(ra|st)\.dat$"


def read_partitions(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(raw_label, label, features, fold, n_folds, is_test) of a folder of published partitions; ten
    folds are preferred to five, labels are coded over all files, and a fold's two parts must
    cover as many rows in every fold."""
    return _partition_rows(spark.read.text(f"{folder}/*.dat").withColumn("_file", F.col("_metadata.file_path")), folder, name)


def read_partition_archives(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same of archives ``<name>-10-fold.zip`` or ``<name>-5-fold.zip`` in a folder.  The one of ten folds is taken unless it is
    absent, empty or no zip archive (what a server sends for a partition that it does not have)."""
    for k in (10, 5):
        kept = _archive_lines(spark, f"{folder}/{name}-{k}-fold.zip")
        if kept is not None:
            return _partition_rows(kept.select("value", F.col("member").alias("_file")), folder, name)
    raise FileNotFoundError(f"no ten or five folds of {name} in {folder}")


def _archive_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """Lines of an archive's .dat members; nothing where there is no such archive."""
    folder, file = path.rsplit("/", 1)
    found = spark.read.format("binaryFile").option("pathGlobFilter", file).load(folder)
    whole = found.where((F.col("length") > 0) & (F.hex(F.substring("content", 1, 4)) == "504B0304"))
    return None if whole.isEmpty() else read_zip_lines(spark, path)


def _partition_rows(text: DataFrame, folder: str, name: str) -> DataFrame:
    """Rows of partition files' lines (value, _file), after their checks."""
    from tessera.operators.prepare import encode_labels

    text = text.withColumns({"_name": F.regexp_extract("_file", PARTITION, 1), "n_folds": F.regexp_extract("_file", PARTITION, 2).cast("int"), "fold": F.regexp_extract("_file", PARTITION, 3).cast("int"), "is_test": F.regexp_extract("_file", PARTITION, 4) == "st"})
    text = text.where(F.col("_name") == name)
    found = {r.n_folds for r in text.select("n_folds").distinct().collect()}
    k = next((k for k in (10, 5) if k in found), None)
    if k is None:
        raise FileNotFoundError(f"no ten or five folds of {name} in {folder}")
    text = text.where(F.col("n_folds") == k)
    header = _header_of(text.where((F.col("fold") == 1) & ~F.col("is_test")).select("value"))
    rows = parse_rows(text.where(~F.col("value").rlike(r"^\s*@")), header).drop("_file", "_name")
    sizes = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).agg(F.count_distinct("n"), F.count(F.lit(1))).first()
    if tuple(sizes) != (1, k):
        raise ValueError(f"the {k} folds of {name} do not cover the same rows")
    return encode_labels(rows, "raw_label")


class KeelSource:
    """Python data source: ``register(spark)``, then ``spark.read.format("keel").load(path)``."""

    @staticmethod
    def register(spark: SparkSession) -> None:
        from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

        class Reader(DataSourceReader):
            def __init__(self, path):
                self.path = path

            def partitions(self):
                import glob

                return [InputPartition(p) for p in sorted(glob.glob(self.path))]

            def read(self, partition):
                with open(partition.value, encoding="utf-8") as f:
                    lines = f.read().splitlines()
                n = next(i for i, x in enumerate(lines) if x.strip().lower().startswith("@data"))
                h = parse_header(lines[: n + 1])
                at = h.names.index(h.output)
                for line in filter(None, map(str.strip, lines[n + 1 :])):
                    cells = [c.strip() for c in line.split(",")]
                    if len(cells) != len(h.names):
                        raise ValueError(f"expected {len(h.names)} cells: {line}")
                    yield cells[at], [float(c) for i, c in enumerate(cells) if i != at]

        class Source(DataSource):
            @classmethod
            def name(cls):
                return "keel"

            def schema(self):
                return "raw_label string, features array<double>"

            def reader(self, schema):
                return Reader(self.options["path"])

        spark.dataSource.register(Source)


def read_zip_lines(spark: SparkSession, path: str, suffix: str = ".dat") -> DataFrame:
    """(archive, member, line_no, value) of the text members of zip archives, one archive a task."""
    import io
    import zipfile

    import pandas as pd

    def lines(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in sorted(x for x in z.namelist() if x.endswith(suffix)):
                        text = z.read(m).decode("utf-8").splitlines()
                        yield pd.DataFrame({"archive": name, "member": m, "line_no": range(len(text)), "value": text})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(lines, "archive string, member string, line_no long, value string")
