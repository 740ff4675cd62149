"""Result shards: reading with their checks, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("dataset", "fold", "method")


def read_shards(spark: SparkSession, folder: str, schema: str | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """All CSV shards of a folder by column name; a key column that is absent or a key that two rows
    hold is an error that names the files."""
    r = spark.read.option("header", True)
    df = (r.schema(schema) if schema else r.option("inferSchema", True)).csv(f"{folder}/*.csv").withColumn("_file", F.col("_metadata.file_path"))
    if absent := [k for k in keys if k not in df.columns]:
        raise ValueError(f"the shards lack the columns {absent}")
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.collect_set("_file").alias("files")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError("keys that stand twice: " + "; ".join(f"{tuple(t[k] for k in keys)} in {sorted(t.files)}" for t in twice))
    return df.drop("_file")


def refuse_foreign(df: DataFrame, needed: str = "budget_fraction_nominal") -> None:
    if needed not in df.columns:
        raise ValueError(f"this is another program's output: it has no column {needed!r}")


def write_results(df: DataFrame, folder: str, fmt: str = "csv") -> None:
    """One folder a dataset; an empty result is refused before anything is written."""
    if df.isEmpty():
        raise ValueError("there is nothing to write")
    w = df.write.mode("overwrite").partitionBy("dataset")
    (w.option("header", True).csv if fmt == "csv" else w.parquet)(folder)


def done_units(units: DataFrame, folder_rows: DataFrame) -> DataFrame:
    """Units (dataset, fold) that have no result yet, the largest datasets first."""
    left = units.join(folder_rows.select("dataset", "fold").distinct(), ["dataset", "fold"], "left_anti")
    return left.orderBy(F.desc("n"), "dataset", "fold")
