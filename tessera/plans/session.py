"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of our own only in a local session."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    folder = known.get() if known.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not known.isDefined():
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back.  Unlike a checkpoint the table read has a size,
    so small ones are broadcast, and none of the constraints of the plan that made it, which double with each
    self-join of a loop."""
    path = f"{shared_folder(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
