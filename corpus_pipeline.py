"""The training-data pipeline: toxicity, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows
to the shared folder and reads them back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import linededup, mixing, packing, setjoin, toxicity
from tessera.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; one pass over the texts, nothing moves."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.column(F.col("text")) < toxicity.THRESHOLD)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars follows the new text."""
    d = linededup.dedup_lines(docs)
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_dropped") == 0, F.col("doc.n_chars")).otherwise(F.char_length("kept").cast("long"))}
    return d.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a 5-word Jaccard likeness of 0.8: the smallest doc_id (null last)."""
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))  # no name of theirs meets one of ours
    if rows != ids:  # ids that are null or repeat cannot name a row: number the rows
        held = Scratch(spark).keep(held.withColumn("row", F.monotonically_increasing_id()), "numbered")
        by_row = setjoin.near_duplicates(held.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))).select(F.col("doc_id").alias("row"), "component_id")
        named = by_row.join(held.select("row", F.col("doc.doc_id").alias("id")), "row")
        first = F.min(F.struct(F.col("id").isNull(), "id", "row"))
        keep = named.groupBy("component_id").agg(first.alias("first")).select("first.row")
    else:
        held = held.withColumn("row", F.col("doc.doc_id"))
        keep = setjoin.near_duplicates(docs.select("doc_id", "text")).where("doc_id = component_id").select(F.col("doc_id").alias("row"))
    return held.join(keep, "row", "left_semi").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near duplicates", drop_near_duplicates), ("mixing", mix), ("packing", pack)]

#: Toxicity, near-duplicates and packing are not SQL; tests/llm holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
