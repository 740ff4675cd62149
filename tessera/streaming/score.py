"""Scoring a stream against a frozen skeleton.

The model tables are static and within a proven bound; a micro-batch streams by them as a
stream-static join, without state.  Counts over event time use a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.segments import class_distances, object_distances, predict


def score_batch(points: DataFrame, vertex: DataFrame, segment: DataFrame) -> DataFrame:
    return predict(class_distances(object_distances(points, vertex, segment), ["row_id"]), ["row_id"])


def start(stream: DataFrame, vertex: DataFrame, segment: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Writes the predictions of each micro-batch to ``path`` as Parquet; a replayed batch rewrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch, vertex, segment).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))
