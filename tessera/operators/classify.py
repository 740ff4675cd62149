"""Classifiers trained on prototypes and scored on test rows.

``1nn`` is the engine's own; ``svm`` and ``mlp`` are Spark ML's.  Spark ML has a linear support
vector machine only, one against the rest, so ``svm`` approximates a kernel machine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.neighbors import nearest


def classify(prototypes: DataFrame, test: DataFrame, kind: str = "1nn", seed: int = 0) -> DataFrame:
    """(row_id, label, predicted) from prototypes(proto_id, label, v) and test(row_id, label, x)."""
    if kind == "1nn":
        near = nearest(test.select("row_id", "x"), prototypes.select("proto_id", "v", F.col("label").alias("predicted")), ["predicted"])
        return test.select("row_id", "label").join(near.select("row_id", "predicted"), "row_id")
    from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, OneVsRest
    from pyspark.ml.functions import array_to_vector

    train = prototypes.select(F.col("label").cast("double").alias("label"), array_to_vector("v").alias("features"))
    rows = test.select("row_id", F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))
    if kind == "svm":
        model = OneVsRest(classifier=LinearSVC(maxIter=25, regParam=1e-3)).fit(train)
    elif kind == "mlp":
        width, classes = prototypes.agg(F.max(F.size("v")), F.max("label")).first()
        model = MultilayerPerceptronClassifier(layers=[width, 100, int(classes) + 1], maxIter=50, seed=seed).fit(train)
    else:
        raise ValueError(f"unknown classifier {kind!r}")
    return model.transform(rows).select("row_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
