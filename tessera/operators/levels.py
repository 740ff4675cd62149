"""The partition reducer by levels: every subset of a level is split at once.

A subset of more than one class is cut by its farthest pair into the rows nearer to either end.  Subsets carry the path of
their cuts as a column.  A level finds the pairs of all its subsets by products of tiles (in one task each within ``PAIR_ROWS`` rows, in a task for each two
chunks of that size beyond), joins them back and extends the paths; pure and coincident subsets are averaged by one grouping whatever
their size, and a subset of at most ``SUBSET_ROWS`` rows is cut to its end in one task.  So no task holds more rows
than the larger bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import mean_vector, sq_dist
from tessera.operators import balls
from tessera.operators.reducers import GENERATED, farthest, partition
from tessera.plans.session import cut_lineage

SUBSET_ROWS = 4096
PAIR_ROWS = 40_000


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its place from 0 by ``order``: ranges, a count a range, and places within it; nothing is sorted in one task."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), at.alias("_at")))
    n = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = n.select("_part", (before - F.col("_first")).alias("_shift"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _pairs(rows: DataFrame, sizes: DataFrame, pair_rows: int, units: int) -> DataFrame:
    """(path, xi, xj, d): the two ends of the farthest pair of each subset (path, n) of ``sizes``, and their distance.

    A subset's rows are dealt to chunks of about ``pair_rows``; a task takes two chunks, or one by itself, so there are ``units`` of them in all
    and a row goes to as many as its subset has chunks."""
    import pyarrow as pa

    chunks = F.ceil(F.col("n") / pair_rows).cast("int").alias("_chunks")
    d = rows.join(sizes.select("path", chunks), "path").withColumn("_own", F.pmod(F.xxhash64("row_id"), F.col("_chunks")).cast("int"))
    d = d.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    d = d.select("path", F.least("_own", "_with").alias("_a"), F.greatest("_own", "_with").alias("_b"), "_own", "row_id", "x")
    names = ["path", "xi", "xj", "d", "i", "j"]

    def one(key, t):
        x, ids, own = balls.vectors(t.column("x").combine_chunks()), t.column("row_id").to_numpy(), t.column("_own").to_numpy()
        path, a, b = (k.as_py() for k in key)
        left = own == a
        found = farthest(x, ids) if a == b else farthest(x[left], ids[left], x[~left], ids[~left])
        if found is None:
            found = (-1.0, int(ids[0]), int(ids[0]))
        ends = [x[np.flatnonzero(ids == k)[0]].tolist() for k in found[1:]]
        kinds = (pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int64())
        return pa.table([pa.array([v], k) for v, k in zip((path, *ends, *found), kinds, strict=True)], names)

    # By hash several units would meet in one task, so there are more tasks than units, up to a bound.
    d = d.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, min(3 * units, 400)), "path", "_a", "_b")
    found = d.groupBy("path", "_a", "_b").applyInArrow(one, "path string, xi array<double>, xj array<double>, d double, i long, j long")
    best = F.max(F.struct("d", -F.col("i"), -F.col("j"), "xi", "xj")).alias("m")
    return found.groupBy("path").agg(best).select("path", "m.xi", "m.xj", "m.d")


def rsp3(points: DataFrame, subset_rows: int = SUBSET_ROWS, pair_rows: int = PAIR_ROWS, levels: list | None = None) -> DataFrame:
    """(proto_id, label, features, source_row) of points (row_id, label, x): the class means of all final subsets, by label and
    components.  ``levels`` gets the number of subsets cut at each level."""
    kind = dict(points.dtypes)["label"]
    rows = cut_lineage(points.select("row_id", "label", "x", F.lit("").alias("path")))
    dims = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    means, small = [], []
    while True:
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), (F.min("label") < F.max("label")).alias("mixed"))
        sizes = cut_lineage(sizes)
        large = sizes.where(F.col("mixed") & (F.col("n") > subset_rows))
        small.append(rows.join(sizes.where(F.col("mixed") & (F.col("n") <= subset_rows)), "path", "left_semi"))
        means.append(rows.join(sizes.where(~F.col("mixed")), "path", "left_semi"))
        chunks = F.ceil(F.col("n") / pair_rows)
        n, units = large.agg(F.count(F.lit(1)), F.coalesce(F.sum(chunks * (chunks + 1) / 2), F.lit(0)).cast("long")).first()
        if levels is not None:
            levels.append(n)
        if not n:
            break
        pairs = cut_lineage(_pairs(rows, large, pair_rows, units))
        means.append(rows.join(pairs.where("d <= 0"), "path", "left_semi"))
        far = lambda end: F.sqrt(sq_dist(F.col("x"), F.col(end)))
        side = F.when(far("xi") > far("xj"), "j").otherwise("i")
        rows = cut_lineage(rows.join(pairs.where("d > 0"), "path").select("row_id", "label", "x", F.concat("path", side).alias("path")))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        p, y, _ = partition(np.stack(pdf.x.to_numpy()).astype(float), pdf.label.to_numpy())
        return pd.DataFrame({"label": y, "features": list(p)})

    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    done = union(means).groupBy("path", "label").agg(mean_vector(F.col("x"), dims).alias("features")).select("label", "features")
    # The ends of cutting cost more than their bytes tell, and are read twice: dealt to many tasks, and written.
    tasks = max(4 * points.sparkSession.sparkContext.defaultParallelism, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rest = union(small).select("path", "row_id", "label", "x").repartition(tasks, "path").groupBy("path").applyInPandas(finish, f"label {kind}, features array<double>")
    return numbered(cut_lineage(done.unionByName(rest)), ["label", "features"], "proto_id").select("proto_id", F.col("label").cast("int").alias("label"), "features", F.lit(GENERATED).cast("long").alias("source_row"))
