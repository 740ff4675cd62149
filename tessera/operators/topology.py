"""Graph operators on edge tables: components, Betti numbers, degrees, hops, safe removals.

Iterations run over tables with a fixpoint test and are written between rounds to the shared
checkpoint folder, so a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.session import cut_lineage


def canonical_edges(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, i, j, ord): loops dropped, ends sorted, duplicates merged at their first place."""
    e = edges.where("a <> b").select(*keys, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "ord")
    return e.groupBy(*keys, "i", "j").agg(F.min("ord").alias("ord"))


def both_ways(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return edges.select(*keys, F.col("i").alias("a"), F.col("j").alias("b")).unionByName(edges.select(*keys, F.col("j").alias("a"), F.col("i").alias("b")))


def components(vertex: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, vid, comp): the least vid reachable.

    Each round takes the least label among the neighbours and then follows the label's own label,
    so the reach of a label doubles and long paths take a logarithmic number of rounds.
    """
    keys = list(keys)
    nb = cut_lineage(both_ways(edges, keys))
    cur = cut_lineage(vertex.select(*keys, "vid", F.col("vid").alias("comp")))
    while True:
        seen = nb.join(cur.withColumnsRenamed({"vid": "b", "comp": "other"}), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("other").alias("other")).withColumnRenamed("a", "vid")
        step = cur.join(seen, [*keys, "vid"], "left").select(*keys, "vid", F.least("comp", "other").alias("comp"))
        jump = step.select(*keys, F.col("vid").alias("comp"), F.col("comp").alias("up"))
        new = cut_lineage(step.join(jump, [*keys, "comp"]).select(*keys, "vid", F.least("comp", "up").alias("comp"), "up"))
        same = new.join(cur.withColumnRenamed("comp", "was"), [*keys, "vid"]).where("comp <> was").isEmpty()
        cur = new.select(*keys, "vid", "comp")
        if same:
            return cur


def betti(vertex: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, beta0, beta1): components, and independent cycles E - V + components."""
    keys = list(keys)
    v = components(vertex, edges, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("nv"), F.count_distinct("comp").alias("beta0"))
    e = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("ne"))
    d = v.join(e, keys, "left") if keys else v.crossJoin(e)
    ne = F.coalesce("ne", F.lit(0))
    return d.select(*keys, "beta0", (ne - F.col("nv") + F.col("beta0")).alias("beta1"))


def degrees(vertex: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    keys = list(keys)
    n = both_ways(edges, keys).groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "vid")
    return vertex.select(*keys, "vid").join(n, [*keys, "vid"], "left").na.fill(0, ["degree"])


def adjacency(vertex: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    keys = list(keys)
    n = both_ways(edges, keys).groupBy(*keys, "a").agg(F.array_sort(F.collect_set("b")).alias("neighbours")).withColumnRenamed("a", "vid")
    return vertex.select(*keys, "vid").join(n, [*keys, "vid"], "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<long>")))


def removable(vertex: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Vertices whose removal keeps the homotopy type: leaves, and those of degree 2 whose
    neighbours are not adjacent."""
    keys = list(keys)
    nb = both_ways(edges, keys)
    ends = nb.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("degree"), F.min("b").alias("i"), F.max("b").alias("j")).withColumnRenamed("a", "vid")
    adjacent = edges.select(*keys, "i", "j", F.lit(True).alias("_adj"))
    d = ends.join(adjacent, [*keys, "i", "j"], "left")
    return d.where((F.col("degree") == 1) | ((F.col("degree") == 2) & F.col("_adj").isNull())).select(*keys, "vid", "degree")


def remove_vertex(vertex: DataFrame, edges: DataFrame, vid: int) -> tuple[DataFrame, DataFrame]:
    """Drop a vertex and close the path through it; ids above it move down by one."""
    down = lambda c: F.when(F.col(c) > vid, F.col(c) - 1).otherwise(F.col(c))
    nb = both_ways(edges).where(F.col("a") == vid)
    joined = nb.groupBy().agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("i"), F.max("b").alias("j")).where("n = 2").select("i", "j")
    kept = edges.where((F.col("i") != vid) & (F.col("j") != vid)).select("i", "j").unionByName(joined).distinct()
    v = vertex.where(F.col("vid") != vid)
    return v.withColumn("vid", down("vid")), kept.select(down("i").alias("i"), down("j").alias("j"))


#: Vertices and edge ends of a graph that may go to every task, distances held while a block of sources is walked, and pairs of a task.
GRAPH_CELLS, WALK_CELLS, TASK_PAIRS = 20_000_000, 2_000_000, 20_000_000


def walk(start: np.ndarray, first: np.ndarray, to: np.ndarray, most: int | None = None) -> np.ndarray:
    """(starts, vertices) hops from each start along ``to[first[v] : first[v + 1]]``, -1 where there is no way.  A round extends only
    the frontiers, so a block costs its starts times the edges, however long the ways are."""
    n = len(first) - 1
    hop = np.full(len(start) * n, -1, dtype=np.int32)
    at, base = np.asarray(start, dtype=np.int64), np.arange(len(start), dtype=np.int64) * n
    hop[base + at], k = 0, 0
    while len(at) and (most is None or k < most):
        k += 1
        lo = first[at]
        deg = first[at + 1] - lo
        end = np.cumsum(deg)
        nxt = to[np.repeat(lo - end + deg, deg) + np.arange(end[-1])]
        base = np.repeat(base, deg)
        fresh = np.flatnonzero(hop[base + nxt] == -1)
        nxt, base = nxt[fresh], base[fresh]
        mine = -2 - np.arange(len(nxt), dtype=np.int32)  # of several ways to a vertex one stays
        hop[base + nxt] = mine
        once = hop[base + nxt] == mine
        at, base = nxt[once], base[once]
        hop[base + at] = k
    return hop.reshape(len(start), n)


def hops(vertex: DataFrame, edges: DataFrame, most: int | None = None, cells: int = GRAPH_CELLS) -> DataFrame:
    """(src, dst, hop) for all pairs; unreachable pairs, and those over ``most`` hops apart where it is given, have hop = number of vertices.

    A graph within ``cells``, counted first, goes to every task; tasks walk it from blocks of sources and hand out the pairs as they
    are found, so that no pair is shuffled or written.  A larger one is walked by tables, from every vertex at once.
    """
    n, named = vertex.agg(F.count(F.lit(1)), F.count("vid")).first()
    edges = cut_lineage(edges.select("i", "j"))  # counted and read; they may cost a search
    if n > named or n + 2 * edges.count() > cells:
        return _hops_by_tables(vertex, edges, n, most)
    import pyarrow as pa

    spark = vertex.sparkSession
    v = vertex.select("vid").toArrow().column(0).to_numpy()
    e = edges.select("i", "j").where("i IS NOT NULL AND j IS NOT NULL").toArrow()
    i, j = e.column(0).to_numpy(), e.column(1).to_numpy()
    names, where = np.unique(np.concatenate([v, i, j]), return_inverse=True)
    pos, i, j = where[:n], where[n : n + len(i)], where[n + len(i) :]
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(names)))])
    sent = spark.sparkContext.broadcast((names, first, b[np.argsort(a, kind="stable")], pos, v))

    def run(batches):
        names, first, to, pos, dst = sent.value
        step = max(1, WALK_CELLS // max(1, len(names)))
        for batch in batches:
            src = batch.column(0).to_numpy()
            for lo in range(0, len(src), step):
                own = src[lo : lo + step]
                hop = walk(np.searchsorted(names, own), first, to, most)[:, pos].astype(np.int64)
                hop[hop < 0] = len(dst)
                cols = np.repeat(own, len(dst)), np.tile(dst, len(own)), hop.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["src", "dst", "hop"])

    parts = max(spark.sparkContext.defaultParallelism, min(n, -(-n * n // TASK_PAIRS)))
    kind = dict(vertex.dtypes)["vid"]
    return vertex.select("vid").repartition(parts, "vid").mapInArrow(run, f"src {kind}, dst {kind}, hop long")


def _hops_by_tables(vertex: DataFrame, edges: DataFrame, n: int, most: int | None) -> DataFrame:
    nb = cut_lineage(both_ways(edges))
    seen = cut_lineage(vertex.select(F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(0).cast("long").alias("hop")))
    front, k = seen, 0
    while k < (n if most is None else min(n, most)):
        k += 1
        step = front.join(nb, F.col("dst") == F.col("a")).select("src", F.col("b").alias("dst")).distinct().join(seen, ["src", "dst"], "left_anti")
        front = cut_lineage(step.withColumn("hop", F.lit(k).cast("long")))
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front))
    every = vertex.select(F.col("vid").alias("src")).crossJoin(vertex.select(F.col("vid").alias("dst")))
    return every.join(seen, ["src", "dst"], "left").na.fill(n, ["hop"])
