"""Spanning edges between the components of a graph on points, by rounds over tables.

Boruvka: in a round every component finds its nearest row of another component, and the edges found merge components.  Components
at least halve a round.  A row is sent only to the balls (``balls``) that its component's bound reaches: the
least, over the component's rows, of the distance within which a ball surely holds a row of another.  Edges are
turned away from a root by an Euler tour of their tree, ranked by pointer doubling, so neither step needs a
round a component or the tree on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.balls import BALL_ROWS, DECIMALS, PIVOTS, Balls, lengths, meet, sends, slack, vectors
from tessera.operators.density import squared
from tessera.operators.topology import components
from tessera.plans.session import cut_lineage


def _bounds(rows: DataFrame, balls: Balls, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """(comp, bound): within which each component surely meets another; low and high are the least and largest
    component of each ball."""
    import pyarrow as pa

    sent = rows.sparkSession.sparkContext.broadcast((balls.pivots, balls.radius, low, high))

    def run(batches: Iterator) -> Iterator:
        c, radius, low, high = sent.value
        step = max(1, 4_000_000 // max(1, len(c)))
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                x, own = vectors(part.column(1)), part.column(0).to_numpy()[:, None]
                far = lengths(x, c) + radius + slack(x, c)
                bound = pd.Series(np.where((low == own) & (high == own), np.inf, far).min(axis=1)).groupby(own[:, 0]).min()
                yield pa.RecordBatch.from_arrays([pa.array(bound.index.to_numpy()), pa.array(bound.to_numpy())], ["comp", "bound"])

    return rows.select("comp", "x").mapInArrow(run, "comp long, bound double").groupBy("comp").agg(F.min("bound").alias("bound"))


def _nearest_other(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For each component of the left rows: the nearest right row of another, ties to the least ids of the two ends."""
    out = {"comp": [], "d2": [], "lo": [], "hi": [], "other": []}
    if len(left) and len(right):
        x, v = vectors(left.x), vectors(right.x)
        a, b, mine, theirs = left.row_id.to_numpy(), right.row_id.to_numpy(), left.comp.to_numpy(), right.comp.to_numpy()
        best: dict = {}
        step = max(1, 4_000_000 // len(v))
        for k in range(0, len(x), step):
            d = np.round(squared(x[k : k + step], v), DECIMALS)
            d[mine[k : k + step, None] == theirs[None, :]] = np.inf
            least = pd.Series(d.min(axis=1)).groupby(mine[k : k + step]).min()
            i, j = np.nonzero((d == least.loc[mine[k : k + step]].to_numpy()[:, None]) & np.isfinite(d))
            p, q = a[k + i], b[j]
            for row in zip(mine[k + i].tolist(), d[i, j].tolist(), np.minimum(p, q).tolist(), np.maximum(p, q).tolist(), theirs[j].tolist(), strict=True):
                if row[0] not in best or row[1:] < best[row[0]]:
                    best[row[0]] = row[1:]
        for comp, row in best.items():
            for name, value in zip(out, (comp, *row), strict=True):
                out[name].append(value)
    return pd.DataFrame(out).astype({"comp": "int64", "d2": "float64", "lo": "int64", "hi": "int64", "other": "int64"})


def spanning_edges(points: DataFrame, comp: DataFrame, ball_rows: int = BALL_ROWS, pivots: int = PIVOTS, rounds: list | None = None) -> DataFrame:
    """(lo, hi, d2): the least edges that join the components (row_id, comp) of points (row_id, x) to one tree, in the order of
    (d2, lo, hi).  ``rounds`` gets the number of components before each round."""
    balls = Balls.of(points.select("row_id", "x").join(comp, "row_id"), "row_id", "x", ball_rows, pivots)
    place = cut_lineage(balls.rows.drop("comp"))
    label = cut_lineage(comp)
    edges = points.sparkSession.createDataFrame([], "lo long, hi long, d2 double")
    while True:
        names = label.select("comp").distinct()
        n = names.count()
        if rounds is not None:
            rounds.append(n)
        if n < 2:
            return edges
        rows = cut_lineage(place.join(label, "row_id"))
        low, high = np.zeros(len(balls.pivots), np.int64), np.zeros(len(balls.pivots), np.int64)
        for r in rows.groupBy("ball").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).collect():  # a row a ball
            low[r.ball], high[r.ball] = r.a, r.b
        bound = _bounds(rows, balls, low, high)
        asked = rows.select("row_id", "comp", "x").join(bound, "comp")
        to = sends(asked, ["row_id", "comp", "x"], "x", balls, lambda lower, upper, most: lower <= most, "bound")
        found = meet(to, rows.select("ball", "chunk", "row_id", "comp", "x"), ["ball", "chunk"], "row_id", _nearest_other, "comp long, d2 double, lo long, hi long, other long", ball_rows)
        best = found.groupBy("comp").agg(F.min(F.struct("d2", "lo", "hi", "other")).alias("m")).select("comp", "m.*")
        best = cut_lineage(best)
        edges = cut_lineage(edges.unionByName(best.select("lo", "hi", "d2").distinct()))
        merged = components(names.withColumnRenamed("comp", "vid"), best.select(F.col("comp").alias("i"), F.col("other").alias("j")))
        label = cut_lineage(label.join(merged.select(F.col("comp").alias("_new"), F.col("vid").alias("comp")), "comp").select("row_id", F.col("_new").alias("comp")))


def turned(edges: DataFrame, root: int) -> DataFrame:
    """(u, v, eid) of tree edges (u, v, eid), each turned away from ``root``.

    Every edge is two arcs.  An arc into v is followed by the arc from v to its next neighbour, which makes a
    tour of all arcs from the root back to it; doubling the reach of each arc's successor counts the arcs that follow it.  The arc that
    comes first leads away from the root.
    """
    arcs = edges.select("u", "v", "eid").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "eid"))
    around = Window.partitionBy("u").orderBy("v")
    arcs = cut_lineage(arcs.select("u", "v", "eid", F.monotonically_increasing_id().alias("arc")))
    turn = arcs.select("u", "v", "arc", F.lead("arc").over(around).alias("next"), F.first("arc").over(around).alias("first"))
    # The arc v -> u is followed by the arc from u behind u -> v; at the root's last neighbour the tour ends.
    after = F.when(F.col("next").isNotNull(), F.col("next")).when(F.col("u") != root, F.col("first"))
    follow = turn.select(F.col("u").alias("v"), F.col("v").alias("u"), after.alias("to"))
    tour = cut_lineage(arcs.join(follow, ["u", "v"]).select("arc", "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("left")))
    while not tour.where("to IS NOT NULL").isEmpty():
        on = tour.select(F.col("arc").alias("to"), F.col("to").alias("_to"), F.col("left").alias("_left"))
        tour = cut_lineage(tour.join(on, "to", "left").select("arc", F.col("_to").alias("to"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")))
    ranked = arcs.join(tour.select("arc", "left"), "arc")
    return ranked.groupBy("eid").agg(F.max(F.struct("left", "u", "v")).alias("m")).select("m.u", "m.v", "eid")


def bridges(points: DataFrame, edges: DataFrame, ball_rows: int = BALL_ROWS, pivots: int = PIVOTS, rounds: list | None = None) -> DataFrame:
    """(a, b, d2): edges that join the components of a graph on points (row_id, x) with edges (i, j).  b lies in the component that
    the edge adds when the least component absorbs the others by closest pairs."""
    comp = cut_lineage(components(points.select(F.col("row_id").alias("vid")), edges).withColumnRenamed("vid", "row_id"))
    found = cut_lineage(spanning_edges(points, comp, ball_rows, pivots, rounds))
    at = lambda end, name: comp.select(F.col("row_id").alias(end), F.col("comp").alias(name))
    tree = cut_lineage(found.withColumn("eid", F.monotonically_increasing_id()).join(at("lo", "u"), "lo").join(at("hi", "v"), "hi"))
    root = comp.agg(F.min("comp")).first()[0]
    away = turned(tree.select("u", "v", "eid"), root).select("eid", F.col("u").alias("from"))
    out = tree.join(away, "eid")
    return out.select(F.when(F.col("from") == F.col("u"), F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(F.col("from") == F.col("u"), F.col("hi")).otherwise(F.col("lo")).alias("b"), "d2")
