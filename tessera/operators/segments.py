"""Skeletons as tables, and what is asked of them.

vertex(label, vid, v) and segment(label, eid, i, j, u, v).  An object is a vertex (kind 0) or a
segment (kind 1); the nearest object of a point is the least (distance, kind, id), so a vertex wins
a tie and the lowest segment follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.registry import Registry
from tessera.functions.scalars import margin
from tessera.functions.vectors import segment_fields, sq_dist
from tessera.operators.neighbors import DECIMALS, every_with, small


def with_ends(edge: DataFrame, vertex: DataFrame) -> DataFrame:
    """segment table from edge(label, eid, i, j)."""
    u = vertex.select("label", F.col("vid").alias("i"), F.col("v").alias("u"))
    v = vertex.select("label", F.col("vid").alias("j"), "v")
    return edge.join(u, ["label", "i"]).join(v, ["label", "j"]).select("label", "eid", "i", "j", "u", "v")


def checked_edges(edge: DataFrame, vertex: DataFrame) -> DataFrame:
    """``edge`` (label, eid, i, j) itself; an edge to itself or to a vertex that its class does not have is an error."""
    at = lambda end: vertex.select("label", F.col("vid").alias(end), F.lit(True).alias(f"_{end}"))
    bad = edge.join(at("i"), ["label", "i"], "left").join(at("j"), ["label", "j"], "left").where(F.col("_i").isNull() | F.col("_j").isNull() | (F.col("i") == F.col("j")))
    if rows := bad.select("label", "eid", "i", "j").limit(5).collect():
        raise ValueError(f"edges without two vertices of their class: {[tuple(r) for r in rows]}")
    return edge


def object_distances(points: DataFrame, vertex: DataFrame, segment: DataFrame) -> DataFrame:
    """(row_id, cls, kind, id, d, t): every point against every object.  The two object tables are
    one broadcast, so the points are scanned once."""
    zero = F.lit(None).cast("array<double>")
    objects = vertex.select(F.col("label").alias("cls"), F.lit(0).alias("kind"), F.col("vid").alias("id"), F.col("v").alias("u"), zero.alias("w"))
    objects = objects.unionByName(segment.select(F.col("label").alias("cls"), F.lit(1).alias("kind"), F.col("eid").alias("id"), "u", F.col("v").alias("w")))
    pairs = every_with(points, objects, "u")
    d, t = segment_fields(F.col("x"), F.col("u"), F.col("w"))
    at = F.when(F.col("kind") == 0, F.struct(F.sqrt(sq_dist(F.col("x"), F.col("u"))).alias("d"), F.lit(0.0).alias("t"))).otherwise(F.struct(d.alias("d"), t.alias("t")))
    return pairs.withColumn("_at", at).select(*points.columns, "cls", "kind", "id", F.round("_at.d", DECIMALS).alias("d"), F.col("_at.t").alias("t")).drop("x")


def nearest_object(objects: DataFrame, by: list[str]) -> DataFrame:
    best = F.min(F.struct("d", "kind", "id", "t")).alias("_b")
    return objects.groupBy(*by).agg(best).select(*by, "_b.kind", "_b.id", "_b.d", "_b.t")


def class_distances(objects: DataFrame, keys: list[str]) -> DataFrame:
    return objects.groupBy(*keys, "cls").agg(F.min("d").alias("d"))


def predict(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest class, the lowest on ties, with the two least distances and their margin."""
    two = F.slice(F.array_sort(F.collect_list(F.struct("d", "cls"))), 1, 2)  # one entry a class
    d = classes.groupBy(*keys).agg(two.alias("_t"))
    d2 = F.coalesce(F.get("_t", 1)["d"], F.get("_t", 0)["d"])
    return d.select(*keys, F.get("_t", 0)["cls"].alias("predicted"), F.get("_t", 0)["d"].alias("d1"), d2.alias("d2")).withColumn("margin", margin(F.col("d1"), F.col("d2")))


def other_extrema(classes: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Nearest wrong class and its distance."""
    return classes.where(F.col("cls") != F.col(label)).groupBy(*keys).agg(F.min(F.struct("d", "cls")).alias("_b")).select(*keys, F.col("_b.d").alias("other_min"), F.col("_b.cls").alias("other_arg"))


def correct_given_others(own: str, other: str, own_cls: str, other_cls: str):
    """Whether the own class wins, ties going to the lower class."""
    return (F.col(own) < F.col(other)) | ((F.col(own) == F.col(other)) & (F.col(own_cls) < F.col(other_cls)))


def top_objects(objects: DataFrame, by: list[str], k: int = 4) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("d", "kind", "id")
    return objects.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def edge_support(points: DataFrame, vertex: DataFrame, segment: DataFrame) -> DataFrame:
    """(label, eid, rho, length, gap, kept): an edge stays if the projections of the class's points
    within rho of it leave no gap longer than rho; rho is the median distance to a vertex."""
    at_v = points.join(small(vertex), "label").groupBy("label", "row_id").agg(F.min(F.sqrt(sq_dist(F.col("x"), F.col("v")))).alias("d"))
    rho = at_v.groupBy("label").agg(F.percentile("d", F.lit(0.5)).alias("rho"))
    d, t = segment_fields(F.col("x"), F.col("u"), F.col("v"))
    on = points.join(small(segment), "label").select("label", "eid", d.alias("d"), t.alias("t")).join(F.broadcast(rho), "label").where("d <= rho").select("label", "eid", "t")
    ends = segment.select("label", "eid", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    w = Window.partitionBy("label", "eid").orderBy("t")
    gaps = on.unionByName(ends).withColumn("g", F.col("t") - F.lag("t").over(w)).groupBy("label", "eid").agg(F.max("g").alias("gap"))
    out = segment.select("label", "eid", F.sqrt(sq_dist(F.col("u"), F.col("v"))).alias("length")).join(gaps, ["label", "eid"]).join(rho, "label")
    kept = (F.col("length") == 0) | ((F.col("rho") > 0) & (F.col("gap") <= F.col("rho") / F.col("length")))
    return out.select("label", "eid", "rho", "length", "gap", kept.alias("kept"))


def variant_risk(points: DataFrame, base: DataFrame, variants: DataFrame) -> DataFrame:
    """Risk of each variant of one class's objects while the other classes stand.

    variants(variant, cls, kind, id, u, w): the objects that a variant's class is left with, all
    variants priced in one pass; base(row_id, label, cls, d): the class distances as they are.
    """
    pairs = every_with(points, variants, "u")
    d, _ = segment_fields(F.col("x"), F.col("u"), F.col("w"))
    dist = F.when(F.col("kind") == 0, F.sqrt(sq_dist(F.col("x"), F.col("u")))).otherwise(d)
    own = pairs.groupBy("variant", "cls", "row_id", "label").agg(F.min(F.round(dist, DECIMALS)).alias("own"))
    rest = base.select("row_id", F.col("cls").alias("other"), F.col("d"))
    best = own.join(rest, "row_id").where("cls <> other").groupBy("variant", "cls", "row_id", "label", "own").agg(F.min(F.struct("d", "other")).alias("_b"))
    wins = correct_given_others("own", "_b.d", "cls", "_b.other")
    wrong = F.when(wins, F.col("cls")).otherwise(F.col("_b.other")) != F.col("label")
    return best.groupBy("variant", "cls").agg(F.avg(wrong.cast("double")).alias("risk"))


#: Error mass of a point from (own distance, least other distance, own class, that other class); a vertex is added where most of it lies.
ERROR_ORACLES = Registry("error oracle")


@ERROR_ORACLES.register("misclassified")
def misclassified(own, other, own_cls, other_cls):
    """One for each point that goes to another class."""
    return (~((own < other) | ((own == other) & (own_cls < other_cls)))).cast("long")


@ERROR_ORACLES.register("distortion")
def distortion(own, other, own_cls, other_cls):
    """The squared distance to the own class."""
    return own * own


def growth_sites(own: DataFrame, other: DataFrame, keys: list[str], oracle: str = "misclassified") -> DataFrame:
    """(label, kind, id, errors, distortion, is_site): the oracle's mass and the squared distances by nearest own object, and where the next
    vertex of each class goes; of equals a segment before a vertex, then the lowest."""
    mass = ERROR_ORACLES[oracle](F.col("d"), F.col("other_min"), F.col("label"), F.col("other_arg"))
    d = own.join(other, keys).groupBy("label", "kind", "id").agg(F.sum(mass).alias("errors"), F.sum(F.col("d") * F.col("d")).alias("distortion"))
    w = Window.partitionBy("label").orderBy(F.desc("errors"), F.desc("kind"), "id")
    return d.withColumn("is_site", F.row_number().over(w) == 1)
