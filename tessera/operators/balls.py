"""Exact searches over points too many to send to every task: balls around sampled pivots.

Rows go to the ball of their nearest pivot; pivots and radii are a bounded table (``PIVOTS`` at most).  By the
triangle inequality a point at distance d from a pivot is no nearer than d - radius to anything in its ball and no
farther than d + radius, so most balls need not be visited.  A ball is cut into chunks of about ``BALL_ROWS`` rows,
and both sides of a meeting are split when many rows want the same chunk: no task holds a whole ball.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.density import squared
from tessera.plans.session import cut_lineage

BALL_ROWS = 4096
PIVOTS = 2048
#: Decimals to which squared distances are compared (as in ``neighbors``).
DECIMALS = 9
#: Distances held at a time where all are summed: a block that stays near the processor.
SUM_CELLS = 100_000
#: Rows of such a block, and rows whose sums are found at once in the search for the least.
ROWS_AT_ONCE, ASKED = 128, 512
#: Rows of a small table that may be sent to every task.
SMALL_ROWS = 200_000


def lengths(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances by matrix product: near enough for bounds that are slackened by ``slack``."""
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0.0))


def slack(x: np.ndarray, c: np.ndarray) -> float:
    """What a bound may be off by: the square root of a rounded difference of squares, and of the decimals compared."""
    most = max(1.0, float(np.abs(x).max(initial=0)), float(np.abs(c).max(initial=0)))
    return 1e-6 * most * math.sqrt(max(1, c.shape[1]))


def vectors(column) -> np.ndarray:
    """An Arrow list column, or a pandas one, of equally long vectors as a matrix."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float)


def assign(df: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    """``df`` with ball, the nearest pivot, and dist, the distance to it."""
    import pyarrow as pa

    sent = df.sparkSession.sparkContext.broadcast(pivots)
    at = df.columns.index(vector)

    def run(batches: Iterator) -> Iterator:
        c = sent.value
        step = max(1, 4_000_000 // max(1, len(c)))
        for b in batches:
            if not b.num_rows:
                continue
            x = vectors(b.column(at))
            ball = np.concatenate([lengths(x[i : i + step], c).argmin(axis=1) for i in range(0, len(x), step)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ball), pa.array(np.sqrt(((x - c[ball]) ** 2).sum(axis=1)))], [*b.schema.names, "ball", "dist"])

    return df.mapInArrow(run, df.select("*").schema.add("ball", "integer").add("dist", "double"))


@dataclass
class Balls:
    """rows: the table with ball, dist and chunk; the arrays have an element a ball."""

    rows: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    chunks: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, key: str, vector: str, ball_rows: int = BALL_ROWS, pivots: int = PIVOTS) -> Balls:
        """Balls of a table; pivots are its first rows by a hash of ``key``."""
        n = df.count()
        some = df.orderBy(F.xxhash64(key), key).limit(min(pivots, max(1, -(-n // ball_rows)))).select(vector).collect()
        c = np.unique(np.array([r[0] for r in some], dtype=float), axis=0)
        rows = cut_lineage(assign(df, vector, c))
        radius, size = np.zeros(len(c)), np.zeros(len(c), np.int64)
        for r in rows.groupBy("ball").agg(F.max("dist").alias("r"), F.count(F.lit(1)).alias("n")).collect():
            radius[r.ball], size[r.ball] = r.r, r.n
        chunks = np.maximum(1, -(-size // ball_rows))
        many = F.array(*[F.lit(int(k)) for k in chunks]) if len(chunks) and chunks.max() > 1 else None
        chunk = F.lit(0) if many is None else F.pmod(F.xxhash64(key), F.get(many, F.col("ball"))).cast("int")
        return cls(rows.withColumn("chunk", chunk), c, radius, size, chunks)


def meet(left: DataFrame, right: DataFrame, keys: list[str], spread: str, run: Callable, schema: str, rows: int = BALL_ROWS) -> DataFrame:
    """``run`` for the rows of either side of each key; where over ``rows`` left rows meet, they are dealt to several
    tasks by ``spread`` and the right rows go to each."""
    left = cut_lineage(left)
    hot = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts")).where("parts > 1")
    hot = cut_lineage(hot)
    hot = F.broadcast(hot) if hot.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else hot
    parts = F.coalesce("parts", F.lit(1))
    a = left.join(hot, keys, "left").withColumn("part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("parts")
    b = right.join(hot, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    a, b = (d.select(*[F.col(c).alias(c) for c in d.columns]) for d in (a, b))  # either side may come from the same table
    return a.groupBy(*keys, "part").cogroup(b.groupBy(*keys, "part")).applyInPandas(run, schema)


def sends(df: DataFrame, columns: list[str], vector: str, balls: Balls, reach: Callable, limit: str | None = None) -> DataFrame:
    """(columns, ball, chunk): a row of ``df`` for every chunk of the balls it must visit.  ``reach(lower, upper, limit)`` gives a
    mask of rows by balls from bounds on the distances and the row's ``limit``."""
    import pyarrow as pa

    sent = df.sparkSession.sparkContext.broadcast((balls.pivots, balls.radius, balls.chunks))
    at = columns.index(vector)
    asked = df.select(*columns, *[limit] * bool(limit))

    def run(batches: Iterator) -> Iterator:
        c, radius, chunks = sent.value
        step = max(1, 4_000_000 // max(1, len(c)))
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                x = vectors(part.column(at))
                d, e = lengths(x, c), slack(x, c)
                most = part.column(len(columns)).to_numpy(zero_copy_only=False)[:, None] if limit else None
                row, ball = np.nonzero(reach(d - radius - e, d + radius + e, most))
                n = chunks[ball]
                which = np.repeat(np.arange(len(row)), n)
                chunk = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(row[which])) for k in range(len(columns))), pa.array(ball[which].astype(np.int32)), pa.array(chunk.astype(np.int32))], [*columns, "ball", "chunk"])

    return asked.mapInArrow(run, asked.select(*columns).schema.add("ball", "integer").add("chunk", "integer"))


# --- k nearest --------------------------------------------------------------------------------


def thin(model: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """The k least ids of each distinct vector: no other can be among k nearest.  Copies are counted off in salts first."""
    salt = F.pmod(F.xxhash64("proto_id"), F.lit(salts))
    one = Window.partitionBy("v", "_salt").orderBy("proto_id")
    two = Window.partitionBy("v").orderBy("proto_id")
    m = model.select("proto_id", "v", salt.alias("_salt")).withColumn("_n", F.row_number().over(one)).where(F.col("_n") <= k)
    return m.withColumn("_n", F.row_number().over(two)).where(F.col("_n") <= k).select("proto_id", "v")


def _near(left: pd.DataFrame, right: pd.DataFrame, k: int, others: bool) -> pd.DataFrame:
    """left's rows with d2s and ids of their k nearest right rows."""
    right = right.sort_values("proto_id")
    if not len(left) or not len(right):
        none = pd.Series([[] for _ in range(len(left))], index=left.index, dtype=object)
        return left.astype({"x": object}).assign(d2s=none, ids=none)
    x, v, ids, own = vectors(left.x), vectors(right.v), right.proto_id.to_numpy(), left.row_id.to_numpy()
    d2s, near = [], []
    step = max(1, 4_000_000 // len(v))
    for i in range(0, len(x), step):
        d = np.round(squared(x[i : i + step], v), DECIMALS)
        if others:
            d[own[i : i + step, None] == ids[None, :]] = np.inf
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        for row, cols in zip(d, at, strict=True):
            cols = cols[np.isfinite(row[cols])]
            d2s.append(row[cols].tolist())
            near.append(ids[cols].tolist())
    return left.assign(d2s=d2s, ids=near)


def k_nearest(points: DataFrame, model: DataFrame, k: int, others: bool = False, ball_rows: int = BALL_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(row_id, rank, proto_id, d2) of the k nearest model rows, of equally near ones the least ids.

    First each point meets one chunk of its own ball, which bounds how far its neighbours can be; then it goes to the
    chunks its bound reaches.  Nothing of the model but pivots and radii is broadcast.
    """
    balls = Balls.of(thin(model, k + others), "proto_id", "v", ball_rows, pivots)
    chunk = balls.rows.select("ball", "chunk", "proto_id", "v")
    kind = dict(points.dtypes)
    q = assign(points.select("row_id", "x"), "x", balls.pivots).select("row_id", "x", "ball", F.lit(0).alias("chunk"))

    def first(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _near(left[["row_id", "x", "ball"]], right, k, others)

    def second(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _near(left[["row_id", "x"]], right, k, others).drop(columns="x")

    a = cut_lineage(meet(q, chunk, ["ball", "chunk"], "row_id", first, f"row_id {kind['row_id']}, x array<double>, ball int, d2s array<double>, ids array<long>", ball_rows))
    bound = F.when(F.size("d2s") >= k, F.sqrt(F.get("d2s", F.lit(k - 1)))).otherwise(F.lit(float("inf")))
    asked = a.select("row_id", "x", F.col("ball").alias("own"), bound.alias("bound"))
    to = sends(asked, ["row_id", "x", "own"], "x", balls, lambda lower, upper, most: lower <= most, "bound").where("ball <> own OR chunk > 0").drop("own")
    b = meet(to, chunk, ["ball", "chunk"], "row_id", second, f"row_id {kind['row_id']}, d2s array<double>, ids array<long>", ball_rows)
    found = a.select("row_id", "d2s", "ids").unionByName(b).select("row_id", F.explode(F.arrays_zip("d2s", "ids")).alias("c"))
    w = Window.partitionBy("row_id").orderBy("d2", "proto_id")
    found = found.select("row_id", F.col("c.ids").alias("proto_id"), F.col("c.d2s").alias("d2"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("row_id", "rank", "proto_id", "d2")


# --- farthest pair ----------------------------------------------------------------------------


def _farthest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The pair of a left and a right row at the greatest distance, least ids first on ties."""
    if not len(left) or not len(right):
        return pd.DataFrame({"d2": np.empty(0), "i": np.empty(0, np.int64), "j": np.empty(0, np.int64)})
    x, v, a, b = vectors(left.x), vectors(right.x), left.row_id.to_numpy(), right.row_id.to_numpy()
    best = (-1.0, 0, 0)
    step = max(1, 4_000_000 // len(v))
    for lo in range(0, len(x), step):
        d = np.round(squared(x[lo : lo + step], v), DECIMALS)
        top = d.max()
        if top >= best[0]:
            i, j = np.nonzero(d == top)
            p, q = a[lo + i], b[j]
            pair = min(zip(np.minimum(p, q).tolist(), np.maximum(p, q).tolist(), strict=True))
            best = max(best, (float(top), -pair[0], -pair[1]))
    return pd.DataFrame({"d2": [best[0]], "i": [-best[1]], "j": [-best[2]]})


def farthest_pair(points: DataFrame, ball_rows: int = BALL_ROWS, pivots: int = PIVOTS, batch: int = 64, seen: list | None = None) -> tuple | None:
    """(i, j, d2) of the pair i < j at the greatest distance, lexicographically first on ties; None for under two rows.

    Two sweeps find a far pair; a pair of balls whose distance and radii do not add up to that is discarded, the others are
    visited with the most promising first, a batch a round, by their points that can still reach.  ``seen`` gets (pairs
    visited, pairs).
    """
    spark = points.sparkSession
    distinct = cut_lineage(points.groupBy("x").agg(F.min("row_id").alias("row_id")))
    if distinct.limit(2).count() < 2:
        two = [r[0] for r in points.select("row_id").orderBy("row_id").limit(2).collect()]
        return (*two, 0.0) if len(two) == 2 else None
    balls = Balls.of(distinct, "row_id", "x", ball_rows, pivots)
    rows, c, radius = balls.rows, balls.pivots, balls.radius
    far, best = c.mean(axis=0), (-1.0, 0, 0)
    last = None
    for _ in range(3):  # sweeps: the farthest from the farthest
        to = F.array(*[F.lit(float(t)) for t in far])
        d = F.round(F.aggregate(F.zip_with("x", to, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t), DECIMALS)
        r = rows.agg(F.max(F.struct(d.alias("d2"), (-F.col("row_id")).alias("i"), "x")).alias("m")).first().m
        if last is not None:
            best = max(best, (r.d2, -min(-r.i, last), -max(-r.i, last)))
        far, last = np.array(r.x, dtype=float), -r.i
    between = lengths(c, c)
    e = slack(c, c) + slack(far[None, :], c)
    upper = between + radius[:, None] + radius[None, :] + e
    a, b = np.triu_indices(len(c))
    order = np.argsort(-upper[a, b], kind="stable")
    a, b, u = a[order], b[order], upper[a, b][order]
    done = 0
    while done < len(a) and u[done] >= math.sqrt(best[0]) - e:
        end = min(done + batch, done + int((u[done:] >= math.sqrt(best[0]) - e).sum()))
        need = math.sqrt(best[0]) - e
        sides = [(int(p), k, s, float(need - between[p, q] - radius[q])) for k in range(done, end) for s, (p, q) in enumerate(((a[k], b[k]), (b[k], a[k])))]
        side = F.broadcast(spark.createDataFrame(sides, "ball int, pair int, side int, need double"))
        near = cut_lineage(rows.join(side, "ball").where("dist >= need").select("pair", "side", "row_id", "x", "chunk"))
        right = near.where("side = 1").drop("side")
        which = right.select("pair", "chunk").distinct()
        left = near.where("side = 0").drop("side", "chunk").join(which, "pair")
        found = meet(left, right, ["pair", "chunk"], "row_id", _farthest, "d2 double, i long, j long", ball_rows)
        r = found.where("i <> j").agg(F.max(F.struct("d2", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("m")).first().m
        if r is not None:
            best = max(best, (r.d2, r.i, r.j))
        done, batch = end, batch * 4
    if seen is not None:
        seen.append((done, len(a)))
    return -best[1], -best[2], best[0]


class Measured:
    """Distances of blocks of rows to all rows of a matrix by products; pairs so near that a product would blur them are measured by
    differences, and all are where a row is not finite."""

    def __init__(self, v: np.ndarray):
        self.v = v
        self.centre = v.mean(axis=0) if len(v) else np.zeros(v.shape[1])
        away = v - self.centre
        square = (away * away).sum(axis=1)
        self.most = float(square.max(initial=0.0))
        self.right = np.concatenate([-2 * away.T, np.ones((1, len(v))), square[None, :]])

    def to(self, x: np.ndarray, part: slice = slice(None)) -> np.ndarray:
        away = x - self.centre
        square = (away * away).sum(axis=1)
        most = max(self.most, float(square.max(initial=0.0)))
        v = self.v[part]
        if not np.isfinite(most):
            return np.sqrt(squared(x, v))
        d = np.column_stack([away, square, np.ones(len(x))]) @ self.right[:, part]
        near = np.flatnonzero(d.ravel() <= 1e-9 * most)
        if len(near):
            i, j = np.divmod(near, len(v))
            d.ravel()[near] = ((x[i] - v[j]) ** 2).sum(axis=1)
        return np.sqrt(d, out=d)


# --- sums over all points ---------------------------------------------------------------------


def model_chunks(model: DataFrame, key: str, vector: str, cells: int) -> list:
    """Broadcast matrices of at most about ``cells`` numbers that make up the model; a caller passes its points by each in turn."""
    n, width = model.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    parts = max(1, -(-n * max(1, width) // cells))
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    out = []
    for i in range(parts):
        t = model.where(part == i).select(vector).toArrow().column(0).combine_chunks()
        out.append(model.sparkSession.sparkContext.broadcast(np.array(t.flatten(), dtype=float).reshape(len(t), width)))
    return out


def distance_sums(points: DataFrame, model: DataFrame, key: str = "proto_id", cells: int = 20_000_000) -> DataFrame:
    """(row_id, s): the sum of each point's distances to all model rows.  Every distance counts, so nothing can be discarded: the
    work is points times model rows, a bounded chunk of the model at a time."""
    import pyarrow as pa

    total = None
    for sent in model_chunks(model, key, "v", cells):

        def run(batches: Iterator, sent=sent) -> Iterator:
            v = sent.value
            if not len(v):
                return
            step, cols = ROWS_AT_ONCE, SUM_CELLS // ROWS_AT_ONCE
            model = Measured(v)
            for b in batches:
                if not b.num_rows:
                    continue
                x = vectors(b.column(1))
                s = np.zeros(len(x))
                for i in range(0, len(x), step):
                    for k in range(0, len(v), cols):
                        s[i : i + step] += model.to(x[i : i + step], slice(k, k + cols)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["row_id", "s"])

        p = points.select("row_id", "x")
        one = p.mapInArrow(run, p.select("row_id").schema.add("s", "double"))
        total = one if total is None else total.unionByName(one)
    return total.groupBy("row_id").agg(F.sum("s").alias("s"))


def gains(candidates: DataFrame, points: DataFrame, ball_rows: int = BALL_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(proto_id, g): by how much a candidate lowers the sum of ``cur_min`` over points (row_id, x, cur_min).  A candidate goes only to
    the balls that hold a point it may be nearer to than its cur_min; one that goes nowhere has no row."""
    balls = Balls.of(points.select("row_id", "x", "cur_min"), "row_id", "x", ball_rows, pivots)
    most = np.full(len(balls.pivots), -np.inf)
    for r in balls.rows.groupBy("ball").agg(F.max("cur_min").alias("m")).collect():
        most[r.ball] = r.m
    to = sends(candidates.select("proto_id", "v"), ["proto_id", "v"], "v", balls, lambda lower, upper, _: lower < most)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"proto_id": np.empty(0, np.int64), "g": np.empty(0)})
        x, v, cur = vectors(right.x), vectors(left.v), right.cur_min.to_numpy()
        step = max(1, 4_000_000 // len(x))
        g = np.concatenate([np.maximum(cur - np.sqrt(squared(v[i : i + step], x)), 0.0).sum(axis=1) for i in range(0, len(v), step)])
        return pd.DataFrame({"proto_id": left.proto_id, "g": g})

    met = meet(to, balls.rows.select("ball", "chunk", "x", "cur_min"), ["ball", "chunk"], "proto_id", run, "proto_id long, g double", ball_rows)
    return met.groupBy("proto_id").agg(F.sum("g").alias("g"))


def sums_at(points: DataFrame, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of distances of all points to each of a few rows, and its gradient there (a point that coincides adds nothing)."""
    import pyarrow as pa

    sent = points.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator) -> Iterator:
        q = sent.value
        s, g = np.zeros(len(q)), np.zeros(q.shape)
        for b in batches:
            x = vectors(b.column(0)) if b.num_rows else np.empty((0, q.shape[1]))
            for i in range(0, len(x), 256):
                some = x[i : i + 256]
                d = Measured(q).to(some)
                s += d.sum(axis=0)
                with np.errstate(divide="ignore"):
                    w = np.where(d > 0, 1 / d, 0.0)
                g += w.sum(axis=0)[:, None] * q - w.T @ some
        yield pa.RecordBatch.from_arrays([pa.array([s.tolist()]), pa.array([g.ravel().tolist()])], ["s", "g"])

    rows = points.select("x").mapInArrow(run, "s array<double>, g array<double>").collect()  # a row a task
    return np.sum([r.s for r in rows], axis=0), np.sum([r.g for r in rows], axis=0).reshape(q.shape)


def least_sum(points: DataFrame, rounds: int = 40, asked: int = ASKED, seen: list | None = None) -> tuple | None:
    """(row_id, mean distance to all points) of the row of the least mean (to 9 decimals), the least id on ties; None without rows.

    The mean is convex, so its value and gradient at some rows bound it from below at all others: a round finds the rows
    of the least bounds exactly, until no bound is within the least mean.  Rows that are left after ``rounds`` are summed in full.
    ``seen`` gets how many rows were summed.
    """
    import pyarrow as pa

    spark = points.sparkSession
    p = cut_lineage(points.select("row_id", "x"))
    schema = f"row_id {dict(p.dtypes)['row_id']}, x array<double>, low double"
    cores = spark.sparkContext.defaultParallelism
    if p.rdd.getNumPartitions() < cores:
        p = cut_lineage(p.repartition(cores))
    n, largest = p.agg(F.count(F.lit(1)), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v))))).first()
    if not n:
        return None
    done: dict = {}
    best, left = (math.inf, None), p
    margin = 2 * 10.0**-DECIMALS + 1e-12 * (largest or 0.0)
    asked_rows = p.orderBy(F.xxhash64("row_id"), "row_id").limit(asked).collect()
    planes = np.empty((0, len(asked_rows[0].x) + 1))
    for _ in range(rounds if largest is not None and math.isfinite(largest) else 0):
        q = np.array([r.x for r in asked_rows], dtype=float)
        s, g = sums_at(p, q)
        s, g = s / n, g / n
        best = min(best, *((round(float(m), DECIMALS), r.row_id) for m, r in zip(s, asked_rows, strict=True)))
        done.update((r.row_id, None) for r in asked_rows)
        planes = np.concatenate([planes, np.column_stack([g, s - (g * q).sum(axis=1)])])
        sent = spark.sparkContext.broadcast((planes, best[0] + margin, np.array(sorted(done))))

        def bounded(batches: Iterator, sent=sent) -> Iterator:
            planes, most, done = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                x, ids = vectors(b.column(1)), b.column(0).to_numpy()
                low = np.concatenate([(x[i : i + 128] @ planes[:, :-1].T + planes[:, -1]).max(axis=1) for i in range(0, len(x), 128)])
                at = np.flatnonzero((low <= most) & ~np.isin(ids, done))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(low[at])], ["row_id", "x", "low"])

        # A row's bound never falls, so what is left is looked at alone from here on.
        left = cut_lineage(left.select("row_id", "x").mapInArrow(bounded, schema))
        asked_rows = left.orderBy("low", "row_id").limit(asked).collect()
        if not asked_rows:
            if seen is not None:
                seen.append(len(done))
            return best[1], best[0]
    m = p.select(F.col("row_id").alias("proto_id"), F.col("x").alias("v"))
    r = distance_sums(left, m).select(F.round(F.col("s") / n, DECIMALS).alias("c"), "row_id").agg(F.min(F.struct("c", "row_id")).alias("m")).first().m
    if seen is not None:
        seen.append(n)
    best = min(best, (r.c, r.row_id)) if done else (r.c, r.row_id)
    return best[1], best[0]


def gains_of_all(candidates: DataFrame, points: DataFrame, group: int = 1024) -> DataFrame:
    """``gains`` where all points (row_id, x, cur_min) may go to every task: they lie there in groups by nearness, blocks of candidates too, and a
    block is measured against the groups that hold a point it may be nearer to.  Nothing is shuffled but the candidates."""
    import pyarrow as pa

    spark = points.sparkSession
    t = points.select("x", "cur_min").toArrow()
    x, cur = vectors(t.column(0).combine_chunks()), t.column(1).to_numpy()
    order, ends = halved(x, group)
    x, cur = x[order], cur[order]
    sent = spark.sparkContext.broadcast((x, cur, ends))
    cores = spark.sparkContext.defaultParallelism
    c = candidates.select("proto_id", "v")
    c = c.repartition(4 * cores, "proto_id")

    def run(batches: Iterator) -> Iterator:
        x, cur, ends = sent.value
        model = Measured(x)
        spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        centre = np.stack([x[a:b].mean(axis=0) for a, b in spans])
        radius = np.array([np.sqrt(((x[a:b] - m) ** 2).sum(axis=1)).max() for (a, b), m in zip(spans, centre, strict=True)])
        most = np.array([cur[a:b].max() for a, b in spans])
        for b in batches:
            if not b.num_rows:
                continue
            v = vectors(b.column(1))
            g = np.zeros(len(v))
            rows, at = halved(v, ROWS_AT_ONCE)
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                some = v[rows[lo:hi]]
                e = slack(some, centre)
                visit = ~(lengths(some, centre) - radius - e >= most).all(axis=0)
                total = np.zeros(len(some))
                for k in np.flatnonzero(visit).tolist():
                    part = slice(*spans[k])
                    d = model.to(some, part)
                    np.subtract(cur[part], d, out=d)
                    total += np.maximum(d, 0.0, out=d).sum(axis=1)
                g[rows[lo:hi]] = total
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(g)], ["proto_id", "g"])

    return c.mapInArrow(run, c.select("proto_id").schema.add("g", "double"))


def halved(x: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which groups of at most ``rows`` lie together, found by halving at the widest component, and the groups' ends."""
    parts, out = [np.arange(len(x))], []
    while parts:
        own = parts.pop()
        if len(own) <= rows:
            out.append(own)
            continue
        at = np.argpartition(x[own, int(np.ptp(x[own], axis=0).argmax())], len(own) // 2)
        parts += [own[at[len(own) // 2 :]], own[at[: len(own) // 2]]]
    return np.concatenate(out), np.cumsum([0, *map(len, out)])
