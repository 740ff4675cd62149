"""K-means of every class at once, all restarts in one pass over the rows.

A centre table (class, restart, centre) goes to the tasks, its numbers bounded by ``CELLS``; a pass streams the rows by it, and each
task leaves one sum of rows a centre; one grouping adds them up, or the driver while tasks times centres are few (``GATHER``).  Seeds come by oversampling rounds: a row is taken with a
probability in proportion to its squared distance from the seeds so far, decided by a hash of its id, so reruns agree; the few
candidates, weighted by the rows nearest to each, are thinned to k on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.density import squared
from tessera.operators.reducers import GENERATED
from tessera.plans.session import cut_lineage

Centres = dict[tuple[int, int], np.ndarray]  # by class and restart
CELLS = 20_000_000
#: Numbers that all tasks of a pass may leave for the driver to add up; more are added up by a shuffle.  Passes are some hundreds.
GATHER = 100_000
#: Oversampling rounds, and candidates a round as a multiple of the centres wanted.
SEED_ROUNDS, OVERSAMPLE = 5, 2.0


def bounded(centres: Centres) -> Centres:
    n = sum(c.size for c in centres.values())
    if n > CELLS:
        raise ValueError(f"{n} numbers of centres over all classes and restarts; the bound is {CELLS}: fewer restarts or centres")
    return centres


def by_class(batch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(class, its row ids, its rows) of an Arrow batch (row_id, label, x)."""
    ids, labels = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
    x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    for c in np.unique(labels):
        yield int(c), ids[labels == c], x[labels == c]


def one_pass(rows: DataFrame, centres: Centres) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, float]]:
    """Of each class and restart: rows and sums of rows a centre, and the inertia, against the given centres."""
    import pyarrow as pa

    sent = rows.sparkSession.sparkContext.broadcast(bounded(centres))
    width = next(iter(centres.values())).shape[1]

    def run(batches: Iterator) -> Iterator:
        sums: dict = {}
        for b in batches:
            for c, _, x in by_class(b, width):
                for (label, start), v in sent.value.items():
                    if label != c:
                        continue
                    n, s, cost = sums.setdefault((c, start), (np.zeros(len(v), np.int64), np.zeros_like(v), np.zeros(len(v))))
                    step = max(1, 4_000_000 // len(v))
                    for i in range(0, len(x), step):
                        d = squared(x[i : i + step], v)
                        at = d.argmin(axis=1)
                        np.add.at(n, at, 1)
                        np.add.at(s, at, x[i : i + step])
                        np.add.at(cost, at, d[np.arange(len(at)), at])
        out = [(c, start, k, int(n[k]), float(cost[k]), s[k].tolist()) for (c, start), (n, s, cost) in sums.items() for k in np.flatnonzero(n).tolist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(col) for col in zip(*out, strict=True)], ["label", "start", "k", "n", "cost", "s"])

    parts = rows.mapInArrow(run, "label long, start long, k long, n long, cost double, s array<double>")
    got = {key: [np.zeros(len(v), np.int64), np.zeros_like(v), 0.0] for key, v in centres.items()}
    if rows.rdd.getNumPartitions() * sum(v.size for v in centres.values()) > GATHER:
        parts = added(parts, width)
    t = parts.toArrow()
    if len(t):
        sums = t.column("s").combine_chunks().flatten().to_numpy().reshape(-1, width)
        for label, start, k, n, cost, s in zip(*(t.column(c).to_pylist() for c in ("label", "start", "k", "n", "cost")), sums, strict=True):
            g = got[label, start]
            g[0][k] += n
            g[1][k] += s
            g[2] += cost
    return {k: tuple(v) for k, v in got.items()}


def added(parts: DataFrame, width: int) -> DataFrame:
    """The tasks' sums of each centre added up in the order of the tasks, so that the driver gets one row a centre."""
    import pyarrow as pa

    names = ["label", "start", "k", "n", "cost"]

    def run(batches: Iterator) -> Iterator:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        c = {k: t.column(k).to_numpy() for k in [*names, "part"]}
        s = t.column("s").combine_chunks().flatten().to_numpy().reshape(-1, width)
        order = np.lexsort((c["part"], c["k"], c["start"], c["label"]))
        key = np.stack([c[k][order] for k in names[:3]])
        first = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0).any(axis=0)]))
        cols = [*(pa.array(v) for v in key[:, first]), *(pa.array(np.add.reduceat(c[k][order], first)) for k in names[3:])]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(np.add.reduceat(s[order], first).tolist(), pa.list_(pa.float64()))], [*names, "s"])

    return parts.withColumn("part", F.spark_partition_id()).repartition("label", "start", "k").mapInArrow(run, "label long, start long, k long, n long, cost double, s array<double>")


def lloyd_round(rows: DataFrame, centres: Centres) -> tuple[Centres, dict[tuple[int, int], float]]:
    """The centres after one round, those without rows unmoved, and the inertia before it."""
    got = one_pass(rows, centres)
    return {k: np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres[k]) for k, (n, s, _) in got.items()}, {k: cost for k, (_, _, cost) in got.items()}


def candidates(rows: DataFrame, seeds: Centres, inertia: dict, want: dict[int, int], seed: int, turn: int) -> Centres:
    """Rows drawn in one oversampling round, by class and restart."""
    import pyarrow as pa

    sent = rows.sparkSession.sparkContext.broadcast((bounded(seeds), {k: OVERSAMPLE * want[k[0]] / inertia[k] if inertia[k] > 0 else 0.0 for k in seeds}))
    width = next(iter(seeds.values())).shape[1]
    starts = sorted({s for _, s in seeds})
    draws = F.array(*[F.pmod(F.xxhash64("row_id", F.lit(seed), F.lit(s), F.lit(turn)), F.lit(1 << 53)) / F.lit(float(1 << 53)) for s in starts])

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            u = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(starts))
            labels = b.column(1).to_numpy()
            for c, ids, x in by_class(b, width):
                own = u[labels == c]
                for (label, start), v in sent.value[0].items():
                    if label == c:
                        hit = own[:, starts.index(start)] < sent.value[1][label, start] * squared(x, v).min(axis=1)
                        if hit.any():
                            n = int(hit.sum())
                            yield pa.RecordBatch.from_arrays([pa.array([c] * n), pa.array([start] * n), pa.array(ids[hit]), pa.array(x[hit].tolist(), pa.list_(pa.float64()))], ["label", "start", "row_id", "x"])

    drawn = rows.select("row_id", "label", "x", draws.alias("u")).mapInArrow(run, "label long, start long, row_id long, x array<double>")
    out: dict = {k: [] for k in seeds}
    for r in sorted(drawn.collect(), key=lambda r: (r.label, r.start, r.row_id)):  # about OVERSAMPLE * k a class and restart
        out[r.label, r.start].append(r.x)
    return {k: np.array(v).reshape(-1, width) for k, v in out.items()}


def plus_plus(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the weighted rows, each with a probability in proportion to weight times squared distance from those before."""
    pick = [int(rng.choice(len(x), p=weight / weight.sum()))]
    near = squared(x, x[pick])[:, 0]
    while len(pick) < k:
        p = weight * near
        p[pick] = 0.0
        if p.sum() <= 0:  # as many distinct rows as centres were not drawn: take any others
            p = np.ones(len(x))
            p[pick] = 0.0
        pick.append(int(rng.choice(len(x), p=p / p.sum())))
        near = np.minimum(near, squared(x, x[pick[-1:]])[:, 0])
    return x[pick]


def first_centres(rows: DataFrame, want: dict[int, int], starts: int, seed: int) -> Centres:
    """Seeds of every class and restart: about a hash's first rows, oversampling rounds, and a weighted choice among the candidates."""
    least = max(want.values())
    order = F.row_number().over(_by_hash(seed))
    few = rows.withColumn("_n", order).where(F.col("_n") <= max(starts, least)).select("label", "_n", "x").collect()
    first = {c: [r.x for r in sorted((r for r in few if r.label == c), key=lambda r: r["_n"])] for c in want}
    seeds = {(c, s): np.array([first[c][s % len(first[c])]]) for c in want for s in range(starts)}
    for turn in range(SEED_ROUNDS):
        cost = {k: v for k, (_, _, v) in one_pass(rows, seeds).items()}
        new = candidates(rows, seeds, cost, want, seed, turn)
        seeds = {k: np.concatenate([v, new[k]]) for k, v in seeds.items()}
    held = one_pass(rows, seeds)
    out = {}
    for (c, s), v in sorted(seeds.items()):
        weight = held[c, s][0].astype(float)
        if len(v) < want[c]:  # hardly any spread: the hash's first rows fill up
            v = np.concatenate([v, np.array(first[c])])
            weight = np.concatenate([weight, np.full(len(first[c]), 1e-9)])
        out[c, s] = plus_plus(v, weight, want[c], np.random.default_rng([seed, c & 0xFFFFFFFF, s]))
    return out


def _by_hash(seed: int):
    from pyspark.sql import Window

    return Window.partitionBy("label").orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id")


def kmeans(points: DataFrame, want: dict[int, int], starts: int = 10, rounds: int = 300, seed: int = 0, tolerance: float = 1e-9) -> tuple[Centres, dict[tuple[int, int], float]]:
    """The best restart's centres of each class of points (row_id, label, x), by class and restart, and its inertia.  ``want`` has the centres a class, at most
    its rows."""
    rows = cut_lineage(points.select("row_id", F.col("label").cast("long").alias("label"), "x").where(F.col("label").isin(list(want))))
    centres = first_centres(rows, want, starts, seed)
    done: Centres = {}
    for _ in range(rounds):
        new, _ = lloyd_round(rows, centres)
        still = {k: v for k, v in new.items() if not np.allclose(v, centres[k], rtol=0, atol=tolerance)}
        done |= {k: v for k, v in new.items() if k not in still}
        centres = still
        if not centres:
            break
    done |= centres
    cost = {k: v for k, (_, _, v) in one_pass(rows, done).items()}
    best = {c: min((round(cost[c, s], 9), s) for k, s in done if k == c)[1] for c in want}
    return {(c, s): done[c, s] for c, s in best.items()}, {(c, s): cost[c, s] for c, s in best.items()}


def prototypes(points: DataFrame, want: dict[int, int], **options) -> DataFrame:
    """(proto_id, label, features, source_row): the centres of all classes."""
    centres, _ = kmeans(points, want, **options)
    rows = [(c, v.tolist()) for (c, _), m in sorted(centres.items()) for v in m]
    return points.sparkSession.createDataFrame([(i, c, v, GENERATED) for i, (c, v) in enumerate(rows)], "proto_id long, label int, features array<double>, source_row long")
