"""Encoding, scaling, splitting and budgets.

Fitted statistics are one row a class or dataset and join back to the rows, so a scan of the data is
aggregated once and never collected.  Ordered assignments (folds, samples) rank within a class; a
class with very many rows is ranked in one task's sort, which spills.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.session import cut_lineage

#: Rows of fitted statistics, one a class, that may be sent to every task.
FITTED_ROWS = 200_000
#: A quantile is first placed to one part in so many rows.
ACCURACY = 10_000


def encode_labels(df: DataFrame, raw: str, code: str = "label") -> DataFrame:
    """Codes in the order of the sorted distinct labels; the distinct table is ranked, not the rows."""
    dim = df.select(raw).distinct()
    dim = dim.withColumn(code, (F.row_number().over(Window.orderBy(raw)) - 1).cast("int"))
    return df.join(dim, raw)


def union_labels(parts: Sequence[DataFrame], raw: str, code: str = "label") -> DataFrame:
    """One coding over several partitions: the codes of the union's labels."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return encode_labels(out, raw, code)


def _fitted(df: DataFrame, train: DataFrame, stats: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    fitted = (train.groupBy(*keys) if keys else train.groupBy()).agg(*[c.alias(n) for n, c in stats.items()])
    if not keys:
        return df.join(fitted)
    # Classes are few and large: a shuffle by class would bring a class to one task.
    fitted = cut_lineage(fitted.withColumnsRenamed({k: f"_k_{k}" for k in keys}))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(F.broadcast(fitted) if fitted.count() <= FITTED_ROWS else fitted, same).drop(*[f"_k_{k}" for k in keys])


def quantiles(df: DataFrame, cols: Sequence[str], at: Sequence[float], accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of columns.

    Approximate quantiles on either side bracket each one; the rows below a bracket are counted and only the distinct
    values inside it, about four in ``accuracy`` rows, are ordered.  A bracket that misses is made wider.
    """
    n = dict(zip(cols, df.agg(*[F.count(c) for c in cols]).first(), strict=True))
    out: dict[str, list[float | None]] = {c: [None] * len(at) for c in cols}
    todo, off = [(c, i) for c in cols if n[c] for i in range(len(at))], 2.0 / accuracy
    while todo:
        ends = F.array(*[F.lit(float(min(1.0, max(0.0, at[i] + s * off)))) for i in range(len(at)) for s in (-1, 1)])
        near = df.agg(*[F.percentile_approx(c, ends, accuracy) for c in cols]).first()
        near = dict(zip(cols, near, strict=True))
        low = lambda c, i: F.lit(near[c][2 * i] if at[i] > off else float("-inf"))
        high = lambda c, i: F.lit(near[c][2 * i + 1] if at[i] + off < 1 else float("nan"))
        below = df.agg(*[F.count_if(F.col(c) < low(c, i)) for c, i in todo]).first()
        value = lambda k, c, i: F.when((F.col(c) >= low(c, i)) & (F.col(c) <= high(c, i)), F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")))
        inside = df.select(F.explode(F.array_compact(F.array(*[value(k, c, i) for k, (c, i) in enumerate(todo)]))).alias("e"))
        inside = inside.groupBy("e.k", "e.v").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
        places = [at[i] * (n[c] - 1) for c, i in todo]
        want = F.array(*[F.array(*[F.lit(int(f(x))) for f in (math.floor, math.ceil)]) for x in places])
        start = F.get(F.array(*map(F.lit, below)), F.col("k")) + F.coalesce(before, F.lit(0))
        held = inside.withColumn("s", start).where(F.exists(F.get(want, F.col("k")), lambda p: (p >= F.col("s")) & (p < F.col("s") + F.col("n"))))
        found: dict[int, list] = {}
        for r in held.orderBy("k", "s").collect():  # two rows a quantile at most
            found.setdefault(r.k, []).append((r.s, r.s + r.n, r.v))
        missed = []
        for k, (c, i) in enumerate(todo):
            ends = [[v for s, e, v in found.get(k, []) if s <= p < e] for p in (math.floor(places[k]), math.ceil(places[k]))]
            if all(ends):
                (a,), (b,), x = *ends, places[k]
                out[c][i] = a if a == b else (math.ceil(x) - x) * a + (x - math.floor(x)) * b
            else:
                missed.append((c, i))
        todo, off = missed, off * 8
    return out


def scale_standard(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / population deviation, fitted on ``train``; a constant column is only centred."""
    d = _fitted(df, df if train is None else train, {f"_m_{c}": F.avg(c) for c in cols} | {f"_s_{c}": F.stddev_pop(c) for c in cols}, keys)
    d = d.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}")) for c in cols})
    return d.drop(*[f"_{p}_{c}" for p in "ms" for c in cols])


def scale_minmax(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    d = _fitted(df, df if train is None else train, {f"_a_{c}": F.min(c) for c in cols} | {f"_b_{c}": F.max(c) for c in cols}, ())
    span = lambda c: F.col(f"_b_{c}") - F.col(f"_a_{c}")
    d = d.withColumns({c: (F.col(c) - F.col(f"_a_{c}")) / F.when(span(c) == 0, F.lit(1.0)).otherwise(span(c)) for c in cols})
    return d.drop(*[f"_{p}_{c}" for p in "ab" for c in cols])


def scale_robust(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """(x - median) / interquartile range, quantiles exact and interpolated."""
    q = quantiles(df if train is None else train, cols, (0.25, 0.5, 0.75))
    off = {c: F.lit(q[c][1]).cast("double") for c in cols}
    span = {c: F.lit(None).cast("double") if q[c][1] is None else F.lit((q[c][2] - q[c][0]) or 1.0) for c in cols}
    return df.withColumns({c: (F.col(c) - off[c]) / span[c] for c in cols})


def class_zscore(df: DataFrame, cols: Sequence[str], label: str = "label") -> DataFrame:
    """z-scores within each class; a constant column becomes 0."""
    return scale_standard(df, cols, keys=[label])


SCALERS = {"standard": scale_standard, "minmax": scale_minmax, "robust": scale_robust, "none": lambda df, cols, train=None: df}


def draw_order(row_id: Column, seed: int) -> Column:
    """A fixed pseudo-random order: md5 of id and seed."""
    return F.md5(F.concat_ws(":", row_id.cast("string"), F.lit(str(seed))))


def stratified_folds(df: DataFrame, row_id: str, label: str, k: int, seed: int) -> DataFrame:
    w = Window.partitionBy(label).orderBy(draw_order(F.col(row_id), seed), row_id)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def stratified_sample(df: DataFrame, row_id: str, label: str, counts: DataFrame, seed: int) -> DataFrame:
    """``counts`` (label, k): the first k rows of each class in the drawn order."""
    w = Window.partitionBy(label).orderBy(draw_order(F.col(row_id), seed), row_id)
    return df.withColumn("_rn", F.row_number().over(w)).join(counts, label).where("_rn <= k").drop("_rn", "k")


def validation_split(df: DataFrame, row_id: str, label: str, fraction: float, seed: int) -> DataFrame:
    """Adds is_val: a stratified share, at least one row of each class on either side."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.groupBy().agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_c"))
    n_val = F.greatest(F.col("_c"), F.least(F.bround(fraction * F.col("_n")).cast("long"), F.col("_n") - F.col("_c")))
    quota = apportion(sizes.join(total).withColumn("_total", n_val).select(label, "n", "_total"), label, "_total")
    w = Window.partitionBy(label).orderBy(draw_order(F.col(row_id), seed), row_id)
    return df.withColumn("_rn", F.row_number().over(w)).join(quota.select(label, "k"), label).withColumn("is_val", F.col("_rn") <= F.col("k")).drop("_rn", "k")


def apportion(sizes: DataFrame, label: str, total: str) -> DataFrame:
    """Largest remainders: (label, n, k) from one row a class with its size ``n`` and the ``total``.

    Floors of the quotas, raised to one and capped at the class size, are corrected one unit at a
    time: a shortfall goes to the largest remainders not capped, an excess comes from the smallest
    remainders above one; a class corrected once waits until all others had their turn.  The table
    has one row a class; the correction runs on it in a single small group.
    """
    import pandas as pd

    kinds = dict(sizes.dtypes)

    def fix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(label).reset_index(drop=True)
        return pdf[[label, "n"]].assign(k=shares(pdf["n"].tolist(), int(pdf[total].iat[0])))

    return sizes.groupBy().applyInPandas(fix, f"{label} {kinds[label]}, n long, k long")


def shares(sizes: list[int], total: int) -> list[int]:
    n = sum(sizes)
    total = min(total, n)
    if total < len(sizes):
        raise ValueError(f"a total of {total} cannot give each of {len(sizes)} classes a row")
    quota = [total * s / n for s in sizes]
    k = [min(max(int(q), 1), s) for q, s in zip(quota, sizes, strict=True)]
    left = [q - int(q) for q in quota]
    while (gap := total - sum(k)) != 0:
        if gap > 0:
            i = max((i for i in range(len(k)) if k[i] < sizes[i]), key=lambda i: (left[i], -i))
            k[i], left[i] = k[i] + 1, -1.0
        else:
            i = min((i for i in range(len(k)) if k[i] > 1), key=lambda i: (left[i], i))
            k[i], left[i] = k[i] - 1, 2.0
    return k


def imbalance(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy().agg(F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("n_rows"), (F.max("n") / F.min("n")).alias("imbalance"))


def checked(df: DataFrame, n: int | None = None, dims: int | None = None, classes: int | None = None) -> DataFrame:
    """One row of load checks of (label, features): counts, lengths, non-finite values, distinct labels."""
    bad = F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = df.groupBy().agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size("features")).alias("min_dims"),
        F.max(F.size("features")).alias("max_dims"),
        F.count_distinct("label").alias("n_classes"),
        F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("n_bad"),
    )
    same = lambda c, want: F.lit(True) if want is None else F.col(c) == want
    return out.withColumn("ok", same("n_rows", n) & same("min_dims", dims) & same("max_dims", dims) & same("n_classes", classes) & (F.col("n_bad") == 0))
