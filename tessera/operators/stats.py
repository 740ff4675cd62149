"""Rank statistics over a score table (block, treatment, score), all in SQL expressions.

Tails are closed forms: chi-square on the driver for one row; Student's t as a folded sum; the exact
signed-rank distribution by subset sums.  Tables here have a row per block and treatment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.cover import average_rank


def ranks(scores: DataFrame) -> DataFrame:
    """Adds r: rank within the block, 1 for the highest score, ties averaged."""
    return scores.withColumn("r", average_rank("score", ["block"], descending=True))


def average_ranks(scores: DataFrame) -> DataFrame:
    return ranks(scores).groupBy("treatment").agg(F.avg("r").alias("avg_rank"))


def complete(scores: DataFrame, roster: list[str] | None = None) -> DataFrame:
    """The scores, or an error naming nothing but the counts, if a block misses a treatment, fewer
    than two blocks stand, or a declared treatment is absent."""
    n_b, n_t, n = scores.agg(F.count_distinct("block"), F.count_distinct("treatment"), F.count("score")).first()
    if n_b < 2 or n != n_b * n_t or roster is not None and n_t != len(roster):
        raise ValueError(f"{n} scores for {n_b} blocks and {n_t} treatments: the table is not complete")
    return scores


def missing_cells(scores: DataFrame) -> DataFrame:
    every = scores.select("block").distinct().crossJoin(F.broadcast(scores.select("treatment").distinct()))
    return every.join(scores, ["block", "treatment"], "left_anti")


def roster_difference(scores: DataFrame, declared: list[str]) -> DataFrame:
    """Declared but absent, and present but undeclared."""
    d = scores.sparkSession.createDataFrame([(x,) for x in declared], "treatment string")
    p = scores.select("treatment").distinct()
    return d.join(p, "treatment", "left_anti").withColumn("problem", F.lit("absent")).unionByName(p.join(d, "treatment", "left_anti").withColumn("problem", F.lit("undeclared")))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def chi2_tail(x: float, df: int) -> float:
    if df % 2 == 0:
        term = total = 1.0
        for i in range(1, df // 2):
            term *= x / 2 / i
            total += term
        return math.exp(-x / 2) * total
    out, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for i in range(1, (df - 1) // 2 + 1):
        out += term
        term *= x / (2 * i + 1)
    return out


def friedman(scores: DataFrame) -> DataFrame:
    """One row: n, k, chi2 (corrected for ties), df, p."""
    r = ranks(scores)
    ties = r.groupBy("block", "r").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"))
    rank_sums = r.groupBy("treatment").agg(F.sum("r").alias("R"))
    top = rank_sums.agg(F.sum(F.col("R") * F.col("R")).alias("S"), F.count(F.lit(1)).alias("k"))
    n = r.agg(F.count_distinct("block").alias("n"))
    d = top.crossJoin(n).crossJoin(ties)
    k, m = F.col("k"), F.col("n")
    chi2 = (12 / (m * k * (k + 1)) * F.col("S") - 3 * m * (k + 1)) / (1 - F.col("ties") / (m * k * (k * k - 1)))
    row = d.select("n", "k", chi2.alias("chi2"), (k - 1).alias("df")).first()
    p = None if row.chi2 is None else chi2_tail(row.chi2, row.df)
    return scores.sparkSession.createDataFrame([(*row, p)], "n long, k long, chi2 double, df long, p double")


def student_tail(t: Column, df: Column) -> Column:
    """Two-sided tail for any whole degrees of freedom: a finite sum in cos^2, built by a fold.  Odd
    degrees add the angle itself and start the sum at cos; one degree has no sum."""
    theta = F.atan(t / F.sqrt(df.cast("double")))
    odd = df % 2 == 1
    c, c2 = F.cos(theta), F.cos(theta) * F.cos(theta)
    first = F.when(df == 1, F.lit(0.0)).when(odd, c).otherwise(F.lit(1.0))
    n = F.floor((df - F.when(odd, 3).otherwise(2)) / 2).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    ratio = lambda i: c2 * F.when(odd, (2 * i) / (2 * i + 1)).otherwise((2 * i - 1) / (2 * i))
    add = lambda a, i: F.struct((a["term"] * ratio(i)).alias("term"), (a["sum"] + a["term"] * ratio(i)).alias("sum"))
    total = F.sin(theta) * F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), add)["sum"]
    return F.greatest(F.lit(0.0), 1 - F.when(odd, (theta + total) * (2 / math.pi)).otherwise(total))


def conover(scores: DataFrame, control: str) -> DataFrame:
    """(treatment, t, p_raw, p_holm) of each treatment against the control."""
    r = ranks(scores)
    sums = r.groupBy("treatment").agg(F.sum("r").alias("R"))
    whole = r.agg(F.sum(F.col("r") * F.col("r")).alias("A"), F.count_distinct("block").alias("n"), F.count_distinct("treatment").alias("k"))
    squares = sums.agg(F.sum(F.col("R") * F.col("R")).alias("S"))
    d = sums.where(F.col("treatment") != control).crossJoin(sums.where(F.col("treatment") == control).select(F.col("R").alias("R0"))).crossJoin(whole).crossJoin(squares)
    df = (F.col("n") - 1) * (F.col("k") - 1)
    t = F.abs(F.col("R") - F.col("R0")) / F.sqrt(2 * (F.col("n") * F.col("A") - F.col("S")) / df)
    d = d.select("treatment", t.alias("t"), df.alias("df"))
    return holm(d.withColumn("p_raw", student_tail(F.col("t"), F.col("df"))), "p_raw", ["treatment"])


def conover_matrix(scores: DataFrame) -> DataFrame:
    """(a, b, t, df, p_raw) of all pairs of treatments, themselves included (p 1).  The values are not adjusted: the family that is tested
    is the control's, not the matrix."""
    r = ranks(scores)
    sums = r.groupBy("treatment").agg(F.sum("r").alias("R"))
    whole = r.agg(F.sum(F.col("r") * F.col("r")).alias("A"), F.count_distinct("block").alias("n"), F.count_distinct("treatment").alias("k"))
    names = sums.agg(F.sum(F.col("R") * F.col("R")).alias("S"), F.collect_list(F.struct("treatment", "R")).alias("_all"))  # a roster
    d = names.crossJoin(whole).withColumn("_a", F.explode("_all")).withColumn("_b", F.explode("_all"))
    df = (F.col("n") - 1) * (F.col("k") - 1)
    t = F.abs(F.col("_a.R") - F.col("_b.R")) / F.sqrt(2 * (F.col("n") * F.col("A") - F.col("S")) / df)
    d = d.select(F.col("_a.treatment").alias("a"), F.col("_b.treatment").alias("b"), t.alias("t"), df.alias("df"))
    return d.withColumn("p_raw", student_tail(F.col("t"), F.col("df")))


def cost_ratios(timing: DataFrame, roster: list[str], method: str, others: list[str]) -> DataFrame:
    """A row a data set of (dataset, method, cpu_seconds): each method's cost, and ``ratio_<other>``, the method's over the other's; null
    where either is absent or the other cost nothing."""
    wide = timing.groupBy("dataset").pivot("method", roster).agg(F.avg("cpu_seconds"))
    if absent := [m for m in (method, *others) if m not in roster]:
        raise ValueError(f"not in the roster: {absent}")
    over = lambda o: F.when(F.col(f"`{o}`") != 0, F.col(f"`{method}`") / F.col(f"`{o}`"))
    return wide.withColumns({f"ratio_{o}": over(o) for o in others})


def holm(df: DataFrame, p: str, tie: list[str], out: str = "p_holm") -> DataFrame:
    """Step-down adjustment: running maximum of (m - i) p, at most 1.  The family is one small table."""
    w = Window.orderBy(p, *tie)
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.withColumn("_m", F.count(F.lit(1)).over(all_)).withColumn("_i", F.row_number().over(w))
    d = d.withColumn(out, F.least(F.lit(1.0), F.max((F.col("_m") - F.col("_i") + 1) * F.col(p)).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return d.drop("_m", "_i")


def signed_rank_counts(m: Column) -> Column:
    """Number of subsets of 1..m with each sum: the coefficients of prod (1 + z^i)."""
    size = m * (m + 1) / 2 + 1
    start = F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    add = lambda c, i: F.transform(c, lambda x, w: x + F.when(w >= i, F.coalesce(F.get(c, w - i), F.lit(0.0))).otherwise(F.lit(0.0)))
    return F.aggregate(F.sequence(F.lit(1), m.cast("int")), start, add)


def wilcoxon(scores: DataFrame, control: str, decimals: int = 12) -> DataFrame:
    """Exact signed-rank test of the control against each treatment: wins, losses, ties, W, p_raw,
    p_holm, mean and median difference.  Zero differences leave the test."""
    c = scores.where(F.col("treatment") == control).select("block", F.col("score").alias("own"))
    d = scores.where(F.col("treatment") != control).join(c, "block").select("block", "treatment", F.round(F.col("own") - F.col("score"), decimals).alias("d"))
    counts = d.groupBy("treatment").agg(
        F.sum((F.col("d") > 0).cast("long")).alias("wins"), F.sum((F.col("d") < 0).cast("long")).alias("losses"), F.sum((F.col("d") == 0).cast("long")).alias("ties"), F.avg("d").alias("mean_delta"), F.percentile("d", F.lit(0.5)).alias("median_delta")
    )
    r = d.where("d <> 0").withColumn("a", F.abs("d")).withColumn("r", average_rank("a", ["treatment"]))
    w = r.groupBy("treatment").agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("down"), F.count(F.lit(1)).alias("m"), (F.count_distinct("a") < F.count(F.lit(1))).alias("equal_magnitudes"))
    w = w.withColumn("w", F.least("up", "down"))
    tail = F.aggregate(F.slice(signed_rank_counts(F.col("m")), 1, F.floor("w").cast("int") + 1), F.lit(0.0), lambda a, x: a + x)
    w = w.withColumn("p_raw", F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), F.col("m"))))
    out = counts.join(w.select("treatment", "w", "m", "p_raw", "equal_magnitudes"), "treatment", "left")
    return holm(out.withColumn("p_raw", F.coalesce("p_raw", F.lit(1.0))), "p_raw", ["treatment"])


def pivoted(scores: DataFrame, roster: list[str]) -> DataFrame:
    """block by treatment, means; the roster is given, so no pass finds it."""
    return scores.groupBy("block").pivot("treatment", roster).agg(F.avg("score"))


def power_law(df: DataFrame, key: str, n: str, cost: str) -> DataFrame:
    """Slope and intercept of log10 cost on log10 n per key."""
    x, y = F.log10(n), F.log10(cost)
    return df.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def affine_fit(df: DataFrame, target: str, features: list[str]) -> tuple[list[float], float, float]:
    """(coefficients, intercept, largest residual) of the least-squares fit; the normal equations
    come from one aggregate, the residual from a second."""
    import numpy as np

    cols = [*features, "_one"]
    d = df.withColumn("_one", F.lit(1.0))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate([*cols, target])]
    r = d.agg(*sums).first()
    k = len(cols)
    a = np.array([[r[f"{i}_{j}"] for j in range(k)] for i in range(k)])
    c = np.linalg.lstsq(a, np.array([r[f"{i}_{k}"] for i in range(k)]), rcond=None)[0]
    fit = sum((F.col(n) * float(v) for n, v in zip(features, c[:-1], strict=True)), F.lit(float(c[-1])))
    return c[:-1].tolist(), float(c[-1]), float(df.agg(F.max(F.abs(F.col(target) - fit))).first()[0])
