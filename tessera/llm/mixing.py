"""Mixing sources to target weights by hash-threshold histograms (native).

Every document has a fixed 60-bit hash of its id.  A source's remaining budget is the sum of the
sizes of its documents below a hash threshold, and the threshold is found from histograms of
summed sizes by (source, hash bucket): a window over at most ``2**BITS`` buckets finds the bucket
in which the budget ends, and only that bucket is split again by the next bits.  No document is
sorted, and a larger budget's documents contain those of a smaller one.

Edge cases: a null text has size 0; a null source is a source of its own and ranks last; a source
of size 0 has target 0; rows that repeat an id share its hash and are taken or left together; an
empty table gives an empty result.  Columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, bounded_broadcast, n_words

#: Bits of the hash, and those that a histogram resolves at a time.
HASH_BITS, BITS = 60, 12
MAX_COPIES = 3


def doc_hash(doc_id: Column) -> Column:
    """The first 60 bits of the md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: int = MAX_COPIES, budget: float = 1.0) -> DataFrame:
    """(source, source_size, target) from one row per source.

    Water filling in closed form: with sources in the order of cap/weight, those before the level
    stand at their cap and the rest share what is left by weight, so one window over the table of
    sources gives what resharing round by round converges to.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size").cast("double") * max_copies)
    by_level = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    # The first source whose cap is above its share at its own level fixes the level of all after it.
    s = s.withColumn("_open", F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("level"))))
    level = F.min("_open").over(everything)["level"]
    target = F.least("_cap", F.coalesce(level * F.col("_w"), F.col("_cap")))
    return s.select("source", "source_size", target.alias("target"))


def hash_thresholds(scratch: Scratch, sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): documents with hash below it sum to the source's ``budget``, to within
    the last document.  ``budgets``: one row per source."""
    done = None
    open_ = budgets.select("source", F.col("budget").alias("_left"), F.lit(0).cast("long").alias("_prefix"))
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        bucket = F.shiftright(F.col("hash"), shift)
        part = sizes.alias("d").join(open_.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.shiftright(F.col("hash"), shift + BITS) == F.col("o._prefix")))
        hist = part.groupBy("d.source", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"), F.min("hash").alias("_lo"), F.max("hash").alias("_hi"), F.first("_left").alias("_left"))
        w = Window.partitionBy("source").orderBy("_bucket")
        run = hist.withColumn("_to", F.sum("_sum").over(w)).withColumn("_from", F.col("_to") - F.col("_sum"))
        # One boundary bucket per source: the first that reaches the budget.  None: all documents are below.
        edge = run.where((F.col("_to") >= F.col("_left")) & (F.col("_from") < F.col("_left")))
        edge = scratch.keep(edge.select("source", "_bucket", (F.col("_left") - F.col("_from")).alias("_left"), "_sum", "_lo", "_hi"), "edge")
        single = (F.col("_lo") == F.col("_hi")) | F.lit(shift == 0)
        # A bucket of one hash value is taken if that lands nearer the budget.
        ended = edge.where(single).select("source", F.when(F.col("_sum") - F.col("_left") < F.col("_left"), F.col("_hi") + 1).otherwise(F.col("_lo")).alias("threshold"))
        done = ended if done is None else done.unionByName(ended)
        open_ = edge.where(~single).select("source", "_left", F.col("_bucket").alias("_prefix"))
        if shift == 0 or open_.isEmpty():
            break
    return done


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: int = MAX_COPIES, budget: float = 1.0, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan).  sizes: doc_id, source, size, hash of every document.  plan: one row per source
    with source_size, target, copies of every document, and the threshold under which one more is taken."""
    scratch = scratch or Scratch(docs.sparkSession)
    sizes = scratch.keep(docs.select("doc_id", F.col("source"), n_words(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("hash")), "sizes")
    targets = scratch.keep(source_targets(sizes, weights, max_copies, budget), "targets")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("copies", copies).withColumn("_budget", F.col("target") - F.col("copies") * F.col("source_size"))
    cut = hash_thresholds(scratch, sizes, targets.where("_budget > 0").select("source", F.col("_budget").alias("budget")))
    threshold = F.when(F.col("_budget") > 0, F.coalesce("threshold", F.lit(2**HASH_BITS))).otherwise(F.lit(0)).cast("long")
    plan = targets.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.source", "source_size", "target", "copies", threshold.alias("threshold"))
    return sizes, scratch.keep(plan, "plan")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: int = MAX_COPIES, budget: float = 1.0) -> DataFrame:
    """doc_id, size, source_size, target, taken: whole copies of each document, at most ``max_copies``.

    A source below its target repeats all its documents ``floor(target/size)`` times and takes the
    documents below its threshold once more.
    """
    sizes, plan = plan_mix(docs, weights, max_copies, budget)
    more = (F.col("d.hash") < F.col("p.threshold")).cast("long")
    return sizes.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "d.doc_id", "d.size", "p.source_size", "p.target", (F.col("d.size") * (F.col("p.copies") + more)).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: int = MAX_COPIES, budget: float = 1.0) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; a document without words, which
    has no share in the sizes, stays once.  The plan has a row per source and is broadcast if it is
    small, so the texts do not move."""
    _, plan = plan_mix(docs, weights, max_copies, budget)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d = docs.select(row.alias("d"), n_words(F.col("text")).alias("n"), doc_hash(F.col("doc_id")).alias("h"))
    d = d.join(bounded_broadcast(plan.withColumnRenamed("source", "s")), F.col("d.source").eqNullSafe(F.col("s")))
    times = F.when(F.col("n") == 0, F.lit(1)).otherwise((F.col("copies") + (F.col("h") < F.col("threshold")).cast("long")).cast("int"))
    d = d.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return d.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE cap > level * w ORDER BY cap / w LIMIT 1) * w, cap)) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
c AS (SELECT *, target - copies * source_size AS budget FROM b),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
run AS (SELECT source, h, size, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
pick AS (SELECT run.source, run.h, (run.upto <= c.budget OR (run.upto - run.size < c.budget AND run.upto - c.budget < c.budget - (run.upto - run.size))) AS more
         FROM run JOIN c ON run.source IS NOT DISTINCT FROM c.source)
SELECT d.doc_id, d.size, c.source_size, c.target, (d.size * (c.copies + CASE WHEN c.budget > 0 AND pick.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source JOIN pick ON d.source IS NOT DISTINCT FROM pick.source AND d.h = pick.h
"""
