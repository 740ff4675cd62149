"""Quality rules: hashed n-gram log-likelihood ratio, trusted target against raw corpus (native).

Words and word pairs of a text are hashed into ``buckets`` bins.  Two multinomials over the bins,
one of the trusted documents and one of all documents, give each bin a log ratio; a document's
score is the mean log ratio of its n-grams, and it is kept at ``min_score`` or above, so the
verdict on a document is a fixed function of its text and the two count tables.

The counts come from every document; only ``buckets`` rows of counts leave a task.  The ratios go
back into the scoring scan as one literal array (``buckets`` doubles, bounded by that parameter),
so neither scan shuffles a text unless there are too many trusted ids to
broadcast.

Edge cases: a null text has no words; a text without n-grams scores 0; with no trusted document
all ratios are 0 and only the base rules decide; ids that repeat are scored row by row; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, SPACES, bounded_broadcast, words

BUCKETS = 16_384
#: Mean log ratio (nats an n-gram) under which a document is unlike the trusted target.
MIN_SCORE = -0.05
#: Added to both counts of a bin.
SMOOTHING = 1.0
SYMBOLS = "[#*$%&|<>]"
#: Up to so many repeated windows are looked for one by one; beyond, by a sort.
FEW = 16


def _word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _pair(h: Column) -> Column:
    n = F.size(h)
    return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(h, 1, F.greatest(n - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1))))


def _bins(h: Column, buckets: int) -> Column:
    """Bins of the words and of the word pairs, from word hashes."""
    return F.transform(F.concat(h, _pair(h)), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def bin_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(bin, raw, target): n-grams of all documents and of those in ``trusted`` (doc_id)."""
    ids = bounded_broadcast(trusted.select(F.col("doc_id").alias("_id")).distinct(), broadcast_rows)
    d = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left")
    d = d.select(F.col("_id").isNotNull().cast("long").alias("_in"), _word_hashes(words(F.col("text"))).alias("_h"))
    d = d.select("_in", F.explode(_bins(F.col("_h"), buckets)).alias("bin"))
    return d.groupBy("bin").agg(F.count(F.lit(1)).alias("raw"), F.sum("_in").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """The log ratio of each of the ``buckets`` bins; all are 0 without a target."""
    spark = counts.sparkSession
    full = spark.range(buckets).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").na.fill(0)
    pairs = full.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("bin", "raw", "target"))).alias("_c"), F.sum("raw").alias("_raw"), F.sum("target").alias("_target")
    )
    ratio = lambda c: F.when(F.col("_target") == 0, F.lit(0.0)).otherwise(
        F.log((c["target"] + smoothing) / (F.col("_target") + smoothing * buckets)) - F.log((c["raw"] + smoothing) / (F.col("_raw") + smoothing * buckets))
    )
    return pairs.select(F.transform("_c", ratio).alias("ratios")).first()[0]


def score_documents(docs: DataFrame, ratios: list[float], buckets: int = BUCKETS, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, the counts of the base rules, base_failed, score, kept: one row a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one literal
    d = docs.select("doc_id", text.alias("_t"), words(F.col("text")).alias("_w"))
    bare = F.col("_t")
    for c in SPACES:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    d = d.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(bare).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        _word_hashes(F.col("_w")).alias("_h"),
    )
    n = F.size("_h")
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice("_h", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col("_h"), i + 1), F.get(F.col("_h"), i + 2)))
    )
    d = d.withColumns({"n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"), "_win": windows, "_bins": _bins(F.col("_h"), buckets)}).drop("_l", "_h")
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_win")) == F.size("_win"), F.array().cast("array<bigint>")).otherwise(F.array_sort("_win")))
    d = d.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda x, i: (i > 0) & (x == F.get(F.col("_sorted"), i - 1))))).drop("_sorted")
    at = F.transform("_win", lambda x, i: F.when(F.array_contains(F.col("_twice"), x), i))
    few = F.filter(at, lambda i: i.isNotNull())
    # Many repeats: sort (hash, place) and keep the places whose hash stands beside an equal one.
    d = d.withColumn("_pairs", F.when(F.size("_twice") > FEW, F.array_sort(F.transform("_win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    beside = lambda p, j: (p["x"] == F.get(F.col("_pairs"), j - 1)["x"]) | (p["x"] == F.get(F.col("_pairs"), j + 1)["x"])
    many = F.transform(F.filter("_pairs", lambda p, j: F.coalesce(beside(p, j), F.lit(False))), lambda p: p["i"])
    d = d.withColumn("_at", F.when(F.size("_twice") == 0, F.array().cast("array<int>")).when(F.size("_twice") <= FEW, few).otherwise(many))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_at", lambda i: F.array(i, i + 1, i + 2)))))
    d = d.withColumns(
        {
            "n_repeat_words": covered.cast("long"),
            "score": F.when(F.size("_bins") == 0, F.lit(0.0)).otherwise(F.aggregate("_bins", F.lit(0.0), lambda a, b: a + F.get(weights, b)) / F.size("_bins")),
        }
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    d = d.withColumn("base_failed", failed)
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= min_score)).alias("kept")
    )


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, min_score: float = MIN_SCORE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    ratios = log_ratios(bin_counts(docs, trusted, buckets, broadcast_rows), buckets)
    return score_documents(docs, ratios, buckets, min_score)
