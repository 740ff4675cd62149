"""Document fingerprints by winnowing (native).

A document's words are hashed in runs of ``k``; of every ``window`` consecutive run hashes the
least is chosen, the rightmost on ties, and the chosen hashes with their positions are the
fingerprint.  Two texts that share ``window + k - 1`` consecutive words share a chosen hash.

Run hashes are Rabin-Karp polynomials in the word hashes modulo a prime.  Columns have no running scan, so
they do not roll one word at a time but by doubling: the polynomials of 1, 2, 4, ... words come from those
of half as many, which neighbours share, and each word is hashed once.  The least of a window comes the same
way: with run hash and position packed into one long, the least of 2, 4, 8, ... neighbours takes one pass
each, and the position, stored as its complement, makes the smaller long the one farther right.

``next_document`` pairs each document with the one after it in descending doc_id.  Ranges of ids
with bounds that are themselves ids are dealt to tasks; the document at a bound is sent to the
range above it too, so each task finds all its successors in one pass over its sorted rows and the
texts move once.  The bounds come from a sample of the ids; where one id has more rows than a range is
meant to hold, a hash of the text divides them.  A range that outgrows its size is streamed, not held.

Edge cases: a null text is empty and has the fingerprint ''; two empty fingerprints have likeness
1, an empty and another 0; fewer than ``k`` words make one run (the missing words count as 0), fewer than
``window`` runs make one window.  Rows that repeat an id follow each other in descending order of their
text's hash, then by text; a null id stands as the least long, so these rows come last.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import words

K, WINDOW = 5, 4
#: Modulus (a prime under 2**31, so that products fit a long) and base of the run hashes.
PRIME, BASE = 2**31 - 1, 1_000_003
#: Of the packed long: 31 bits of hash above, 31 bits of complemented position below.
_LAST = 2**31 - 1
#: Rows that a range of ids is meant to hold, the most ranges (the bounds are a driver's list) and ids sampled a range.
RANGE_ROWS, MAX_RANGES, SAMPLE = 1000, 65_536, 20
#: A null id; the tie of a bound that all rows of its id are within.
NO_ID, ALL = -(2**63), 2**63 - 1


def add_fingerprint(df: DataFrame, text: Column, name: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds ``name``: array of longs, hash << 31 | (2**31 - 1 - position), in order of position."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    h, r, m = f"{name}_h", f"{name}_r", f"{name}_m"
    df = df.withColumn(h, F.transform(words(text), lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME)))).withColumn(r, F.col(h))
    size = 1
    for bit in f"{k:b}"[1:]:  # r: hashes of runs of `size` words
        df = df.withColumn(r, F.transform(r, _then(r, size, pow(BASE, size, PRIME))))
        size *= 2
        if bit == "1":
            df = df.withColumn(r, F.transform(r, _then(h, size, BASE)))
            size += 1
    n = F.size(h)
    pack = lambda x, i: F.shiftleft(x, 31).bitwiseOR(F.lit(_LAST).cast("long") - i)
    runs = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(r, 1, F.greatest(n - (k - 1), F.lit(1))), pack))
    df = df.withColumn(m, runs).drop(h, r)
    step = 1
    while step < window:
        # least of 2*step neighbours; at the right end there are fewer, and then the whole rest counts.
        df = df.withColumn(m, F.transform(m, _least_with(m, step)))
        step *= 2
    # The windows that reach past the end hold no choice of their own.
    chosen = F.array_distinct(F.slice(m, 1, F.greatest(F.size(m) - (window - 1), F.lit(1))))
    return df.withColumn(name, chosen).drop(m)


def _then(name: str, at: int, factor: int):
    """A run's hash and, behind it, the one that starts ``at`` words on, as the hash of both together."""
    return lambda x, i: (x * F.lit(factor).cast("long") + F.coalesce(F.get(F.col(name), i + at), F.lit(0).cast("long"))) % PRIME


def _least_with(name: str, step: int):
    return lambda x, i: F.least(x, F.get(F.col(name), i + step))


def hashes(fp: Column) -> Column:
    return F.array_distinct(F.transform(fp, lambda x: F.shiftright(x, 31)))


def positions(fp: Column) -> Column:
    return F.transform(fp, lambda x: F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST)))


def as_text(fp: Column) -> Column:
    """``hash@position`` in hex, comma-joined."""
    return F.array_join(F.transform(fp, lambda x: F.concat(F.hex(F.shiftright(x, 31)), F.lit("@"), F.hex(F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two hash sets; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long"))


def _tie() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def id_bounds(docs: DataFrame, n: int, range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES) -> list[tuple[int, int]]:
    """Bounds (id, tie) of the ranges of ``n`` rows, ascending, the last of the largest id.  Texts are read only
    where some id has more rows than a range."""
    if not n:
        return []
    import numpy as np

    ids = docs.select(_id().alias("i"))
    many = not ids.groupBy("i").count().where(F.col("count") > range_rows).isEmpty()
    d = docs.select(_id().alias("i"), _tie().alias("t")) if many else ids.withColumn("t", F.lit(ALL).cast("long"))
    top = d.agg(F.max(F.struct("i", "t")).alias("m")).select("m.*").first()
    ranges = min(max_ranges, -(-n // range_rows))
    share = min(1.0, SAMPLE * ranges / n)
    if share < 1:
        d = d.where(F.pmod(F.xxhash64("i", "t", F.lit("bound")), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = d.toArrow()  # about SAMPLE ids a range
    i, t = (found.column(c).to_numpy() for c in ("i", "t"))
    order = np.lexsort((t, i))
    cuts = order[np.arange(1, ranges) * len(order) // ranges] if len(order) else order
    return sorted({*zip(i[cuts].tolist(), t[cuts].tolist(), strict=True), tuple(top)})


def next_document(docs: DataFrame, bounds: list[tuple[int, int]], derive=lambda d: d) -> DataFrame:
    """doc_id, text, what ``derive`` adds, and each but doc_id again as ``next_...`` of the next
    document; ``bounds``: of ``id_bounds``.  ``derive`` runs once a row, after the texts moved."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_id", _id())
    split = any(t != ALL for _, t in bounds)
    d = d.withColumn("_tie", _tie() if split else F.lit(ALL).cast("long"))
    bounds = bounds or [(NO_ID, ALL)]
    # Range j holds the rows over bound j-1, up to bound j.  Found by halving: `size` is a power of two.
    size = 1 << (len(bounds) - 1).bit_length()
    edges, ties = F.lit([i for i, _ in bounds]), F.lit([t for _, t in bounds])
    steps, s = [], size // 2
    while s:
        steps.append(s)
        s //= 2
    under = lambda k: (F.get(edges, k) < F.col("_id")) | ((F.get(edges, k) == F.col("_id")) & (F.get(ties, k) < F.col("_tie")))
    j = F.lit(0)
    if steps:
        j = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.coalesce(under(at + s - 1), F.lit(False)), at + s).otherwise(at))
    d = d.withColumn("_j", j)
    # A bound's document also closes the range above; the largest id closes the lowest range, after its last document.
    last = len(bounds) - 1
    at_bound = (F.col("_id") == F.get(edges, F.col("_j"))) & (F.col("_tie") == F.get(ties, F.col("_j")))
    own = F.struct(F.col("_j").alias("j"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.when(F.col("_j") == last, F.lit(0)).otherwise(F.col("_j") + 1).alias("j"), F.when(F.col("_j") == last, F.lit(2)).otherwise(F.lit(1)).alias("ghost"))
    d = d.withColumn("_at", F.explode(F.when(at_bound, F.array(own, ghost)).otherwise(F.array(own)))).select("doc_id", "text", F.col("_at.j").alias("_j"), F.col("_at.ghost").alias("_ghost"))
    d = derive(d.repartition("_j").withColumns({"_id": _id(), "_tie": _tie()}))
    w = Window.partitionBy("_j").orderBy("_ghost", F.col("_id").desc(), F.col("_tie").desc(), "text")
    own = ("doc_id", "_j", "_ghost", "_id", "_tie")
    return d.withColumns({f"next_{c}": F.lead(c).over(w) for c in d.columns if c not in own}).where("_ghost = 0").drop(*own[1:])


def fingerprint_documents(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    n = docs.count()
    d = next_document(docs, id_bounds(docs, n), lambda d: add_fingerprint(d, F.col("text"), "fp", k, window))
    d = d.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    d = d.withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.col("next_text"), F.lit(1), third)))
    d = add_fingerprint(d, F.col("_edited"), "edited_fp", k, window)
    d = d.withColumns({f"{x}_set": hashes(F.col(x)) for x in ("fp", "edited_fp", "next_fp")})
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp_set"), F.col("edited_fp_set")).alias("near_edited"),
        likeness(F.col("fp_set"), F.col("next_fp_set")).alias("near_next"),
    )
