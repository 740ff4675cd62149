"""Vector codes: product quantisation in whole numbers over weighted distinct parts.

A component x is the integer floor(1024 * x); a vector is cut into ``parts`` equal consecutive parts, and
each position has a codebook of up to ``entries`` entries.  Equal parts of a position are grouped into one row
with their number as its weight, and the rounds run over these rows alone: a task finds the nearest entry of
its rows (ties to the lower index), adds up weighted components and weights an entry, and the sums of the
tasks meet in one grouping, whose rows (entries x width at most, whatever the data) are the next
codebook.  Afterwards code and error of each distinct part are joined back to the vectors.  Parts that
more than a thousandth of the vectors share are few by counting, so they are broadcast; the others
are shuffled, and so a part that a third of all vectors share is no hot key.  Sums of error a label go the
same way.

Arithmetic is exact: matrix products of doubles while every product stays under 2**53, else Python
integers.  Components beyond 2**62 in size count as 2**62, and an error beyond a long as the largest long.

Edge cases: vectors that are null, empty or hold null or non-finite components go; the width is that of
the smallest vec_id that stays, and vectors of another width go as well (there is no part to compare); a width
that ``parts`` does not divide is filled with zeros behind; null vec_ids stand after all others, and rows that
share a vec_id stand by their components; repeated rows each count and each return; with fewer vectors
than entries the codebook has as many entries as vectors; an empty table gives an empty result; columns
beside the three do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: A key with over a 1/HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
LIMIT = 1 << 62
LONG = (1 << 63) - 1


# --- whole numbers ----------------------------------------------------------------------------


def quantise(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as int64, at most 2**62 in size."""
    with np.errstate(over="ignore"):
        y = np.floor(np.asarray(x, np.float64) * SCALE)
    big = np.abs(y) >= LIMIT
    return np.where(big, np.where(y < 0, -LIMIT, LIMIT), np.where(big, 0, y).astype(np.int64))


def pack(parts: np.ndarray) -> list[bytes]:
    """Each row in the narrowest of 2, 4 or 8 bytes a number that holds all of it, so equal rows are equal bytes."""
    size = np.abs(parts).max(axis=1) if parts.shape[1] else np.zeros(len(parts), np.int64)
    out: list[bytes] = [b""] * len(parts)
    for kind, lo, hi in (("<i2", -1, 1 << 15), ("<i4", (1 << 15) - 1, 1 << 31), ("<i8", (1 << 31) - 1, None)):
        rows = np.flatnonzero((size > lo) & (size < hi) if hi else size > lo)
        data = parts[rows].astype(kind).tobytes()
        step = parts.shape[1] * int(kind[2])
        for k, r in enumerate(rows.tolist()):
            out[r] = data[k * step : (k + 1) * step]
    return out


def unpack(parts: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(parts), width), np.int64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    for n in (2, 4, 8):
        rows = np.flatnonzero(sizes == n * width)
        if len(rows) and width:
            out[rows] = np.frombuffer(b"".join(parts[r] for r in rows.tolist()), f"<i{n}").reshape(-1, width)
    return out


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of each row, the lowest index of equally near ones."""
    most = max([1, *(int(np.abs(a).max()) for a in (parts, book) if a.size)])
    kind = np.float64 if 4 * max(1, book.shape[1]) * most * most < 1 << 53 else object
    b = book.astype(kind)
    own = (b * b).sum(axis=1)
    at, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), object if kind is object else np.int64)
    step = max(1, 2_000_000 // max(1, len(book)))
    for lo in range(0, len(parts), step):
        a = parts[lo : lo + step].astype(kind)
        d = own - 2 * (a @ b.T)
        k = d.argmin(axis=1)
        at[lo : lo + step] = k
        error[lo : lo + step] = d[np.arange(len(a)), k] + (a * a).sum(axis=1)
    return at, error


def weighted_sums(parts: np.ndarray, at: np.ndarray, weight: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted component sums and weights of each entry, as exact integers."""
    most = int(np.abs(parts).max()) if parts.size else 0
    kind = np.int64 if most * int(weight.sum()) < 1 << 62 else object
    sums, counts = np.zeros((entries, parts.shape[1]), kind), np.zeros(entries, np.int64)
    np.add.at(sums, at, parts.astype(kind) * weight.astype(kind)[:, None])
    np.add.at(counts, at, weight)
    return sums, counts


# --- tables -----------------------------------------------------------------------------------


def kept_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, x): rows whose vector is whole and finite."""
    x = F.col(f"`{vector}`")
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return vectors.select("vec_id", "label", x.cast("array<double>").alias("x")).where((F.size("x") > 0) & F.forall("x", good))


def part_rows(kept: DataFrame, parts: int, width: int) -> DataFrame:
    """(row, vec_id, label, position, part) from (row, vec_id, label, x)."""
    import pyarrow as pa

    filled = -(-width // parts) * parts

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            n = b.num_rows
            x = np.zeros((n, filled), np.int64)
            x[:, :width] = quantise(b.column(3).flatten().to_numpy(zero_copy_only=False)).reshape(n, width)
            each = pa.array(np.repeat(np.arange(n), parts))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(each) for c in range(3)), pa.array(np.tile(np.arange(parts, dtype=np.int32), n)), pa.array(pack(x.reshape(n * parts, filled // parts)), pa.binary())], ["row", "vec_id", "label", "position", "part"])

    kinds = dict(kept.dtypes)
    return kept.select("row", "vec_id", "label", "x").mapInArrow(run, f"row long, vec_id {kinds['vec_id']}, label {kinds['label']}, position int, part binary")


def lloyd_round(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over (position, part, weight)."""
    import pyarrow as pa

    width = books[0].shape[1]
    entries = len(books[0])

    def run(batches: Iterator) -> Iterator:
        sums = [np.zeros((entries, width), object) for _ in books]
        counts = [np.zeros(entries, np.int64) for _ in books]
        for b in batches:
            position, part, weight = b.column(0).to_numpy(), unpack(b.column(1).to_pylist(), width), b.column(2).to_numpy()
            for p, book in enumerate(books):
                own = position == p
                if own.any():
                    s, c = weighted_sums(part[own], nearest(part[own], book)[0], weight[own], entries)
                    sums[p] += s
                    counts[p] += c
        for p in range(len(books)):
            k = np.flatnonzero(counts[p])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), p, np.int32)), pa.array(k.astype(np.int32)), pa.array(counts[p][k]), pa.array([[str(x) for x in row] for row in sums[p][k]], pa.list_(pa.string()))], ["position", "entry", "n", "sums"])

    told = distinct.select("position", "part", "weight").mapInArrow(run, "position int, entry int, n long, sums array<string>")
    told = told.select("position", "entry", "n", F.posexplode("sums").alias("at", "sum"))
    told = told.groupBy("position", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    out = [b.copy() for b in books]
    for r in told.collect():  # a row an entry, position and component at most
        out[r.position][r.entry, r.at] = int(r["sum"]) // r.n
    return out


def coded(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(position, part, weight, code, error) with the nearest entries."""
    import pyarrow as pa

    width = books[0].shape[1]

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            position, part = b.column(0).to_numpy(), unpack(b.column(1).to_pylist(), width)
            code, error = np.zeros(len(position), np.int32), np.zeros(len(position), object)
            for p, book in enumerate(books):
                own = position == p
                if own.any():
                    code[own], error[own] = nearest(part[own], book)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(code), pa.array([min(int(e), LONG) for e in error], pa.int64())], ["position", "part", "weight", "code", "error"])

    return distinct.select("position", "part", "weight").mapInArrow(run, "position int, part binary, weight long, code int, error long")


def join_back(rows: DataFrame, facts: DataFrame, on: Column, weight: str, total: int, scratch: Scratch) -> DataFrame:
    """``rows`` with the columns of ``facts``, one row of which fits each of them.  Facts that more than a thousandth of all rows
    ask for, fewer than a thousand, are broadcast; the others meet their rows in a shuffle."""
    hot = F.col(weight) * HOT_SHARE > total
    few = scratch.keep(facts.where(hot), "hot")
    rest = rows.join(facts.where(~hot), on)
    if few.isEmpty():
        return rest
    return rows.join(F.broadcast(few), on).unionByName(rest)


def first_books(kept: DataFrame, parts: int, entries: int, width: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids, one codebook a position."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), F.transform("x", lambda c: F.floor(c * SCALE))).limit(entries).select("x").collect()
    x = np.zeros((len(rows), -(-width // parts) * parts), np.int64)
    x[:, :width] = quantise(np.array([r.x for r in rows]))
    return np.split(x, parts, axis=1)


def saturated_sum(column: str) -> Column:
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error) and the final codebooks; code has two hex digits a part (more beyond 256 entries)."""
    scratch = Scratch(vectors.sparkSession)
    kept = scratch.keep(kept_vectors(vectors, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    kinds = dict(kept.dtypes)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), F.transform("x", lambda c: F.floor(c * SCALE))).select(F.size("x")).first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, label_error long"), []
    width = first[0]
    kept = kept.where(F.size("x") == width)
    total = kept.count()
    books = first_books(kept, parts, entries, width)
    rows = scratch.keep(part_rows(kept, parts, width), "parts")
    distinct = scratch.keep(rows.groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")), "distinct")
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    facts = scratch.keep(coded(distinct, books), "coded")
    facts = facts.withColumnsRenamed({"position": "_p", "part": "_v"})
    found = join_back(rows, facts, (F.col("position") == F.col("_p")) & (F.col("part") == F.col("_v")), "weight", total, scratch)
    digits = max(2, len(f"{entries - 1:x}"))
    by_row = found.groupBy("row", "vec_id", "label").agg(F.array_sort(F.collect_list(F.struct("position", "code"))).alias("codes"), saturated_sum("error").alias("error"))
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c["code"]), digits, "0")), ""))
    by_row = scratch.keep(by_row.select("vec_id", "label", code.alias("code"), "error"), "codes")
    labels = by_row.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), saturated_sum("error").alias("label_error")).withColumnRenamed("label", "_l")
    labels = scratch.keep(labels, "labels")
    out = join_back(by_row, labels, F.col("label").eqNullSafe(F.col("_l")), "_n", total, scratch)
    return out.select("vec_id", "label", "code", "error", "label_error"), books


def decompress(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``codes`` with vector: the entries that the code names, as doubles at the middle of their integer step."""
    table = [[[(int(x) + 0.5) / SCALE for x in e] for e in b] for b in books]
    digits = max(2, len(f"{len(books[0]) - 1:x}"))

    @F.pandas_udf("array<double>")
    def run(code: pd.Series) -> pd.Series:
        return code.map(lambda c: [x for p, book in enumerate(table) for x in book[int(c[p * digits : (p + 1) * digits], 16)]])

    return codes.withColumn("vector", run("code"))


def _oracle(width: int = 64, parts: int = PARTS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for vectors of ``width``: integers as doubles, whose inner products are exact."""
    w = width // parts
    kind = f"DOUBLE[{w}]"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, position, x[position * {w} + 1 : position * {w} + {w}]::{kind} AS part FROM v, (SELECT unnest(range({parts})) AS position))",
        f"b0 AS MATERIALIZED (SELECT position, entry, part AS e FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {ENTRIES})",
    ]
    near = lambda k: f"(SELECT vec_id, label, p.position, any_value(part) AS part, min(struct_pack(d := array_inner_product(part, part) - 2 * array_inner_product(part, e) + array_inner_product(e, e), entry := entry)) AS m FROM p JOIN b{k} b ON p.position = b.position GROUP BY vec_id, label, p.position)"
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED (SELECT position, m.entry AS entry, [{', '.join(f'floor(sum(part[{i + 1}]) / count(*))' for i in range(w))}]::{kind} AS e FROM {near(k)} GROUP BY position, m.entry)")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.position, b.entry, coalesce(a.e, b.e) AS e FROM b{k} b LEFT JOIN a{k} a ON b.position = a.position AND b.entry = a.entry)")
    steps += [
        f"f AS (SELECT vec_id, label, string_agg(lower(lpad(hex(m.entry), 2, '0')), '' ORDER BY position) AS code, sum(m.d)::BIGINT AS error FROM {near(rounds)} GROUP BY vec_id, label)",
        f"g AS (SELECT sha256(string_agg(array_to_string(list_transform(e::DOUBLE[], lambda x: x::BIGINT), ','), ',' ORDER BY position, entry)) AS books FROM b{rounds})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, books AS codebooks_sha256 FROM f, g"


ORACLE_SQL = _oracle()
