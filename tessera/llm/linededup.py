"""Line dedup by a sharded minimal perfect hash.

A line's key is the line without white space at its ends, A-Z lower-cased; a key of at least
``min_chars`` code points that two documents hold loses all its lines except in the document with
the smallest doc_id.  Keys stand as 128-bit hashes.  Grouping them finds those of two documents
or more with the smallest and the number of their documents; these are dealt to shards by hash,
and each shard becomes one row of arrays: the bit levels of a minimal perfect hash, and at a key's
place a compact fingerprint, its holder and its count.  Documents' line hashes probe the arrays of
their shard, which answer what to drop; the text of a line is never joined or shuffled for that.
Shards hold about ``shard_keys`` keys at any size, and a shard that is probed more than ``group_probes``
times (it holds a line that a third of all documents share, say) has as many copies of its arrays as its own
probes call for.

Edge cases: a null or empty text is one empty line; null doc_ids count as one document after all
others (their rows are told apart by a hash of their text, so they make no hot key); rows that repeat a doc_id are one document, and each is returned with the same decisions;
an empty table gives an empty result; keys that two lines of one document share are dropped or
stay together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, bounded_broadcast, utf8

MIN_CHARS = 10
SHARD_KEYS = 50_000
#: Probes that one copy of a shard's arrays answers.
GROUP_PROBES = 200_000
#: Stands for a null doc_id, after all others.
NO_ID = 2**63 - 1


# --- minimal perfect hash ---------------------------------------------------------------------


def _mix(k: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) of the key under a level's seed."""
    with np.errstate(over="ignore"):
        z = k + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct uint64 keys: bit levels twice as wide as the keys still
    unplaced; a key lives at the first level where it alone has its bit, and its place is the
    number of set bits before it.  ``rest``: keys that no level separated, after the others."""

    MAX_LEVELS = 40

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.before, n = [], 0
        for bits in levels:
            self.before.append(n + np.cumsum(bits, dtype=np.int64) - bits)
            n += int(bits.sum())
        self.placed = n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(keys)
        while len(left) and len(levels) < cls.MAX_LEVELS:
            m = max(64, 2 * len(left))
            at = (_mix(left, len(levels)) % np.uint64(m)).astype(np.int64)
            bits = np.bincount(at, minlength=m) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return cls(levels, left)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys; for a key that is not of the set, any place or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = (_mix(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.before[level][at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            i = np.clip(np.searchsorted(self.rest, keys[open_]), 0, len(self.rest) - 1)
            same = self.rest[i] == keys[open_]
            out[open_[same]] = self.placed + i[same]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.rest), *map(len, self.levels)], dtype=np.int64)
        return np.int64(len(sizes)).tobytes() + sizes.tobytes() + self.rest.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8)
        at = 8 + 8 * n
        rest = np.frombuffer(data, np.uint64, int(sizes[0]), at)
        at += 8 * int(sizes[0])
        levels = []
        for m in map(int, sizes[1:]):
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, (m + 7) // 8, at), count=m).astype(bool))
            at += (m + 7) // 8
        return cls(levels, rest)


# --- lines ------------------------------------------------------------------------------------


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """16 hash bytes of a line's key, None if the key is too short to count."""
    import xxhash

    key = line.strip().lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def salt() -> Column:
    """Tells rows without an id apart."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("salt")


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, salt, h1, h2): the distinct keys of each document."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            ids, salts, out, who, whose = b.column(0).to_pylist(), b.column(2).to_pylist(), [], [], []
            for i, t, s in zip(ids, utf8(b.column(1)), salts, strict=True):
                keys = {line_key(x, min_chars) for x in t.split(b"\n")} - {None}
                out.extend(keys)
                who.extend([NO_ID if i is None else i] * len(keys))
                whose.extend([s] * len(keys))
            h = np.frombuffer(b"".join(out), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(whose, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", "salt", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", salt()).mapInArrow(run, "doc_id long, salt long, h1 long, h2 long")


def _key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return h1.view(np.uint64) ^ _mix(h2.view(np.uint64), 0)


def build_shards(shared: DataFrame, shards: int) -> DataFrame:
    """One row of arrays a shard from (h1, h2, holder, docs)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        k = _key(pdf.h1.to_numpy(np.int64), pdf.h2.to_numpy(np.int64))
        # Two keys may share the 64 bits hashed here; the later ones stand in `more`, found by all 128.
        _, first = np.unique(k, return_index=True)
        mph = PerfectHash.build(k[first])
        order = np.empty(len(first), dtype=np.int64)
        order[mph.place(k[first])] = first
        more = np.setdiff1d(np.arange(len(k)), first)
        col = lambda c: pdf[c].to_numpy(np.int64)[order].tobytes()
        return pd.DataFrame({"shard": [pdf.shard.iat[0]], "mph": [mph.dump()], "prints": [col("h2")], "holders": [col("holder")], "counts": [col("docs")], "more": [pdf[["h1", "h2", "holder", "docs"]].to_numpy(np.int64)[more].tobytes()]})

    return shared.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, mph binary, prints binary, holders binary, counts binary, more binary")


def probe(arrays: pd.DataFrame, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Holder and count of each key; count 0 if the key is not of the shard."""
    row = arrays.iloc[0]
    prints, holders, counts = (np.frombuffer(row[c], np.int64) for c in ("prints", "holders", "counts"))
    at = PerfectHash.load(row["mph"]).place(_key(h1, h2))
    at = np.where((at >= 0) & (prints[at] == h2), at, -1) if len(prints) else np.full(len(h1), -1)
    holder, count = np.where(at >= 0, holders[at], 0), np.where(at >= 0, counts[at], 0)
    for a, b, who, n in np.frombuffer(row["more"], np.int64).reshape(-1, 4):
        same = (h1 == a) & (h2 == b)
        holder[same], count[same] = who, n
    return holder, count


def shard_copies(asked: DataFrame, group_probes: int = GROUP_PROBES) -> DataFrame:
    """(shard, copies) of the shards that are asked more than ``group_probes`` times."""
    copies = F.ceil(F.col("n") / group_probes).cast("int").alias("copies")
    return asked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_probes).select("shard", copies)


def decisions(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, group_probes: int = GROUP_PROBES) -> DataFrame:
    """(doc_id, salt, lost): 16-byte hashes, concatenated, of the keys that a document loses."""
    lines = scratch.keep(line_hashes(docs, min_chars), "lines")
    shared = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("_last"), F.count(F.lit(1)).alias("docs")).where("holder < _last").drop("_last")
    shared = scratch.keep(shared, "shared")
    shards = max(1, -(-shared.count() // shard_keys))
    arrays = scratch.keep(build_shards(shared, shards), "shards")
    asked = lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    hot = bounded_broadcast(scratch.keep(shard_copies(asked, group_probes), "hot"))
    copies = F.coalesce("copies", F.lit(1))
    asked = asked.join(hot, "shard", "left").withColumn("copy", F.pmod(F.xxhash64("doc_id", "salt"), copies).cast("int")).drop("copies")
    dealt = arrays.join(hot, "shard", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")

    def answer(lines: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if not len(lines) or not len(arrays):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("doc_id", "salt", "h1", "h2")})
        holder, count = probe(arrays, lines.h1.to_numpy(np.int64), lines.h2.to_numpy(np.int64))
        return lines.loc[(count > 0) & (holder != lines.doc_id.to_numpy(np.int64)), ["doc_id", "salt", "h1", "h2"]]

    lost = asked.groupBy("shard", "copy").cogroup(dealt.groupBy("shard", "copy")).applyInPandas(answer, "doc_id long, salt long, h1 long, h2 long")

    pair = F.unhex(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0")))
    return lost.groupBy("doc_id", "salt").agg(F.array_distinct(F.collect_list(pair)).alias("lost"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, group_probes: int = GROUP_PROBES) -> DataFrame:
    """doc (a struct of all the input's columns), n_lines, n_dropped, kept (the text that stays)."""
    import pyarrow as pa

    scratch = Scratch(docs.sparkSession)
    lost = scratch.keep(decisions(docs, scratch, min_chars, shard_keys, group_probes), "lost")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_key"), salt().alias("_salt"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    joined = own.join(lost.withColumnsRenamed({"doc_id": "_key", "salt": "_salt"}), ["_key", "_salt"], "left").select("doc", F.col("doc.text").alias("_text"), "lost")
    schema = own.select("doc").schema.add("n_lines", "long").add("n_dropped", "long").add("kept", "string")

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            n, gone, kept = [], [], []
            for t, lost in zip(utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
                lines = t.split(b"\n")
                n.append(len(lines))
                if lost:
                    lost = {x[7::-1] + x[:7:-1] for x in lost}
                    stay = [x for x in lines if line_key(x, min_chars) not in lost]
                else:
                    stay = lines
                gone.append(len(lines) - len(stay))
                kept.append((t if len(stay) == len(lines) else b"\n".join(stay)).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc", "n_lines", "n_dropped", "kept"])

    return joined.mapInArrow(run, schema)


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE h.holder <> k.doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY i) FILTER (WHERE h.holder IS NULL OR h.holder = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN h ON k.key = h.key GROUP BY k.doc_id
"""
