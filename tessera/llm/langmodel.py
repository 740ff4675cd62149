"""LM scoring by deleted interpolation of unigrams and bigrams.

P(w | u) = a2[b] c(u,w)/c(u) + a1[b] c(w)/N + a0[b]/(V+1), with one set of weights for each bucket
``b`` of the context's frequency (powers of two).  The weights are learned by expectation
maximisation on the tokens of a tenth of the training documents whose counts are held out of the
estimates meanwhile; scores then use the counts of all training documents.

Distribution: documents are dealt to blocks by a hash of id and text.  A block counts its distinct words and
word pairs, as sorted arrays of hashes (64 and 56 bits), and sends each slice of the hash range as one
compressed row; there are at most ``2**SLICE_BITS`` slices however many blocks there are.  A slice's rows
are added up and each block is answered with the totals in the block's own order, so an answer needs no
keys.  Where more than ``fan`` blocks meet in a slice, teams of ``team`` blocks first add up among
themselves, cut their slice ``team``-fold finer and are blocks in their turn, as often as it takes; the
answers come back the same way.  So rows and bytes grow with the corpus and not with its square, and no
task's share grows.  Then every block scores its documents by itself.  A hot word is one key a block
wherever it occurs, so no key is skewed.

Edge cases: a null or empty text is its end token; without training documents N and V are 0 and
every base probability is 1/1 by the formula; ids that repeat are scored row by row; an empty
table gives an empty result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, crc_mod, shuffle_partitions, utf8

#: Bytes of text in a block.
BLOCK_BYTES, LEAST_BLOCK = 12_000_000, 200_000
#: Most slices of the hash range that a block's counts are cut into (a power of two), most blocks that a slice
#: adds up at once, and blocks (a power of two) that add up among themselves first where there are more.
SLICE_BITS, FAN, TEAM = 10, 2048, 64
#: Training documents whose counts are held out while the weights are learned: one in so many.
FOLD = 10
ROUNDS = 40
#: Bins an octave of the held-out histogram.
OCTAVE = 8

_M = 2**64 - 1
_END, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PAIR_BITS = 56


# --- a block's keys ---------------------------------------------------------------------------


def _pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (u * np.uint64(0xD6E8FEB86659FD93)) ^ ((w << np.uint64(23)) | (w >> np.uint64(41)))
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return (z ^ (z >> np.uint64(29))) & np.uint64((_M << (64 - PAIR_BITS)) & _M)


class Tokens:
    """A block's texts as numbers.  ``word``: local ids of all tokens, each text closed by the end
    token; ``before``: the id of the token before, or of the start; ``uni``: hash by local id."""

    def __init__(self, texts: list[bytes]):
        import xxhash

        local: dict[bytes, int] = defaultdict()
        local.default_factory = local.__len__
        local[None], local[b" "]  # 0: start, 1: end; neither is a word
        parts, self.size = [], np.empty(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            w = t.lower().split()
            self.size[i] = len(w) + 1
            parts.append(np.fromiter(map(local.__getitem__, w), dtype=np.int32, count=len(w)))
            parts.append(np.ones(1, dtype=np.int32))
        self.word = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64) if len(texts) else np.empty(0, np.int64)
        self.before[self.first] = 0
        words = list(local)[2:]
        self.uni = np.concatenate([np.array([_START, _END], dtype=np.uint64), np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), dtype=np.uint64, count=len(words))])
        self.pair, self.pair_of = np.unique(_pair_key(self.uni[self.before], self.uni[self.word]), return_inverse=True)
        self.order = np.argsort(self.uni, kind="stable")

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of ``uni[order]`` and ``pair``; the start counts once a text."""
        t = np.repeat(train, self.size)
        uni = np.bincount(self.word[t], minlength=len(self.uni))
        uni[0] = int(train.sum())
        return uni[self.order], np.bincount(self.pair_of[t], minlength=len(self.pair))


def _pack(a: np.ndarray) -> bytes:
    """Sorted hashes as differences, or counts: bytes of equal weight together, compressed."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"", 1)


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel() if len(raw) else np.empty(0, dtype)


def _diff(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


_KINDS = ("uni", "pair")
_ENTRY = "slice long, unit long, uni binary, uni_n binary, uni_held binary, pair binary, pair_n binary, pair_held binary"
_TOTALS = "slice long, unit long, uni_n binary, uni_held binary, pair_n binary, pair_held binary, v long, n long, n_held long"
_ANSWER = _TOTALS[: _TOTALS.index(", v ")]


def _table(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.strip().split() for x in schema.split(",")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _entries(unit: int, counts: dict, bits: int, first: int, slices: int) -> list[tuple]:
    """A unit's rows of ``slices`` slices from ``first``, a slice being the first ``bits`` of the hash.
    ``counts``: by kind, sorted keys, their counts and those of the held-out fold."""
    edges = np.array([s << (64 - bits) for s in range(first + 1, first + slices)], dtype=np.uint64)
    cuts = {k: [0, *np.searchsorted(counts[k][0], edges).tolist(), len(counts[k][0])] for k in _KINDS}
    rows = []
    for i in range(slices):
        part = [x[cuts[k][i] : cuts[k][i + 1]] for k in _KINDS for x in counts[k]]
        if len(part[0]) or len(part[3]):
            part[0], part[3] = _diff(part[0]), _diff(part[3])
            rows.append((first + i, unit, *map(_pack, part)))
    return rows


def _send(bits: int):
    def send(t):
        tok = Tokens(utf8(t.column("text").combine_chunks()))
        role = np.array(t.column("role").to_pylist())
        uni_n, pair_n = (x.astype(np.uint64) for x in tok.counts(role < 2))
        fold = np.uint64((role == 1).any())
        counts = {"uni": (tok.uni[tok.order], uni_n, uni_n * fold), "pair": (tok.pair, pair_n, pair_n * fold)}
        return _table(_entries(t.column("block")[0].as_py(), counts, bits, 0, 1 << bits), _ENTRY)

    return send


class United:
    """The rows of several units for one slice, added up by key."""

    def __init__(self, t, kind: str):
        keys = [np.cumsum(_unpack(x, "<u8"), dtype=np.uint64) for x in t.column(kind).to_pylist()]
        self.cuts = np.cumsum([len(k) for k in keys])[:-1]
        self.keys, self.at = np.unique(np.concatenate(keys), return_inverse=True)
        self.n, self.held = (self._sum(t.column(f"{kind}_{c}")) for c in ("n", "held"))

    def _sum(self, column) -> np.ndarray:
        # Sums of whole numbers: in doubles only where they stay exact, below 2**53.
        parts = np.concatenate([_unpack(x, "<u8") for x in column.to_pylist()])
        if parts.sum(dtype=np.float64) < 2.0**53:
            return np.bincount(self.at, weights=parts, minlength=len(self.keys)).astype(np.uint64)
        out = np.zeros(len(self.keys), dtype=np.uint64)
        np.add.at(out, self.at, parts)
        return out

    def answers(self, totals: np.ndarray) -> list[bytes]:
        """For each unit the totals of its own keys."""
        return [_pack(x) for x in np.split(totals[self.at], self.cuts)]


def _sum_up(t):
    """A slice's totals, answered unit by unit, and (as unit -1) what the slice adds to V, N and the held-out N."""
    slice_, units = t.column("slice")[0].as_py(), t.column("unit").to_pylist()
    uni, pair = (United(t, k) for k in _KINDS)
    real = uni.keys != _START
    stats = int(((uni.n > 0) & real).sum()), int(uni.n[real].sum()), int(uni.held[real].sum())
    cols = [u.answers(x) for u in (uni, pair) for x in (u.n, u.held)]
    return _table([*((slice_, u, *c, 0, 0, 0) for u, *c in zip(units, *cols, strict=True)), (slice_, -1, *[b""] * 4, *stats)], _TOTALS)


def _merge(bits: int, more: int):
    """A team's rows of one slice as one unit's rows of its finer slices."""

    def merge(t):
        counts = {k: (u.keys, u.n, u.held) for k in _KINDS for u in [United(t, k)]}
        return _table(_entries(t.column("team")[0].as_py(), counts, bits + more, t.column("slice")[0].as_py() << more, 1 << more), _ENTRY)

    return merge


def _spread(t, up):
    """A team's answers of the finer slices, given back to its units."""
    if not t.num_rows:
        return _table([], _ANSWER)
    up = up.sort_by("sub")
    slice_, units = t.column("slice")[0].as_py(), t.column("unit").to_pylist()
    cols = []
    for k in _KINDS:
        u = United(t, k)
        cols += [u.answers(np.concatenate([_unpack(x, "<u8") for x in up.column(f"{k}_{c}").to_pylist()])) for c in ("n", "held")]
    return _table([(slice_, u, *c) for u, *c in zip(units, *cols, strict=True)], _ANSWER)


def _dealt(df: DataFrame, groups: int, *keys: str):
    """Grouped by ``keys``, of which there are about ``groups``: so many tasks at least that each has a few."""
    return df.repartition(max(shuffle_partitions(df.sparkSession), groups), *keys).groupBy(*keys)


def _placed(df: DataFrame, groups: int, key: str):
    """Grouped by ``key``, numbers in a row, which are dealt to the tasks in turn."""
    return df.withColumn(key, F.col(key).cast("int")).repartitionById(max(shuffle_partitions(df.sparkSession), groups), key).groupBy(key)


def corpus_totals(entries: DataFrame, units: int, bits: int, scratch: Scratch, fan: int = FAN, team: int = TEAM) -> tuple[DataFrame, DataFrame]:
    """(slice, unit, totals of its keys), (v, n, n_held in parts), from the rows of ``units`` units."""
    if units <= fan:
        both = scratch.keep((_placed if bits < 31 else _dealt)(entries, (1 << bits) // 4, "slice").applyInArrow(_sum_up, _TOTALS), "totals")
        return both.where("unit >= 0").drop("v", "n", "n_held"), both.where("unit < 0").select("v", "n", "n_held")
    more, teams = team.bit_length() - 1, -(-units // team)
    entries = scratch.keep(entries, "entries").withColumn("team", F.floor(F.col("unit") / team))
    groups = (teams << bits) // 4
    up, stats = corpus_totals(_dealt(entries, groups, "slice", "team").applyInArrow(_merge(bits, more), _ENTRY), teams, bits + more, scratch, fan, team)
    up = up.withColumnsRenamed({"slice": "sub", "unit": "team"}).withColumn("slice", F.shiftright("sub", more))
    spread = _dealt(entries, groups, "slice", "team").cogroup(_dealt(up, groups, "slice", "team")).applyInArrow(_spread, _ANSWER)
    return scratch.keep(spread, "answers"), stats


class Block:
    """A block's tokens with the corpus totals: per token the counts of the pair, its context and its word."""

    def __init__(self, docs, totals):
        self.tok = tok = Tokens(utf8(docs.column("text").combine_chunks()))
        totals = totals.sort_by("slice")
        get = lambda c: np.concatenate([_unpack(x, "<u8") for x in totals.column(c).to_pylist()] or [np.empty(0, np.uint64)]).astype(np.int64)
        uni, uni_fold, self.pair, self.pair_fold = map(get, ("uni_n", "uni_held", "pair_n", "pair_held"))
        self.uni, self.uni_fold = np.empty_like(uni), np.empty_like(uni_fold)
        self.uni[tok.order], self.uni_fold[tok.order] = uni, uni_fold

    def per_token(self, main: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of pair, context, word; ``main``: without the held-out fold."""
        uni = self.uni - self.uni_fold if main else self.uni
        pair = self.pair - self.pair_fold if main else self.pair
        return pair[self.tok.pair_of], uni[self.tok.before], uni[self.tok.word]


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count))."""
    return np.frexp(context.astype(np.float64))[1]


# --- weights ----------------------------------------------------------------------------------


def expectation_maximisation(rows: np.ndarray, p0: float, rounds: int = ROUNDS, least: float = 50.0) -> dict[int, np.ndarray]:
    """Weights (pair, word, floor) by bucket from rows of bucket, ML pair, ML word, occurrences.
    A bucket of fewer than ``least`` tokens uses the weights of all (key -1)."""
    out: dict[int, np.ndarray] = {}
    for b in (-1, *np.unique(rows[:, 0]).astype(int)):
        r = rows if b < 0 else rows[rows[:, 0] == b]
        if b >= 0 and r[:, 3].sum() < least:
            continue
        p = np.stack([r[:, 1], r[:, 2], np.full(len(r), p0)], axis=1)
        a = np.array([0.4, 0.4, 0.2])
        for _ in range(rounds):
            share = p * a
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            a = (share * r[:, 3:]).sum(axis=0)
            a /= a.sum()
        # The floor keeps some mass in every bucket, so no text has probability zero.
        a = np.maximum(a, 1e-6)
        out[b] = a / a.sum()
    return out


def weights_by_bucket(found: dict[int, np.ndarray]) -> np.ndarray:
    """A row of weights for each bucket 0..64; an unseen context has no pair to weigh."""
    rest = found.get(-1, np.array([0.4, 0.4, 0.2]))
    out = np.array([found.get(b, rest) for b in range(65)])
    out[0, 0] = 0.0
    return out / out.sum(axis=1, keepdims=True)


# --- the operator -----------------------------------------------------------------------------


def score_documents(docs: DataFrame, is_held_out: Column | None = None, block_bytes: int = BLOCK_BYTES, slice_bits: int = SLICE_BITS, fan: int = FAN, team: int = TEAM) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    scratch = Scratch(docs.sparkSession)
    held = crc_mod(F.col("doc_id"), 7) == 2 if is_held_out is None else is_held_out
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # A small corpus is dealt to smaller blocks, so that its work is not left to a few tasks.
    blocks = max(1, -(-size // block_bytes), min(shuffle_partitions(docs.sparkSession), size // LEAST_BLOCK))
    folds = max(1, blocks // FOLD)
    bits = min(slice_bits, max(4, (2 * blocks).bit_length()))
    role = F.when(held, 2).when(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLD)) == 0, 1).otherwise(0)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), role.alias("role"))
    h = F.xxhash64("doc_id", "text")
    d = d.withColumn("block", F.when(F.col("role") == 1, F.lit(blocks) + F.pmod(h, F.lit(folds))).otherwise(F.pmod(h, F.lit(blocks))).cast("long"))

    sent = _placed(d, blocks + folds, "block").applyInArrow(_send(bits), _ENTRY)
    answers, stats = corpus_totals(sent, blocks + folds, bits, scratch, fan, team)
    answers = answers.withColumnRenamed("unit", "block")
    v, n, n_fold = map(int, stats.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("v", "n", "n_held")]).first())
    n_main = max(1, n - n_fold)

    def histogram(docs, totals):
        if not docs.num_rows:
            return _table([], "b int, q2 int, q1 int, n long")
        pair, context, word = Block(docs, totals).per_token(main=True)
        log = lambda x, y: np.where(x > 0, np.rint(OCTAVE * np.log2(np.maximum(x, 1) / y)), -(2**20)).astype(np.int64)
        rows = np.stack([bucket(context), log(pair, np.maximum(context, 1)), log(word, n_main)], axis=1)
        found, count = np.unique(rows, axis=0, return_counts=True)
        return _table([(*map(int, r), int(c)) for r, c in zip(found, count, strict=True)], "b int, q2 int, q1 int, n long")

    fold_docs = d.where("role = 1")
    hist = _placed(fold_docs, folds, "block").cogroup(_placed(answers.where(F.col("block") >= blocks), folds, "block")).applyInArrow(histogram, "b int, q2 int, q1 int, n long")
    # Bounded by the bins: buckets by octave bins of two ratios, whatever the corpus.
    seen = np.array([tuple(r) for r in hist.groupBy("b", "q2", "q1").agg(F.sum("n")).collect()], dtype=np.float64).reshape(-1, 4)
    ratio = lambda q: np.where(q > -(2**19), np.exp2(q / OCTAVE), 0.0)
    rows = np.stack([seen[:, 0], ratio(seen[:, 1]), ratio(seen[:, 2]), seen[:, 3]], axis=1)
    weights = weights_by_bucket(expectation_maximisation(rows, 1 / (v + 1)) if len(rows) else {})

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(docs, totals):
        if not docs.num_rows:
            return _table([], out)
        block = Block(docs, totals)
        pair, context, word = block.per_token(main=False)
        a = weights[bucket(context)]
        p = a[:, 0] * pair / np.maximum(context, 1) + a[:, 1] * word / max(n, 1) + a[:, 2] / (v + 1)
        first = block.tok.first
        add = lambda x: np.add.reduceat(x, first).tolist()
        base = add(np.log10((word + 1) / (n + (v + 1))))
        held = [r == 2 for r in docs.column("role").to_pylist()]
        return _table(list(zip(docs.column("doc_id").to_pylist(), held, block.tok.size.tolist(), add((word > 0).astype(np.int64)), repeat(n), base, add(np.log10(p)))), out)  # noqa: B905

    return _placed(d, blocks + folds, "block").cogroup(_placed(answers, blocks + folds, "block")).applyInArrow(score, out)
