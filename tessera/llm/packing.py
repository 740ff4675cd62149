"""Packing by lexical retrieval: a sharded BM25 index fills each seed document's window.

One pass tokenises the documents and counts, over the whole corpus, in how many of them each word
stands (in ``2**BIN_BITS`` bins of the word's hash; words are read off the ids as the tokenizer cuts
them, so "the", "The" and a "the" without a space before it are three words).  A document's leader is its rarest word that at least ``LEADER_DF`` documents hold, so documents that share
rare words, copies above all, have the same leader and come to lie side by side; a leader of more than
``LEADER_DOCS`` documents is dealt to several groups by a hash of the id.  Tasks take whole groups and
cut their sorted rows into shards of about ``shard_ids`` ids, several a task.

A shard is an inverted index (postings with BM25 weights under the corpus-wide document frequencies
and mean length), and a greedy walk lays its documents end to end.  The document at a window's start is
its seed; when a document ends inside the window, the unused neighbour of the seed with the highest
BM25 score follows it, cut at the window's end, and the cut document seeds the next window.  When no
unused document shares a scoring word, the next unused one follows.  So every window but a shard's
last is full; the last is cut into powers of two, which need no padding.

A task holds one shard at a time, and the number of tasks grows with the ids, not with the shards.

Edge cases: a null or empty text is its end token alone; the string of an added token in a text is that
token, as the tokenizers library has it; rows that repeat an id are packed row by row; the empty table
gives an empty result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, shuffle_partitions

WINDOW, END_ID = 2048, 1
#: Ids of a shard, and ids that a task is meant to pack.
SHARD_IDS, TASK_IDS = 1_000_000, 16_000_000
#: BM25's usual constants.
K1, B = 1.2, 0.75
#: Ids whose words are read off at a time.
SLICE_IDS = 1 << 18
#: Bins of word hashes whose documents are counted.
BIN_BITS = 20
#: Parts in which the bins are added up, and documents that are encoded at a time.
SLOTS, ENCODE_ROWS = 64, 1000
#: Added to the documents of a bin that holds too few for a leader, so that it comes after all others.
LATER = 1 << 39
#: Least documents of a leader, and documents of one group of a leader.
LEADER_DF, LEADER_DOCS = 256, 1000

#: The GPT-2 split pattern (fixed), with possessive runs: the same pieces, found faster.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODED = "doc_id long, ids binary, task int, slot int, counts binary"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes stand for themselves, the
    others, in order, for the code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    with np.errstate(over="ignore"):
        z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Encoder:
    """The ids that the tokenizers library gives for the file, added tokens included, and the words that
    stand in them: a word is a run of ids of letters and digits that no space breaks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        symbol = byte_symbols()
        ranks = {bytes(symbol[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in added}
        size = max([*ranks.values(), *added.values()]) + 1
        if size > 1 << 16:
            raise ValueError("ids of 16 bits are packed")
        self.added = set(added)
        core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self._encode = core._core_bpe.encode_to_tiktoken_buffer
        self.is_word, self.opens = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for t, i in ranks.items():
            self.is_word[i] = any(c >= 0x80 or chr(c).isalnum() for c in t)
            self.opens[i] = t[:1].isspace()
        with np.errstate(over="ignore"):
            self.value = np.where(self.is_word, _mixed(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))
            self.power = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, dtype=np.uint64))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self._encode(text, self.added), dtype="<u4").astype("<u2")

    def words(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of documents laid end to end, which start at ``first``, and how many each has.
        A word's hash sums its ids' values times a power of their place; other ids have value 0."""
        word = self.is_word[ids]
        new = self.opens[ids]
        new[1:] |= ~word[:-1]
        new[first] = True
        new &= word
        start = np.flatnonzero(new)
        bounds = np.searchsorted(start, first)
        n = np.diff(bounds, append=len(start))
        if not len(start):
            return np.empty(0, np.uint64), n
        place = np.arange(len(ids), dtype=np.int32)
        place[: start[0]] = 0
        place[start[0] :] -= np.repeat(start.astype(np.int32), np.diff(start, append=len(ids)))
        place &= 63
        with np.errstate(over="ignore"):
            return _mixed(np.add.reduceat(self.value[ids] * self.power[place], start)), n

    def words_of(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any documents, some at a time, so that the arrays on the way stay small."""
        size = np.array([len(x) for x in ids], dtype=np.int64)
        cuts = np.searchsorted(np.cumsum(size), np.arange(SLICE_IDS, int(size.sum()), SLICE_IDS), side="right")
        hashes, counts = [], []
        for lo, hi in pairwise(np.unique([0, *cuts, len(ids)]).tolist()):
            h, n = self.words(np.concatenate(ids[lo:hi]), np.cumsum(size[lo:hi]) - size[lo:hi])
            hashes.append(h)
            counts.append(n)
        return np.concatenate(hashes or [np.empty(0, np.uint64)]), np.concatenate(counts or [np.empty(0, np.int64)])


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """A worker's encoder, kept from task to task."""
    return Encoder(path)


def bins_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def _packed(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(a.astype("<i8").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), "<i8")


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """A row (doc_id, ids) a document, and a row a task and slot: in how many of the task's documents the words
    of each of the slot's bins stand.  The last slot has the numbers of documents and words."""
    import pyarrow as pa
    from pyspark import TaskContext

    def batch(who, ids, task, slot, counts):
        return pa.RecordBatch.from_arrays([who, pa.array(ids, pa.binary()), pa.array(task, pa.int32()), pa.array(slot, pa.int32()), pa.array(counts, pa.binary())], ["doc_id", "ids", "task", "slot", "counts"])

    def run(batches: Iterator) -> Iterator:
        encoder, task = worker_encoder(path), TaskContext.get().partitionId()
        end, count, n_docs, n_words = np.array([end_id], dtype="<u2"), np.zeros(1 << BIN_BITS, dtype=np.int64), 0, 0
        for b in batches:
            for at in range(0, b.num_rows, ENCODE_ROWS):
                part = b.slice(at, ENCODE_ROWS)
                ids = [np.concatenate([encoder.ids(t or ""), end]) for t in part.column(1).to_pylist()]
                words, n = encoder.words_of(ids)
                for x in np.split(bins_of(words), np.cumsum(n)[:-1]):
                    count[x] += 1  # once a document: numpy adds to a repeated place only once
                n_docs, n_words = n_docs + len(n), n_words + len(words)
                none = [None] * len(ids)
                yield batch(part.column(0), [x.tobytes() for x in ids], none, none, none)
        slots = [*np.split(count, SLOTS), np.array([n_docs, n_words])]
        yield batch(pa.nulls(len(slots), pa.int64()), [None] * len(slots), [task] * len(slots), range(len(slots)), list(map(_packed, slots)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ENCODED)


class Corpus:
    """What the packing knows of all documents: how many hold each bin of words, how many there are, and
    their mean length.  Bounded by the bins."""

    def __init__(self, df: np.ndarray, n_docs: int, mean: float):
        self.df, self.n_docs, self.mean = df, n_docs, mean
        self.idf = np.where(df > 1, np.maximum(0.0, np.log((n_docs - df + 0.5) / (df + 0.5))), 0.0)

    def __reduce__(self):  # small in a task's closure
        return _corpus, (_packed(self.df), self.n_docs, self.mean)

    @classmethod
    def of(cls, encoded: DataFrame) -> Corpus:
        import pyarrow as pa

        def add_up(t):
            total = sum(map(_unpacked, t.column("counts").to_pylist()))
            return pa.table({"slot": t.column("slot")[:1], "task": pa.array([0], pa.int32()), "counts": pa.array([_packed(total)], pa.binary())})

        rows, schema = encoded.where("slot is not null").select("slot", "task", "counts"), "slot int, task int, counts binary"
        rows = rows.groupBy("slot", F.pmod("task", F.lit(256))).applyInArrow(add_up, schema).groupBy("slot").applyInArrow(add_up, schema)
        found = {r.slot: _unpacked(r.counts) for r in rows.collect()}  # a row a slot
        n, words = found.get(SLOTS, (0, 0))
        return cls(np.concatenate([found[i] for i in range(SLOTS)]) if found else np.zeros(1 << BIN_BITS, dtype=np.int64), int(n), float(words / n) if n else 0.0)


@lru_cache(maxsize=2)
def _corpus(packed: bytes, n_docs: int, mean: float) -> Corpus:
    return Corpus(_unpacked(packed), n_docs, mean)


def leaders(bins: np.ndarray, n: np.ndarray, df: np.ndarray, least: int = LEADER_DF, places: int = 2) -> np.ndarray:
    """For each document the ``places`` rarest bins of its words that at least ``least`` documents hold (or
    two, where no word has so many), rarest first, as (documents of the bin << BIN_BITS) + bin; -1 where
    there is none.  A row a place."""
    out = np.full((places, len(n)), -1, dtype=np.int64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    first = (np.cumsum(n) - n)[some]
    far, none = np.int64(2**62), np.int64(2**40)
    d = df[bins]
    key = np.where(d >= least, d, np.where(d >= 2, d + LATER, none)) << BIN_BITS | bins
    for k in range(places):
        low = np.minimum.reduceat(key, first)
        found = low < none << BIN_BITS
        out[k, some[found]] = low[found]
        key = np.where(key == np.repeat(low, n[some]), far, key)
    return out


class Index:
    """BM25 over a shard's documents under the corpus's statistics.  A word in half of all documents or
    more, or in one alone, scores nothing.  A posting is found by the first 44 bits of its word's hash."""

    def __init__(self, words: np.ndarray, n: np.ndarray, corpus: Corpus):
        self.n = len(n)
        bits = np.uint64(max(20, self.n.bit_length()))
        key = (words >> bits << bits) | np.repeat(np.arange(self.n, dtype=np.uint64), n)
        key.sort()
        new = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        tf, key = np.diff(new, append=len(key)), key[new]
        word = key >> bits
        first = np.flatnonzero(np.diff(word, prepend=~word[:1]))
        held = np.diff(first, append=len(word))
        idf = np.where(held > 1, corpus.idf[bins_of(key[first])], 0.0)
        keep = idf > 0
        rows = np.repeat(keep, held)
        idf, held = idf[keep], held[keep]
        self.doc = (key[rows] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        tf = tf[rows]
        norm = K1 * (1 - B + B * n / max(corpus.mean, 1.0))
        self.weight = np.repeat(idf, held) * tf * (K1 + 1) / (tf + norm[self.doc])
        self.start = np.concatenate([[0], np.cumsum(held)])
        # The words of each document: the postings again, by document.
        narrow = self.doc.astype(np.uint16) if self.n <= 1 << 16 else self.doc
        self.term = np.repeat(np.arange(len(held)), held)[np.argsort(narrow, kind="stable")]
        self.own = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=self.n))])

    def scores(self, seed: int) -> np.ndarray:
        q = self.term[self.own[seed] : self.own[seed + 1]]
        if not len(q):
            return np.zeros(self.n)
        lo, size = self.start[q], self.start[q + 1] - self.start[q]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def order_documents(index: Index, lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The order in which the greedy walk lays a shard's documents."""
    n = index.n
    used, out = np.zeros(n, dtype=bool), np.empty(n, dtype=np.int64)
    at, next_, seed, scores = 0, 0, 0, None
    for i in range(n):
        best = -1
        if at % window and i:
            if scores is None:
                scores = index.scores(seed)
                scores[used] = 0.0
            best = int(scores.argmax()) if scores.any() else -1
        if best < 0:
            while used[next_]:
                next_ += 1
            best = next_
        used[best] = True
        out[i] = best
        before, at = at, at + int(lengths[best])
        if before % window == 0 or before // window != at // window:  # it stands at a window's start
            seed, scores = best, None
        elif scores is not None:
            scores[best] = 0.0
    return out


def cut_points(total: int, window: int = WINDOW) -> np.ndarray:
    """Ends of the sequences: full windows, then the rest by falling powers of two."""
    ends = list(range(window, total + 1, window))
    at = ends[-1] if ends else 0
    for bit in range(window.bit_length() - 2, -1, -1):
        if (total - at) >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return np.array(ends, dtype=np.int64)


def pack_shard(ids: list[np.ndarray], encoder: Encoder, corpus: Corpus, window: int = WINDOW) -> list[tuple[int, int, int, int, int, int, int]]:
    """(place of the document, start, length, crc32, its ids, sequence, offset) per piece."""
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    words, n = encoder.words_of(ids)
    order = order_documents(Index(words, n, corpus), lengths, window)
    first = np.concatenate([[0], np.cumsum(lengths[order])])
    ends = cut_points(int(first[-1]), window)
    begins = np.concatenate([[0], ends[:-1]])
    out = []
    for place, at in zip(order.tolist(), first.tolist(), strict=False):
        data, n = ids[place].astype("<u4"), int(lengths[place])
        start, seq = 0, int(np.searchsorted(ends, at, side="right"))
        while start < n:
            size = min(n - start, int(ends[seq]) - at - start)
            out.append((place, start, size, zlib.crc32(data[start : start + size].tobytes()), n, seq, at + start - int(begins[seq])))
            start, seq = start + size, seq + 1
    return out


def grouped(encoded: DataFrame, path: str, corpus: Corpus, leader_df: int = LEADER_DF, leader_docs: int = LEADER_DOCS) -> DataFrame:
    """doc_id, ids, lead, part, next: the leader, the leader's group and the second leader."""
    import pyarrow as pa

    schema = "doc_id long, ids binary, lead long, part long, next long"

    def run(batches: Iterator) -> Iterator:
        encoder = worker_encoder(path)
        for b in batches:
            if not b.num_rows:
                continue
            words, n = encoder.words_of([np.frombuffer(x, "<u2") for x in b.column(1).to_pylist()])
            lead, second = leaders(bins_of(words), n, corpus.df, leader_df)
            held = np.where(lead < 0, corpus.n_docs, (lead >> BIN_BITS) & (LATER - 1))
            groups = -(-held // leader_docs)
            salt = np.array([zlib.crc32(x, (i or 0) & 0xFFFFFFFF) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], dtype=np.uint64)
            part = (_mixed(salt + np.uint64(0x9E3779B97F4A7C15)) % np.maximum(groups, 1).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lead), pa.array(part), pa.array(second)], ["doc_id", "ids", "lead", "part", "next"])

    return encoded.where("slot is null").select("doc_id", "ids").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    import pyarrow as pa
    from pyspark import TaskContext

    path = path or tokenizer_path()
    scratch = Scratch(docs.sparkSession)
    encoded = scratch.keep(encode(docs, path, end_id), "ids")
    corpus = Corpus.of(encoded)
    total = encoded.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0] // 2
    tasks = max(shuffle_partitions(docs.sparkSession), -(-total // TASK_IDS))
    d = grouped(encoded, path, corpus).repartition(tasks, "lead", "part").sortWithinPartitions("lead", "part", "next", "doc_id", "ids")
    names = [f.split()[0] for f in _PIECE.split(", ")]

    def run(batches: Iterator) -> Iterator:
        encoder, base = worker_encoder(path), TaskContext.get().partitionId() << 40
        who, ids, size = [], [], 0

        def flush():
            cols = np.array(pack_shard(ids, encoder, corpus, window), dtype=np.int64).reshape(-1, 7).T
            owner = [who[i] for i in cols[0].tolist()]
            return int(cols[5].max()) + 1, pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), *map(pa.array, (cols[1], cols[2], cols[3], cols[4], cols[5] + base, cols[6]))], names)

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                who.append(i)
                ids.append(np.frombuffer(x, "<u2"))
                size += len(ids[-1])
                if size >= shard_ids:
                    top, out = flush()
                    yield out
                    base, who, ids, size = base + top, [], [], 0
        if who:
            yield flush()[1]

    return d.select("doc_id", "ids").mapInArrow(run, _PIECE)
