"""Benchmark decontamination by suffix arrays of the training text.

Words are runs of letters and digits (all but the ASCII characters outside 0-9A-Za-z), A-Z lower-cased.
A benchmark item's windows are its runs of ``window`` consecutive words, or the whole item if it
is shorter.  Documents stay where they are: a task cuts the words of its documents into shards of
``shard_words`` positions (each with as many words after them as the longest item has), sorts each
shard's suffixes into a suffix array by doubling, and looks every suffix of every item up in it by
binary search.  The run of entries that begin with a window gives all its places; the neighbours of a
suffix's own place give its longest verbatim match.  Suffixes that begin with a word no item has
can match nothing and are left out of the array.

The benchmark goes to the tasks in chunks of at most about ``chunk_bytes`` of text, measured
first; a task holds one chunk at a time, and nothing is shuffled.

Edge cases: null and wordless texts have no words, items without words have no windows; rows that
share an item_id are one item, and a null item_id is named by the empty text; repeated documents are each
judged alike; documents of any length are cut into shards; an empty table on either side gives
no hits; columns beside ``doc_id`` and ``text`` travel in a struct, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import utf8

WINDOW = 10
#: Suffixes of one array, and bytes of benchmark text that go to the tasks at once.
SHARD_WORDS = 1 << 19
CHUNK_BYTES = 4_000_000
#: Bytes of a text that are split into words at once.
SLICE_BYTES = 1 << 20
#: Stands for a null doc_id, after all others.
NO_ID = 2**63 - 1
#: Word bytes stay, A-Z lower-cased; the other ASCII characters become spaces.
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def split_words(text: bytes) -> Iterator[list[bytes]]:
    """A text's words, a slice of it at a time."""
    text = text.translate(_BYTES)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


# --- suffix arrays ----------------------------------------------------------------------------


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` ordered by the words that follow, to ``depth`` words.  0 ends a suffix: what stands
    behind it does not count.  Doubling from as many words as fit 62 bits; only suffixes that are still
    tied are sorted again."""
    if not len(starts):
        return starts
    bits = max(1, int(words.max()).bit_length())
    k = min(depth, max(1, 62 // bits))
    padded = np.concatenate([words, np.zeros(k, words.dtype)]).astype(np.int64)
    key, open_ = np.zeros(len(words), np.int64), np.ones(len(words), bool)
    for j in range(k):
        w = padded[j : j + len(words)]
        open_ &= w > 0
        key = (key << bits) | np.where(open_, w, 0)
    order = starts[np.argsort(key[starts], kind="stable")]
    sorted_ = key[order]
    group = np.zeros(len(words) + 1, np.int64)  # of each start: 1 + place of the first that equals it; 0 ends
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    size = np.diff(np.append(first, len(order)))
    group[order] = np.repeat(first + 1, size)
    ends = ~open_  # the suffix ended within the words compared
    while k < depth:
        at = np.flatnonzero(np.repeat(size > 1, size))
        at = at[~ends[order[at]]]
        if not len(at):
            break
        s = order[at]
        after = group[np.minimum(s + k, len(words))]
        own = group[s]
        by = np.lexsort((after, own))
        order[at] = s[by]
        own, after = own[by], after[by]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])])
        heads = np.flatnonzero(new)
        group[order[at]] = np.repeat(at[heads] + 1, np.diff(np.append(heads, len(at))))
        ends[order[at]] |= after == 0
        g = group[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.append(first, len(order)))
        k *= 2
    return order


def _before(words: np.ndarray, at: np.ndarray, tests: np.ndarray, starts: np.ndarray, lengths: np.ndarray, or_prefix: bool) -> np.ndarray:
    """Whether the suffix at ``at`` stands before the test suffix, or begins with it if ``or_prefix``."""
    out = np.full(len(at), or_prefix)
    live = np.arange(len(at))
    j = 0
    while len(live):
        live = live[lengths[live] > j]
        a, b = words[at[live] + j], tests[starts[live] + j]
        differ = a != b
        out[live[differ]] = a[differ] < b[differ]
        live = live[~differ]
        j += 1
    return out


def search(words: np.ndarray, order: np.ndarray, tests: np.ndarray, starts: np.ndarray, lengths: np.ndarray, right: bool = False) -> np.ndarray:
    """Place of each test suffix in the array by binary search: the first that is not before it, or,
    with ``right``, the first behind those that begin with it.  ``words`` ends with a 0 a test word never equals."""
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        less = _before(words, order[mid], tests, starts[live], lengths[live], right)
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)
        live = live[lo[live] < hi[live]]
    return lo


def common_words(words: np.ndarray, at: np.ndarray, tests: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Words that the suffix at ``at`` (-1: none) and the test suffix have in common."""
    out = np.zeros(len(at), np.int64)
    live = np.flatnonzero(at >= 0)
    j = 0
    while len(live):
        live = live[lengths[live] > j]
        live = live[words[at[live] + j] == tests[starts[live] + j]]
        j += 1
        out[live] = j
    return out


class Benchmark:
    """A chunk of items: word codes, every item's suffixes, the distinct windows and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.codes: dict[bytes, int] = {}
        self.names: list[str] = []
        tests, sizes = [], []
        for name, text in items:
            own = [self.codes.setdefault(w, len(self.codes) + 1) for part in split_words(text) for w in part]
            if own:
                tests.append(np.array([*own, 0], np.int32))
                sizes.append(len(own))
                self.names.append(name)
        size = np.array(sizes, np.int64)
        begin = np.cumsum(size + 1) - size - 1
        self.tests = np.concatenate([np.zeros(0, np.int32), *tests])
        self.owner = np.repeat(np.arange(len(size)), size)
        self.offset = np.arange(len(self.owner)) - np.repeat(np.cumsum(size) - size, size)
        self.starts, self.lengths = begin[self.owner] + self.offset, size[self.owner] - self.offset
        self.least = np.minimum(window, size)[self.owner]  # of each suffix: words of its item's windows
        self.longest = int(size.max()) if len(size) else 0
        at, n, who = [], [], []
        full = self.lengths >= self.least
        for w in np.unique(self.least).tolist():
            own = np.flatnonzero(full & (self.least == w))
            rows = np.lib.stride_tricks.sliding_window_view(self.tests, w)[self.starts[own]]
            _, first, which = np.unique(np.ascontiguousarray(rows).view(f"V{rows.dtype.itemsize * w}").ravel(), return_index=True, return_inverse=True)
            pair = np.unique(which * len(size) + self.owner[own])
            who += np.split(pair % len(size), np.flatnonzero(np.diff(pair // len(size))) + 1)
            at.append(self.starts[own][first])
            n.append(np.full(len(first), w))
        self.window_at, self.window_len = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (at, n))
        self.item_ends = np.cumsum([len(x) for x in who])
        self.item_codes = np.concatenate([np.zeros(0, np.int64), *who]).astype(np.int32)

    def items_of(self, window: int) -> list[int]:
        return self.item_codes[self.item_ends[window - 1] if window else 0 : self.item_ends[window]].tolist()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words, 0 for words of no item and behind every text; where each text begins."""
        get, zero = self.codes.get, np.zeros(1, np.int32)
        parts, begin, at = [], [], 0
        for t in texts:
            begin.append(at)
            for words in split_words(t):
                parts.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
                at += len(words)
            parts.append(zero)
            at += 1
        return np.concatenate([zero[:0], *parts]), np.array([*begin, at], np.int64)

    def shards(self, words: np.ndarray, shard_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(offset, words, suffix array) of each shard of the encoded texts."""
        for lo in range(0, len(words), shard_words):
            own = words[lo : lo + shard_words]
            part = np.concatenate([words[lo : lo + shard_words + self.longest], np.zeros(self.longest + 1, np.int32)])
            order = suffix_array(part, np.flatnonzero(part), self.longest)
            yield lo, part, order[order < len(own)]

    def occurrences(self, words: np.ndarray, shard_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position) of all places of all windows, a shard at a time."""
        for lo, part, order in self.shards(words, shard_words):
            a = search(part, order, self.tests, self.window_at, self.window_len)
            b = search(part, order, self.tests, self.window_at, self.window_len, right=True)
            n = b - a
            which = np.repeat(np.arange(len(n)), n)
            yield which, order[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)] + lo


def chunks(benchmark: DataFrame, window: int, chunk_bytes: int) -> list:
    """Broadcast chunks of the benchmark, each of at most about ``chunk_bytes`` of text, measured first."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // chunk_bytes))
    part = F.pmod(F.xxhash64("name", "text"), F.lit(n))
    return [sc.broadcast(Benchmark([(r[0], r[1].encode()) for r in items.where(part == i).distinct().toLocalIterator()], window)) for i in range(n)]


def held(chunk, of: int) -> Benchmark:
    """A chunk in a task; of several, one at a time is in memory."""
    return chunk.value if of == 1 else chunk.load_from_path(chunk._path)


# --- operators --------------------------------------------------------------------------------


def _marks(b: Benchmark, texts: list[bytes], shard_words: int) -> list[tuple[int, list[int], list[str]]]:
    """Of each text: its number of words, its hit words as runs (start, end, start, end, ...), its items."""
    words, begin = b.encode(texts)
    edge = np.zeros(len(words) + 1, np.int64)
    windows = len(b.window_at)
    pairs = [np.zeros(0, np.int64)]
    for which, at in b.occurrences(words, shard_words):
        edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + b.window_len[which], minlength=len(edge))
        pairs.append(np.unique((np.searchsorted(begin, at, "right") - 1) * windows + which))
    turns = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(edge) > 0]).astype(np.int8)))
    items: list[set] = [set() for _ in texts]
    for d, w in zip(*np.divmod(np.unique(np.concatenate(pairs)), max(1, windows)), strict=True):
        items[d].update(b.items_of(w))
    cut = np.searchsorted(turns, begin)
    return [(int(begin[i + 1] - begin[i] - 1), (turns[cut[i] : cut[i + 1]] - begin[i]).tolist(), [b.names[k] for k in s]) for i, s in enumerate(items)]


def _union(a: list[int], b: list[int]) -> list[int]:
    """Union of two lists of sorted runs."""
    out: list[int] = []
    for lo, hi in sorted(zip([*a[::2], *b[::2]], [*a[1::2], *b[1::2]], strict=True)):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc (a struct of all the input's columns), n_words, hits (runs of hit words: start, end, start, ...),
    items (ids as sorted strings)."""
    import pyarrow as pa

    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    parts = chunks(benchmark, window, chunk_bytes)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            doc = batch.column(0)
            texts = utf8(doc.field("text"))
            hits: list[list] = [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            for chunk in parts:
                b = held(chunk, len(parts))
                found = [x for sl in _slices(texts, shard_words) for x in _marks(b, texts[sl], shard_words)]
                n = [k for k, _, _ in found]
                hits = [_union(x, y) if x else y for x, (_, y, _) in zip(hits, found, strict=True)]
                for mine, (_, _, names) in zip(items, found, strict=True):
                    mine.update(names)
            yield pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["doc", "n_words", "hits", "items"])

    schema = own.select("doc").schema.add("n_words", "long").add("hits", T.ArrayType(T.LongType())).add("items", T.ArrayType(T.StringType()))
    return own.mapInArrow(run, schema)


def _slices(texts: list[bytes], shard_words: int) -> Iterator[slice]:
    """Runs of whole texts of about a shard each; a longer text is a run of its own."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > 6 * shard_words:
            yield slice(lo, i)
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield slice(lo, len(texts))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without those that hold a window, with all their columns."""
    return mark(docs, benchmark, **options).where(F.size("hits") == 0).select("doc.*")


def report(marked: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of ``mark``'s rows."""
    n_hit = F.aggregate("hits", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("int").alias("sign")), lambda a, x: F.struct((a["sum"] + a["sign"] * x).alias("sum"), (-a["sign"]).alias("sign")), lambda a: a["sum"])
    return marked.select(F.col("doc.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, shard_words: int = SHARD_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """item_id (as text), item_start, length, doc_id, doc_start (in words): for every item and
    suffix of it, the longest match of at least ``least`` words (or its whole short item) with its first place by
    (doc_id, doc_start), null ids last.  The neighbours of a suffix's place in each shard's array give the shard's longest;
    the shards meet in one grouping."""
    import pyarrow as pa

    kind = "item_id string, item_start long, length long, doc_id long, doc_start long"
    parts = chunks(benchmark, least, chunk_bytes)

    def rows(b: Benchmark, ids: np.ndarray, texts: list[bytes]) -> Iterator[tuple]:
        words, begin = b.encode(texts)
        for lo, part, order in b.shards(words, shard_words):
            at = search(part, order, b.tests, b.starts, b.lengths)
            best = np.zeros(len(at), np.int64)
            for near in (at - 1, at):
                there = (near >= 0) & (near < len(order))
                place = np.full(len(at), -1)
                place[there] = order[near[there]]
                best = np.maximum(best, common_words(part, place, b.tests, b.starts, b.lengths))
            own = np.flatnonzero(best >= b.least)
            a, z = (search(part, order, b.tests, b.starts[own], best[own], right=r) for r in (False, True))
            for k, i, j in zip(own.tolist(), a.tolist(), z.tolist(), strict=True):
                places = order[i:j] + lo
                doc = np.searchsorted(begin, places, "right") - 1
                first = np.lexsort((places, ids[doc]))[0]
                yield b.names[b.owner[k]], int(b.offset[k]), int(best[k]), int(ids[doc[first]]), int(places[first] - begin[doc[first]])

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), utf8(batch.column(1))
            for chunk in parts:
                found = [x for sl in _slices(texts, shard_words) for x in rows(held(chunk, len(parts)), ids[sl], texts[sl])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["item_id", "item_start", "length", "doc_id", "doc_start"])

    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    best = given.mapInArrow(run, kind).groupBy("item_id", "item_start").agg(F.min(F.struct(-F.col("length"), "doc_id", "doc_start")).alias("m"))
    return best.select("item_id", "item_start", (-F.col("m.col1")).alias("length"), F.when(F.col("m.doc_id") != NO_ID, F.col("m.doc_id")).alias("doc_id"), "m.doc_start")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS gram FROM s),
p AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k),
o AS (SELECT doc_id, i, p.k, item_id FROM p JOIN g ON p.k = g.k AND array_to_string(p.w[i : i + p.k - 1], ' ') = g.gram),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM o)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
