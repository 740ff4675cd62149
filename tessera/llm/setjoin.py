"""SimHash near-duplicates at a likeness of 4/5, confirmed on the shingle sets.

At a Jaccard likeness of 4/5 two fingerprints of 64 bits differ in about ten bits, which is beyond what a trie
can prune, so SimHash alone cannot give these links.  Here the fingerprints' trie (``simhash``) finds the
close texts, a prefix filter finds the rest, and every link is confirmed: a text's set holds the XXH64 (seed
42) of its shingles of ``SHINGLE`` words, lowered as in op 1, and two sets are linked when their Jaccard
likeness is at least 4/5.

Under any one order of the hashes two such sets share one of their first ``n // 5 + 1`` hashes, so only texts
that meet in a prefix are compared.  The order puts hashes that are frequent in a sample of the texts last;
the sample decides how many texts meet, never which are linked.  Links are found in rounds, each between
texts of different components so far: those of the trie, chains of the texts that meet in a hash, each
text with the ``WINDOW`` texts before and behind it in each hash it meets others in, and the rest.  A hash lists its texts by their
fingerprints, turned by a number of bits that differs from hash to hash, so alike texts stand together.  So each of the
first rounds has at most so many pairs a text and hash, and a large group costs its size, not its square.

The rest are texts of different components that meet only in hashes of more than ``WINDOW + 1`` texts.  They are
compared in blocks of ``BLOCK`` texts inside a task, by their odd sketches: 1,024 bits, each the parity
of the hashes that fall on it, so two sets differ in at least as many hashes as their sketches do in bits.  Only pairs
whose sketches leave room for a likeness of 4/5 leave the task, to be confirmed; texts of one component by then,
as those of a large group of copies are, are not compared.

So all links count, on 40 bits of the hashes: components are those of the complete join.

Edge cases: null, empty and blank texts have the empty set and are linked to each other; a text of
fewer words than a shingle is one shingle; ids must be unique and not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, bounded_broadcast, shuffle_partitions, utf8
from tessera.llm.simhash import components, gram_hashes, majority, trie_links

SHINGLE = 5
#: Texts whose hashes are counted for the order, and hashes that it may put last.
SAMPLE_ROWS, MAX_FREQUENT = 10_000, 200_000
#: The round of chains links texts that meet in the first places of their prefixes, up to this one.
CHAIN = 3
#: Texts on either side that a text is compared with in a hash.
WINDOW = 8
#: Texts of a hash that a task compares with each other in the last round, and pairs it holds at once.
BLOCK, PAIRS_HELD = 4096, 1 << 18
#: Bits of an odd sketch.
SKETCH = 1024


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(gram_hashes(text, shingle))


def thin(hashes: np.ndarray) -> bytes:
    """The first 40 bits of sorted hashes, 5 bytes each: two sets of 1,000 shingles hold a chance match once in a million."""
    return np.ascontiguousarray(np.unique(hashes >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def odd_sketch(hashes: np.ndarray) -> bytes:
    """Parities of the numbers of hashes that fall on each bit."""
    fallen = np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    return np.packbits((fallen & 1).astype(np.uint8)).tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard likeness of at least 4/5, in whole numbers."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 9 * both >= 4 * (len(a) + len(b))


def frequent_hashes(docs: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that several texts of a sample hold, sorted, and in how many."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            h, c = np.unique(np.concatenate([np.empty(0, np.uint64), *(shingles(t, shingle) for t in utf8(b.column(0)))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "n"])

    share = min(1.0, SAMPLE_ROWS / max(1, n))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = sample.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 3")
    rows = found.orderBy(F.desc("n"), "h").limit(MAX_FREQUENT).toPandas()
    h = rows.h.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows.n.to_numpy(np.int64)[order]


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], shingle: int) -> DataFrame:
    """doc_id, key: digest of the set, n: its size, fp: the fingerprint, prefix: its first n // 5 + 1 hashes."""
    import pyarrow as pa

    known, times = frequent

    def run(batches: Iterator) -> Iterator:
        import xxhash

        for b in batches:
            keys, sizes, first, fps = [], [], [], []
            for t in utf8(b.column(1)):
                grams = gram_hashes(t, shingle)
                fps.append(majority(grams))
                s = np.unique(grams)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, times[at], 0), kind="stable")]
                first.append(s[: len(s) // 5 + 1].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in first])]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *first])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), lists], ["doc_id", "key", "n", "fp", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key binary, n long, fp long, prefix array<long>")


def _by_hash(rows: DataFrame, emit, schema: str) -> DataFrame:
    """``emit`` gets the columns of all rows of some hashes, sorted by hash, turned fingerprint and id."""
    import pyarrow as pa

    names = rows.columns

    def run(batches: Iterator) -> Iterator:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        c = {k: t.column(k).to_numpy() for k in names}
        turn = (c["h"].view(np.uint64) >> np.uint64(3)) % np.uint64(64)
        fp = c["fp"].view(np.uint64)
        turned = (fp << turn) | (fp >> ((np.uint64(64) - turn) % np.uint64(64)))
        order = np.lexsort((c["id"], turned, c["h"]))
        yield emit({k: v[order] for k, v in c.items()})

    return rows.repartition(max(2, shuffle_partitions(rows.sparkSession)), "h").mapInArrow(run, schema)


_MEETING = "h long, id long, n long, pos long, fp long, crowd long"
_PAIRS = "a long, b long, met long, crowd long, sizes long, rest long"


def _meeting(c: dict, window: int):
    """Rows of hashes that at least two texts hold; crowd: whether they are more than all compared with each other."""
    import pyarrow as pa

    edges = np.concatenate([[0], np.flatnonzero(np.diff(c["h"])) + 1, [len(c["h"])]])
    size = np.repeat(np.diff(edges), np.diff(edges))
    c["crowd"] = (size > window + 1).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(c[k][size > 1]) for k in ("h", "id", "n", "pos", "fp", "crowd")], ["h", "id", "n", "pos", "fp", "crowd"])


def _near(c: dict, step: int) -> np.ndarray:
    """Rows that the row ``step`` places on may be linked with: of the same hash, of another component, and with
    sizes and places of the shared hash that leave room for a likeness of 4/5."""
    i = np.flatnonzero((c["h"][step:] == c["h"][:-step]) & (c["root"][step:] != c["root"][:-step]))
    n, m, p, q = c["n"][i], c["n"][i + step], c["pos"][i], c["pos"][i + step]
    return i[9 * (np.minimum(p, q) + np.minimum(n - p, m - q)) >= 4 * (n + m)]


def _pairs(c: dict, window: int):
    """Pairs of ids, in how many small hashes they meet, and what else bounds their common hashes: the large ones
    of the prefix with fewer, and those behind the prefix that ends first."""
    import pyarrow as pa

    i = [_near(c, s) for s in range(1, window + 1)]
    j = np.concatenate([x + s for s, x in enumerate(i, 1)])
    i = np.concatenate(i)
    x, y = c["id"][i], c["id"][j]
    pairs, at, back = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0, return_index=True, return_inverse=True)
    met = np.bincount(back.ravel(), weights=1 - c["crowd"][i], minlength=len(pairs)).astype(np.int64)
    i, j = i[at], j[at]
    n, m = c["n"][i], c["n"][j]
    cols = [*np.ascontiguousarray(pairs.T), met, np.minimum(c["crowds"][i], c["crowds"][j]), n + m, np.maximum(n - n // 5, m - m // 5) - 1]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in cols], [f.split()[0] for f in _PAIRS.split(", ")])


def _rest_pairs(crowded: DataFrame, sketches: DataFrame, block: int) -> DataFrame:
    """Pairs (a, b) of texts of different roots that meet in a hash and whose sketches allow a likeness of 4/5.

    ``crowded``: h, id, root, n, pos; ``sketches``: id, sketch, joined only to texts of hashes that hold several
    roots.  A hash of more than ``block`` texts is cut into blocks, and each pair of blocks is a group of its own.
    """
    import pyarrow as pa

    sizes = crowded.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi")
    rows = crowded.join(sizes.select("h", "blocks"), "h").join(sketches, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("h", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "root", "n", "pos", "sketch")
    names = rows.columns[:-1]

    def run(batches: Iterator) -> Iterator:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        c = {k: t.column(k).to_numpy() for k in names}
        order = np.lexsort((c["id"], c["root"], c["y"], c["x"], c["h"]))
        c = {k: v[order] for k, v in c.items()}
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 64)[order]

        def ends(*keys: str) -> np.ndarray:
            new = np.flatnonzero(np.any([np.diff(c[k]) != 0 for k in keys], axis=0)) + 1
            edges = np.concatenate([[0], new, [len(order)]])
            return np.repeat(edges[1:], np.diff(edges))

        # Rows of a group stand by root: a row's partners are those from the end of its root's run to the group's end.
        start = ends("h", "x", "y", "root")
        many = ends("h", "x", "y") - start
        total = np.concatenate([[0], np.cumsum(many)])
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS_HELD, "right")) - 1)
            i = np.repeat(np.arange(at, to), many[at:to])
            j = np.arange(len(i)) - np.repeat(total[at:to] - total[at], many[at:to]) + start[i]
            at = to
            n, m = c["n"][i], c["n"][j]
            # At the first hash that alike sets share, enough must stand behind it in both.
            ok = 9 * np.minimum(n - c["pos"][i], m - c["pos"][j]) >= 4 * (n + m)
            ok &= (c["x"][i] == c["y"][i]) | (c["block"][i] != c["block"][j])
            i, j, n, m = i[ok], j[ok], n[ok], m[ok]
            ok = 9 * np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= n + m
            if ok.any():
                a, b = c["id"][i[ok]], c["id"][j[ok]]
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in np.ascontiguousarray(pairs.T)], ["a", "b"])

    return rows.repartition(max(2, shuffle_partitions(rows.sparkSession)), "h", "x", "y").mapInArrow(run, "a long, b long")


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow a likeness of 4/5; ``sets``: id, size, sketch."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for t in batches:
            bits = [np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint64).reshape(-1, SKETCH // 64) for k in (2, 3)]
            differ = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(t.columns[:2], ["a", "b"]).filter(pa.array(9 * differ <= t.column(4).to_numpy()))

    left = sets.select(F.col("id").alias("a"), F.col("size").alias("n"), F.col("sketch").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("size").alias("m"), F.col("sketch").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", (F.col("n") + F.col("m")).alias("sizes")).mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets (id, size, sketch, hashes) are alike.  Sketches rule most pairs out, and only sets of
    the others' texts are moved."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for t in batches:
            ok = [alike(wide(x), wide(y)) for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(t.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = scratch.keep(possible(pairs, sets), "possible")
    side = lambda k, name: sets.select(F.col("id").alias(k), F.col("hashes").alias(name)).join(bounded_broadcast(scratch.keep(pairs.select(k).distinct(), "asked")), k, "left_semi")
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, component_id: the least doc_id of the texts linked to a text."""
    import pyarrow as pa

    scratch = Scratch(docs.sparkSession)
    first = scratch.keep(prefixes(docs, frequent_hashes(docs, docs.count(), shingle), shingle), "prefixes")
    least = scratch.keep(first.groupBy("key").agg(F.min("doc_id").alias("least")), "sets")
    own = first.join(least.select(F.col("least").alias("doc_id")), "doc_id", "left_semi")
    rows = own.select(F.col("doc_id").alias("id"), "n", "fp", F.posexplode("prefix").alias("pos", "h")).select("h", "id", "n", F.col("pos").cast("long").alias("pos"), "fp")
    meeting = scratch.keep(_by_hash(rows, lambda c: _meeting(c, window), _MEETING), "meeting")
    names = scratch.keep(first.select("doc_id", "key", "fp"), "names")
    scratch.drop(first)  # the prefixes are in the meetings now
    own = names.join(least.select(F.col("least").alias("doc_id")), "doc_id", "left_semi")
    crowds = scratch.keep(meeting.groupBy("id").agg(F.sum("crowd").alias("crowds")), "crowds")

    # Texts of one fingerprint or of near ones: candidates, as are the links of the trie.
    by_fp = scratch.keep(own.groupBy("fp").agg(F.min("doc_id").alias("a")), "fingerprints")
    same = own.join(by_fp, "fp").select("a", F.col("doc_id").alias("b")).where("a <> b")
    trie = trie_links(by_fp.select("fp"), scratch, by_fp.count()).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    trie = trie.join(by_fp.select(F.col("fp").alias("fa"), "a"), "fa").join(by_fp.select(F.col("fp").alias("fb"), F.col("a").alias("b")), "fb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    close = scratch.keep(same.unionByName(trie).distinct(), "close")

    def hashes(batches: Iterator) -> Iterator:
        for b in batches:
            thinned = [thin(shingles(t, shingle)) for t in utf8(b.column(1))]
            sizes = pa.array([len(x) // 5 for x in thinned], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array([odd_sketch(wide(x)) for x in thinned], pa.binary()), pa.array(thinned, pa.binary())], ["id", "size", "sketch", "hashes"])

    wanted = meeting.select("id").unionByName(close.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    some = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi")
    sets = scratch.keep(some.mapInArrow(hashes, "id long, size long, sketch binary, hashes binary"), "hashes")

    links = scratch.keep(confirmed(close, sets, scratch), "links")
    for last in (CHAIN, None, -1):
        groups = components(links, scratch)
        named = meeting.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
        if last == -1:
            pairs = _rest_pairs(named.where("crowd = 1").select("h", "id", "root", "n", "pos"), sets.select("id", "sketch"), block).distinct()
        elif last is None:
            pairs = _by_hash(named.join(crowds, "id"), lambda c: _pairs(c, window), _PAIRS).groupBy("a", "b").agg(F.sum("met").alias("met"), *[F.first(c).alias(c) for c in ("crowd", "sizes", "rest")])
            # A pair can share no more than the small hashes it met in, the large ones, and those behind the prefix.
            pairs = pairs.where("9 * (met + crowd + rest) >= 4 * sizes").select("a", "b")
        else:
            pairs = _by_hash(named.join(crowds, "id").where(F.col("pos") <= last), lambda c: _pairs(c, 1), _PAIRS).select("a", "b").distinct()
        links = links.unionByName(scratch.keep(confirmed(pairs, sets, scratch), "links"))
    groups = components(links, scratch)
    root = least.join(groups, least.least == groups.id, "left").select("key", F.coalesce("root", "least").alias("component_id"))
    out = scratch.keep(names.join(root, "key").select("doc_id", "component_id"), "components")
    scratch.leave(out)
    return out
