"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints: 64 bits, majority of the XXH64 (seed 42) of a text's 3-word shingles.  Two fingerprints
that differ in at most ``max_bits`` bits agree on all bits of one of ``max_bits + 1`` segments (or, cut finer
for more fingerprints, on all but ``max_bits`` segments).  So the distinct fingerprints form a binary trie
for each choice of such segments, with these bits at the top, where the error budget is still zero: a node
at that height meets itself alone, and every fingerprint goes to one block a choice, however many there
are.  In a block the trie is joined with itself: pairs of nodes are traversed together, level by level,
adding the differing bits and dropping a pair of nodes once the error budget is exceeded.

A block emits no list of all pairs but the spanning forest of its links, kept by union-find while
it traverses; a pair of nodes whose leaves are already one component is dropped, which keeps
clusters of near copies from costing their square.  The forests are joined into components by
alternating large-star and small-star rounds over tables, so no component, hot or not, is gathered
in one task or on the driver.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like any other;
repeated rows and ids each get a row; a null doc_id takes the component of its fingerprint (null
only if the component has no id); an empty table gives an empty result.  Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, bounded_broadcast, shuffle_partitions, utf8

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Distinct fingerprints that one block is meant to hold.
BLOCK_ROWS = 16_384
#: Node pairs that a traversal holds at a time.
FRONTIER = 1 << 16
#: Nodes of at most so many leaves are compared leaf by leaf.
LEAVES = 32


# --- fingerprints -----------------------------------------------------------------------------


def gram_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    from itertools import repeat

    import xxhash

    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*[w[i:] for i in range(shingle)], strict=False)) if len(w) >= shingle else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for part in np.array_split(h.astype(">u8"), len(h) // 65_536 + 1):  # bounds the bit matrix of a very long text
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def text_fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(gram_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint's bits as a signed long."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            fp = np.array([text_fingerprint(t, shingle) for t in utf8(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, "doc_id long, fp long")


# --- the traversal of two subtries ------------------------------------------------------------


class Forest:
    """Union-find over places 0..n-1, with the least place of a component as its label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Min-label hooking with pointer jumping, over whole arrays."""
        label = self.label
        while True:
            x, y = label[a], label[b]
            far = x != y
            if not far.any():
                return
            a, b, x, y = a[far], b[far], x[far], y[far]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def join_subtries(a: np.ndarray, b: np.ndarray | None, depth: int, max_bits: int = MAX_BITS, frontier: int = FRONTIER, equal: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links of ``a`` with itself (``b`` None) or with ``b``, as far as the first
    ``equal`` bits agree (links that differ there may come too).

    a, b: sorted distinct uint64, each under one node at ``depth``.  A node is a range of places of
    the sorted array, so its children are found by bisection at the next bit.  Pairs of nodes are
    held on a stack in slices of at most ``frontier`` and go down one bit at a time; where both
    nodes are few leaves, the leaves are compared at once.
    """
    same = b is None
    keys = a if same else np.concatenate([a, b])
    n, off = len(keys), 0 if same else len(a)
    forest = Forest(n)
    if n == 0 or (not same and (len(a) == 0 or len(b) == 0)):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    start = np.array([[0, len(a), off, n, 0]], dtype=np.int64)
    if not same:
        start[0, 4] = int(np.bitwise_count((a[:1] ^ b[:1]) >> np.uint64(64 - depth))[0]) if depth else 0
    # a slice: its level and rows (lo, hi, lo', hi', errors)
    stack = [(depth, start)]
    while stack:
        level, p = stack.pop()
        if len(p) > frontier:
            stack.extend((level, x) for x in np.array_split(p, math.ceil(len(p) / frontier)))
            continue
        if level > depth:  # pairs of nodes that are one component already
            change = np.concatenate([[0], np.cumsum(forest.label[1:] != forest.label[:-1])])
            one = (forest.label[p[:, 0]] == forest.label[p[:, 2]]) & (change[p[:, 1] - 1] == change[p[:, 0]]) & (change[p[:, 3] - 1] == change[p[:, 2]])
            p = p[~one]
        if not len(p):
            continue
        small = np.maximum(p[:, 1] - p[:, 0], p[:, 3] - p[:, 2]) <= LEAVES
        if level == 64:
            small[:] = True
        leaf, p = p[small], p[~small]
        if len(leaf):
            _compare(keys, leaf, forest, max_bits)
        if not len(p):
            continue
        # Both children of each node: where the next bit becomes 1.
        cut = _cuts(keys, p[:, 0], p[:, 1], level), _cuts(keys, p[:, 2], p[:, 3], level)
        lo, hi, lo2, hi2, err = p.T
        kids = [(lo, cut[0], lo2, cut[1], err), (cut[0], hi, cut[1], hi2, err), (lo, cut[0], cut[1], hi2, err + 1), (cut[0], hi, lo2, cut[1], err + 1)]
        down = np.concatenate([np.stack(k, axis=1) for k in kids])
        keep = (down[:, 4] <= (max_bits if level >= equal else 0)) & (down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3])
        if same:  # (x, y) and (y, x) are one pair
            keep &= down[:, 0] <= down[:, 2]
        down = down[keep]
        if len(down):
            stack.append((level + 1, down))
    linked = np.flatnonzero(forest.label != np.arange(n))
    return keys[linked], keys[forest.label[linked]]


def _compare(keys: np.ndarray, leaf: np.ndarray, forest: Forest, max_bits: int) -> None:
    """Compare all leaves of each pair of small nodes.  A place past a node's end repeats its last."""
    lo, hi, lo2, hi2, _ = leaf.T
    wide, wide2 = int((hi - lo).max()), int((hi2 - lo2).max())
    right = [keys[np.minimum(lo2 + j, hi2 - 1)] for j in range(wide2)]
    for i in range(wide):
        x = np.minimum(lo + i, hi - 1)
        left = keys[x]
        for j in range(wide2):
            near = np.flatnonzero(np.bitwise_count(left ^ right[j]) <= max_bits)
            if len(near):
                forest.union(x[near], np.minimum(lo2 + j, hi2 - 1)[near])


def _cuts(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """First place in [lo, hi), a sorted range under one node, whose bit ``level`` (from the top) is
    set; bisection of all the ranges at once."""
    bit = np.uint64(1 << (63 - level))
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = (keys[np.where(open_, mid, 0)] & bit) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


# --- distribution -----------------------------------------------------------------------------


def segments(n: int, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> list[int]:
    """Widths of the segments: ``max_bits + 1``, and more where so many fingerprints would agree on the
    bits that stand at the top that they overfill a block."""
    m = max_bits + 1
    while m < max_bits + 4 and n >> 64 * (m - max_bits) // m > block_rows:
        m += 1
    return [64 // m + (i < 64 % m) for i in range(m)]


def choices(widths: list[int], max_bits: int = MAX_BITS) -> list[tuple[int, ...]]:
    """Orders of the segments: each choice of all but ``max_bits`` first, the others after them."""
    every = range(len(widths))
    return [(*top, *(i for i in every if i not in top)) for top in combinations(every, len(widths) - max_bits)]


def reorder(x: Column, widths: list[int], order: tuple[int, ...]) -> Column:
    """The bits of a long with its segments in another order."""
    out, left = F.lit(0).cast("long"), 64
    for i in order:
        w, low = widths[i], 64 - sum(widths[: i + 1])
        left -= w
        part = x if w == 64 else F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << w) - 1))
        out = out.bitwiseOR(F.shiftleft(part, left))
    return out


def restored(x: np.ndarray, widths: list[int], order: tuple[int, ...]) -> np.ndarray:
    """The inverse of ``reorder`` on uint64."""
    out, left = np.zeros_like(x), 64
    for i in order:
        w, low = widths[i], 64 - sum(widths[: i + 1])
        left -= w
        out |= (x >> np.uint64(left) & np.uint64((1 << w) - 1)) << np.uint64(low)
    return out


def trie_links(distinct: DataFrame, scratch: Scratch, n: int, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): forests of links among the distinct fingerprints of ``distinct`` (fp), ``n`` in all."""
    widths = segments(n, max_bits, block_rows)
    orders = choices(widths, max_bits)
    equal = [sum(widths[i] for i in o[: len(widths) - max_bits]) for o in orders]
    depth = min(min(equal), max(0, math.ceil(math.log2(max(1, n / block_rows)))))
    turned = F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), reorder(F.col("fp"), widths, o).alias("fp")) for k, o in enumerate(orders)])).alias("t")
    node = (F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0)).cast("long")
    leaves = distinct.select(turned).select("t.turn", "t.fp").withColumn("node", node)
    # A node's leaves as one sorted block of longs; where fingerprints bunch, ``part`` deals them to blocks of
    # bounded size, each of which meets each.
    parts = F.ceil(F.col("n") / (4 * block_rows)).cast("int").alias("parts")
    large = leaves.groupBy("turn", "node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * block_rows).select("turn", "node", parts)
    leaves = leaves.join(bounded_broadcast(scratch.keep(large, "large")), ["turn", "node"], "left").withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"turn": [pdf.turn.iat[0]], "node": [pdf.node.iat[0]], "part": [pdf.part.iat[0]], "leaves": [np.sort(pdf.fp.to_numpy(np.int64).view(np.uint64)).tobytes()]})

    tasks = max(shuffle_partitions(distinct.sparkSession), -(-n * len(orders) // (16 * block_rows)))
    packed = leaves.select("turn", "node", "part", "fp").repartition(tasks, "turn", "node", "part").groupBy("turn", "node", "part").applyInPandas(pack, "turn int, node long, part int, leaves binary")
    blocks = scratch.keep(packed, "blocks")
    right = blocks.join(bounded_broadcast(large.select("turn", "node")), ["turn", "node"], "left_semi").select("turn", "node", F.col("part").alias("part2"), F.col("leaves").alias("right"))
    work = blocks.withColumnRenamed("leaves", "left")
    alone = work.select("turn", "left", F.lit(None).cast("binary").alias("right"))
    among = work.join(right, ["turn", "node"]).where("part < part2").select("turn", "left", "right").repartition(tasks)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for turn, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = join_subtries(np.frombuffer(x, np.uint64), None if y is None else np.frombuffer(y, np.uint64), depth, max_bits, equal=equal[turn])
                yield pa.RecordBatch.from_arrays([pa.array(restored(f, widths, orders[turn]).view(np.int64)) for f in found], ["a", "b"])

    return alone.repartition(tasks).unionByName(among).mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root): for every id in ``links`` (a, b), the least id of its component.

    Large-star and small-star rounds until the table stands still; every round is a grouped
    minimum and a join on ids, and is written before the next reads it.
    """
    e = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    e = scratch.keep(e, "links")
    state = None
    while True:
        # large star: every greater neighbour of u goes to u's least neighbour, u included.
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: u and its lesser neighbours go to the least of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("p")).select("p.*").where("hi <> lo").distinct()
        new = scratch.keep(small, "stars")
        scratch.drop(e)
        e = new
        now = tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, fp (signed long), component_id: the least doc_id of the fingerprint's component."""
    scratch = Scratch(docs.sparkSession)
    fps = scratch.keep(fingerprints(docs, shingle), "fingerprints")
    distinct = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    n = distinct.count()
    links = scratch.keep(trie_links(distinct.select("fp"), scratch, n, max_bits, block_rows), "forests")
    groups = components(links, scratch)
    # Every fingerprint with its root; those without a link are their own.
    root = distinct.join(groups, distinct.fp == groups.id, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = root.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.keep(root.join(first, "root").select("fp", "component_id"), "components")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
