"""The Fiedler lens over tables: second eigenvector of each class's neighbour graph.

All classes are worked on at once.  Neighbours are searched within a class.  To keep classes apart where parts of them are joined, a coordinate that is constant in a class and
farther from any other class's than the classes are wide is added: distances within a class do not change, and no other class is
nearer.  The eigenvector comes from Lanczos rounds over blocks of vertices, a row a block with its edges and vectors packed: for a product with the
normalised adjacency matrix a block gets from the others the values at the far ends of its edges.  Once rough values are known, a round takes a polynomial of the
matrix, so that there are fewer of them.  What comes to the driver is a row of at most ``basis`` numbers a class and round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import neighbors as N
from tessera.operators.prepare import draw_order
from tessera.operators.spanning import spanning_edges
from tessera.operators.topology import both_ways, components
from tessera.plans.session import cut_lineage

BASIS, KEPT, TOLERANCE, ROUNDS = 48, 6, 1e-9, 2000
#: Vectors before the filter, its degree, and vertices of a block.
PLAIN, FILTER, BLOCK_ROWS = 24, 16, 16_384


def standardized(points: DataFrame, key: str) -> DataFrame:
    """Entries of x less their class's mean, over its deviation; 0 where that is 0."""
    at = points.select(key, F.posexplode("x").alias("_i", "_v")).groupBy(key, "_i").agg(F.avg("_v").alias("m"), F.stddev_pop("_v").alias("s"))
    fit = at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "m", "s"))).alias("_fit"))  # an entry a dimension
    scaled = F.zip_with("x", "_fit", lambda v, f: F.when(f["s"] > 0, (v - f["m"]) / f["s"]).otherwise(F.lit(0.0)))
    return points.join(fit, key).withColumn("x", scaled).drop("_fit")


def set_apart(points: DataFrame, key: str) -> DataFrame:
    """(row_id, x) with one more coordinate, by which two classes are farther apart than any is wide."""
    names = points.select(key).distinct()
    width = points.select(F.posexplode("x").alias("_i", "_v")).groupBy("_i").agg(F.min("_v").alias("a"), F.max("_v").alias("b")).agg(F.sqrt(F.sum(F.pow(F.col("b") - F.col("a"), F.lit(2)))).alias("w"))
    w = width.first().w or 0.0
    codes = names.withColumn("_code", F.row_number().over(Window.orderBy(key)))  # a row a class
    return points.join(codes, key).select("row_id", F.concat("x", F.array(F.col("_code") * F.lit(2 * w + 1.0))).alias("x"))


def neighbour_graph(points: DataFrame, key: str, neighbours: int) -> DataFrame:
    """(i, j): edges i < j of the symmetrised neighbour graph of each class; its components are joined by their closest pairs."""
    keyed = cut_lineage(points.select("row_id", "x", F.col(key).alias("_key")))
    own = keyed.select("row_id", "_key")
    near = N.k_nearest(keyed, keyed.select(F.col("row_id").alias("proto_id"), F.col("x").alias("v"), "_key"), neighbours, others=True, on="_key")
    edges = cut_lineage(near.select(F.least("row_id", "proto_id").alias("i"), F.greatest("row_id", "proto_id").alias("j")).distinct())
    comp = cut_lineage(components(own.select(F.col("row_id").alias("vid")), edges).withColumnRenamed("vid", "row_id"))
    parts = comp.join(own, "row_id").groupBy("_key").agg(F.count_distinct("comp").alias("n")).where("n > 1")
    if parts.isEmpty():
        return edges
    inside = lambda e: e.join(own.withColumnsRenamed({"row_id": "i", "_key": "_a"}), "i").join(own.withColumnsRenamed({"row_id": "j", "_key": "_b"}), "j").where("_a = _b").select("i", "j")
    bridges = spanning_edges(cut_lineage(set_apart(points, key)), comp).select(F.col("lo").alias("i"), F.col("hi").alias("j"))
    return cut_lineage(edges.unionByName(inside(bridges)))


def second_vectors(vertex: DataFrame, edges: DataFrame, key: str, basis: int = BASIS, tolerance: float = TOLERANCE, rounds: int = ROUNDS, seen: list | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, vid, f): for each class the unit eigenvector of the second largest eigenvalue of its normalised adjacency matrix, up to sign.

    ``vertex`` (key, vid) of connected classes of three or more, ``edges`` (i, j) within them.  Lanczos with full orthogonalisation, done twice; after
    ``basis`` vectors it starts again from the best few and the last (a thick restart).  What is not done after ``PLAIN`` vectors starts again, from
    its best four, on the Chebyshev polynomial of degree ``FILTER`` of the matrix that stays within 1 below the class's third value and grows above: it has the same
    vectors, and a round takes ``FILTER`` products.  A class is done when its residual, over the polynomial's slope, is below ``tolerance``, and then rests;
    ``seen`` gets (round, the largest residual).  More than ``rounds`` is an error.
    """
    if basis < KEPT + 3:
        raise ValueError(f"a basis holds at least {KEPT + 3} vectors")
    parts = vertex.groupBy(F.col(key).alias("key")).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("parts"))
    before = F.coalesce(F.sum("parts").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    names = cut_lineage(parts.withColumn("code", before))  # a row a class; its blocks are numbered from code
    start = F.pmod(F.conv(F.substring(draw_order(F.col("vid"), 0), 1, 8), 16, 10).cast("long"), F.lit(2**31)) / F.lit(float(2**30)) - 1.0
    block = F.col("code") + F.pmod(F.xxhash64("vid"), F.col("parts"))
    v = cut_lineage(vertex.select(F.col(key).alias("key"), "vid").join(names, "key").select("code", block.alias("block"), "vid", start.alias("start")))
    graph = _graph(v, edges)
    alone = graph.where(F.size("peers") > 0).isEmpty()
    total = {r.code: r.n for r in graph.groupBy("code").agg(F.sum("n").alias("n")).collect()}
    state = _by_block(graph.select("code", "block", F.col("scale").alias("q"), "w"), lambda code, q, w: (1 / (q * np.sqrt(total[code])), w), "q binary, w binary")
    small: dict = {}  # a row a class: the projected matrix, whether it is done and the weights of its vector
    ends: dict = {}  # of the interval in which the polynomial stays small: its middle and half its width
    size = 1
    for turn in range(rounds):
        state, told = _orthogonal(state, size)
        worst = 0.0
        for code, c, norm in told:
            h = small.setdefault(code, {"h": np.zeros((basis + 2, basis + 2)), "done": None})
            if h["done"] is None:
                if size > 1:
                    h["h"][:size, size - 1] = h["h"][size - 1, :size] = c
                    values, vectors = np.linalg.eigh(h["h"][1:size, 1:size])
                    residual = abs(norm * vectors[-1, -1]) / (FILTER**2 / ends[code][1] if ends else 1.0)
                    if residual < tolerance or norm < 1e-12:
                        h["done"] = [0.0, *vectors[:, -1].tolist()]
                    worst = max(worst, residual)
        if seen is not None:
            seen.append((turn, worst))
        if all(h["done"] is not None for h in small.values()):
            break
        size += 1
        if not ends and size > min(PLAIN, basis):
            first = {}
            for code, h in small.items():
                values, vectors = np.linalg.eigh(h["h"][1 : size - 1, 1 : size - 1])
                cut = max(-0.9, float(values[-min(3, len(values))]))
                ends[code] = ((cut - 1) / 2, (cut + 1) / 2)
                first[code] = vectors[:, -4:].sum(axis=1)
                if h["done"] is not None:
                    first[code] = np.pad(h["done"][1:], (0, size - 1 - len(h["done"])))
                    h["done"] = [0.0, 1.0]
                h["h"][:] = 0.0
            state = _by_block(state, lambda code, q, w, first=first: (q[0], first[code] @ q[1 : 1 + len(first[code])]), "q binary, w binary")
            size = 1
            continue
        if size > basis:
            keep = {}
            for code, h in small.items():
                values, vectors = np.linalg.eigh(h["h"][1 : size - 1, 1 : size - 1])
                best = vectors[:, ::-1][:, :KEPT]
                if h["done"] is not None:  # its vector comes first and stays
                    best[:, 0] = np.array(h["done"][1:] + [0.0] * (size - 2 - len(h["done"]) + 1))
                    h["done"] = [0.0, 1.0]
                h["h"][:] = 0.0
                h["h"][range(1, KEPT + 1), range(1, KEPT + 1)] = values[::-1][:KEPT]
                keep[code] = best.T
            state = _by_block(state, lambda code, q, w, keep=keep: (np.vstack([q[:1], keep[code] @ q[1:-1], q[-1:]]), w), "q binary, w binary")
            size = KEPT + 2
        product = _products(graph, state.select("block", F.col("w").alias("t")), ends, FILTER if ends else 1, alone)
        state = state.select("code", "block", "q").join(product.select("block", F.col("t").alias("w")), "block").select("code", "block", "q", "w")
    else:
        raise ValueError(f"no eigenvector within {rounds} rounds; the residual is {worst}")
    weight = {code: np.array(h["done"]) for code, h in small.items()}
    f = _by_block(state, lambda code, q, w: ((weight[code] @ q[: len(weight[code])]).tolist(), 0), "f array<double>, w int")
    each = f.join(graph.select("block", "vids"), "block").select("code", F.explode(F.arrays_zip("vids", "f")).alias("r"))
    return each.join(names, "code").select(F.col("key").alias(key), F.col("r.vids").alias("vid"), F.col("r.f").alias("f"))


def _numbers(packed, kind=np.float64) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), kind)


def _graph(v: DataFrame, edges: DataFrame) -> DataFrame:
    """A row a block of vertices (code, block, vid, start): its ids in order, their degrees' sum n and inverse roots ``scale``, the columns of their edges (``ptr`` and
    ``col``; behind the block's own come those that each of ``peers`` sends, in order), which rows each peer is sent, and the starting vector w.  Edges go
    both ways, so a block knows from its own edges what a peer needs of it."""
    import pyarrow as pa

    at = v.withColumnRenamed("vid", "a")
    both = both_ways(edges).join(at, "a").join(v.select(F.col("vid").alias("b"), F.col("block").alias("other")), "b").select("code", "block", "a", "start", "b", "other")
    names = ["code", "block", "n", "vids", "scale", "ptr", "col", "peers", "sent", "w"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary())

    def pack(t):
        a, b, other, start = (t.column(c).to_numpy() for c in ("a", "b", "other", "start"))
        block = t.column("block")[0].as_py()
        order = np.lexsort((b, a))
        a, b, other, start = a[order], b[order], other[order], start[order]
        vids, ptr, degree = np.unique(a, return_index=True, return_counts=True)
        col, sent, width = np.empty(len(a), np.int32), [], len(vids)
        own = other == block
        col[own] = np.searchsorted(vids, b[own])
        peers = np.unique(other[~own]).tolist()
        for p in peers:
            here = other == p
            need = np.unique(b[here])
            col[here] = width + np.searchsorted(need, b[here])
            width += len(need)
            sent.append(np.searchsorted(vids, np.unique(a[here])).astype(np.int32).tobytes())
        row = (t.column("code")[0].as_py(), block, len(a), vids, (1 / np.sqrt(degree)).tobytes(), ptr.astype(np.int32).tobytes(), col.tobytes(), peers, sent, start[ptr].tobytes())
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    schema = "code long, block long, n long, vids array<long>, scale binary, ptr binary, col binary, peers array<long>, sent array<binary>, w binary"
    return cut_lineage(both.groupBy("block").applyInArrow(pack, schema))


def _products(graph: DataFrame, vectors: DataFrame, ends: dict, steps: int, alone: bool) -> DataFrame:
    """(block, t): the matrix times the vectors (block, t), or the Chebyshev polynomial of degree ``steps`` where ``ends`` are given.

    Before a product each block sends its peers the values they need.  Classes of one block (``alone``) send nothing and take all steps at once.
    """
    import pyarrow as pa

    graph = graph.select("code", "block", "scale", "ptr", "col", "peers", "sent")
    names = ["block", "src", "t", "p"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def run(times: int, last: bool):
        def step(left, right):
            g = {c: left.column(c)[0] for c in left.column_names}
            block, peers = g["block"].as_py(), g["peers"].as_py()
            scale, ptr, col = _numbers(g["scale"]), _numbers(g["ptr"], np.int32), _numbers(g["col"], np.int32)
            of = {s: i for i, s in enumerate(right.column("src").to_pylist())}
            t, p = _numbers(right.column("t")[of[block]]), right.column("p")[of[block]]
            p = _numbers(p) if p.is_valid else None
            middle, half = ends.get(g["code"].as_py(), (0.0, 1.0))
            for _ in range(times):
                x = np.concatenate([scale * t, *(_numbers(right.column("t")[of[s]]) for s in peers)])
                y = (scale * np.add.reduceat(x[col], ptr) - middle * t) / half
                t, p = y if p is None else 2 * y - p, t
            rows = [(block, block, t.tobytes(), None if p is None else p.tobytes())]
            if not last:
                x = scale * t
                rows += [(s, block, x[_numbers(at, np.int32)].tobytes(), None) for s, at in zip(peers, g["sent"], strict=True)]
            return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

        return step

    sent = vectors.select("block", F.col("block").alias("src"), "t", F.lit(None).cast("binary").alias("p"))
    for times, last in [(steps, True)] if alone else [(0, False), *[(1, k == steps - 1) for k in range(steps)]]:
        sent = graph.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run(times, last), "block long, src long, t binary, p binary")
    return sent.select("block", "t")


def _by_block(state: DataFrame, work: Callable, kind: str) -> DataFrame:
    """(code, block, columns of ``kind``): what ``work(code, q, w)`` gives for each block; q has a row a vector, arrays are packed."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"code long, block long, {kind}")
    arrow = to_arrow_schema(schema)
    packed = lambda x: x.tobytes() if isinstance(x, np.ndarray) else x

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            rows = []
            for code, block, q, w in zip(*(b.column(c) for c in ("code", "block", "q", "w")), strict=True):
                w = _numbers(w)
                rows.append((code.as_py(), block.as_py(), *map(packed, work(code.as_py(), _numbers(q).reshape(-1, len(w)), w))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow, strict=True)], schema=arrow)

    return state.select("code", "block", "q", "w").mapInArrow(run, schema)


def _orthogonal(state: DataFrame, size: int) -> tuple[DataFrame, list]:
    """State (code, block, q, w) with w, made orthogonal to the ``size`` vectors in q and of length 1 (0 if nothing is left), appended to q; and
    a row (code, c, norm) a class: w's products with the vectors, and what was left.  The first is a plan over the table of the state."""
    sums = [F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(size)]).alias("c"), F.sum("ww").alias("ww")]
    state = cut_lineage(_by_block(state, lambda code, q, w: (q, w, (q @ w).tolist(), float(w @ w)), "q binary, w binary, c array<double>, ww double"))
    first = {r.code: np.array(r.c) for r in state.groupBy("code").agg(*sums).collect()}  # a row a class

    def less(code, q, w):
        w = w - first[code] @ q
        return (q @ w).tolist(), float(w @ w)

    again = {r.code: (np.array(r.c), r.ww) for r in _by_block(state, less, "c array<double>, ww double").groupBy("code").agg(*sums).collect()}
    left = {code: ww - float(c @ c) for code, (c, ww) in again.items()}
    norm = {code: float(np.sqrt(n)) if n > 1e-24 else 0.0 for code, n in left.items()}

    def unit(code, q, w):
        w = w - first[code] @ q - again[code][0] @ q
        w = w / norm[code] if norm[code] > 1e-12 else np.zeros(len(w))
        return np.vstack([q, w]), w

    return _by_block(state, unit, "q binary, w binary"), [(code, first[code], norm[code]) for code in first]


def fiedler(points: DataFrame, key: str, neighbours: int = 10, standardize: bool = True, basis: int = BASIS, seen: list | None = None) -> DataFrame:
    """(key, row_id, f): the Fiedler lens of each class of points (key, row_id, x).

    The second eigenvector of the normalised Laplacian of the class's symmetrised neighbour graph, of length 1; the value of largest
    magnitude (to 9 digits; the least row_id on ties) is positive.  A class of fewer than three rows has 0.  Rows that coincide
    are separate vertices.  If the second eigenvalue is multiple, f is one of its eigenvectors.
    """
    p = points.select(key, "row_id", "x")
    p = cut_lineage(standardized(p, key) if standardize else p)
    if p.isEmpty():
        return p.select(key, "row_id", F.lit(0.0).alias("f"))
    sizes = p.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    few = p.join(sizes.where("_n < 3"), key).select(key, "row_id", F.lit(0.0).alias("f"))
    big = cut_lineage(p.join(sizes.where("_n >= 3"), key).drop("_n"))
    if big.isEmpty():
        return few
    edges = neighbour_graph(big, key, neighbours)
    f = cut_lineage(second_vectors(big.select(key, F.col("row_id").alias("vid")), edges, key, basis, seen=seen).withColumnRenamed("vid", "row_id"))
    top = f.groupBy(key).agg(F.max(F.struct(F.round(F.abs("f"), 9).alias("m"), (-F.col("row_id")).alias("r"), F.col("f").alias("v"))).alias("_t"))
    turned = f.join(top, key).select(key, "row_id", F.when(F.col("_t.v") < 0, -F.col("f")).otherwise(F.col("f")).alias("f"))
    return turned.unionByName(few)
