"""Merkle manifest of a table: a root to publish, and a proof a row.

A row's leaf is the SHA-256 of its fields, each `-` if null, else its UTF-8 byte count, `:` and the
value.  The leaves of a language stand by doc_id; every eight consecutive nodes become one until one
is left, the language's subroot, and the subroots become the root in the same way.

Leaves get their places by ranges: a sort into ranges by (lang, doc_id), a count a range and language,
running sums of those counts.  Places are cut into aligned blocks of ``fanout ** block_levels``, and one task
at a time holds a block: its leaves are one contiguous matrix of 64-byte hex rows, a level is that
matrix reshaped to ``fanout`` rows a line and hashed line by line, and a row's siblings at a level are the
bytes of its run before and after it, by index arithmetic.  A block's last node is a leaf of the next round
of blocks.  On the way back every block gets the sibling bytes above it, once, and each row's path
to the root is those of its own block followed by these.  A hot language is as many blocks as it needs.

Edge cases: nulls stand as `-`; a null language is a language of its own, before all others; null doc_ids
stand before all others and count as the empty text when rows to tamper with are chosen; rows
with the same doc_id stand by their leaf, and equal rows are leaves of their own; an empty text is
`0:`; a lone row is its own subroot, and its proof is of nothing; an empty table gives an empty
result; columns beside the five are not part of a leaf, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce as fold_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, bounded_broadcast, crc_mod, shuffle_partitions

FANOUT = 8
#: Levels that one task climbs: blocks of 8 ** 4 = 4096 nodes.
BLOCK_LEVELS = 4
#: Rows of a range when places are given out.
RANGE_ROWS = 250_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "grp string, pos long, left array<string>, right array<string>, subroot string, root string"


def leaf_digest(*fields: Column) -> Column:
    """Hex SHA-256 of the fields in order, each with its length."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in texts]), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def depth(n: int, fanout: int) -> int:
    """Levels from n nodes to one."""
    k = 0
    while n > 1:
        n, k = -(-n // fanout), k + 1
    return k


# --- inside a block ---------------------------------------------------------------------------


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def climb(hex_rows, levels: int, fanout: int = FANOUT) -> list[np.ndarray]:
    """The block's levels as matrices of 64-byte rows, the lowest first."""
    out = [np.frombuffer("".join(hex_rows).encode(), np.uint8).reshape(-1, 64)]
    for _ in range(levels):
        m = out[-1]
        full = len(m) // fanout
        lines = [digest(row) for row in m[: full * fanout].reshape(full, fanout * 64)]
        if full * fanout < len(m):
            lines.append(digest(m[full * fanout :].tobytes()))
        out.append(np.frombuffer(b"".join(lines), np.uint8).reshape(-1, 64))
    return out


def siblings(levels: list[bytes], i: int, fanout: int = FANOUT) -> list[tuple[bytes, bytes]]:
    """Bytes before and after row i and its ancestors in their runs, below the block's last level."""
    out = []
    for data in levels[:-1]:
        first = i // fanout * fanout
        out.append((data[first * 64 : i * 64], data[(i + 1) * 64 : (first + fanout) * 64]))
        i //= fanout
    return out


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    return fold_left(lambda node, lr: digest(lr[0] + node + lr[1]), path, leaf)


# --- tables -----------------------------------------------------------------------------------


def placed(nodes: DataFrame, order: list[str], scratch: Scratch, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``nodes`` with pos, the place in its grp by ``order``, and total, the grp's rows."""
    parts = max(shuffle_partitions(nodes.sparkSession), -(-nodes.count() // range_rows))
    tied = nodes.withColumn("tie", F.monotonically_increasing_id())
    sort = ["grp", *order, "tie"]
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = tied.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).select(*nodes.columns, F.spark_partition_id().alias("part"), at.alias("at"))
    ranged = scratch.keep(ranged, "ranged")
    counts = ranged.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    own = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", "grp", (before - F.col("first")).alias("shift"), F.sum("n").over(own).alias("total"))
    starts = bounded_broadcast(scratch.keep(starts, "starts"))
    return ranged.join(starts, ["part", "grp"]).select(*nodes.columns, (F.col("at") + F.col("shift")).alias("pos"), "total")


class Tree:
    """Rounds of blocks over (grp, pos, total, node, name); the last table has one node a grp."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, fanout: int, block_levels: int):
        self.scratch, self.fanout, self.block_levels = scratch, fanout, block_levels
        self.width = fanout**block_levels
        self.rounds = [nodes]
        while len(self.rounds) == 1 or (self.rounds[-1].agg(F.max("total")).first()[0] or 1) > 1:
            self.rounds.append(scratch.keep(self._up(self.rounds[-1]), "nodes"))

    def blocks(self, nodes: DataFrame):
        return nodes.groupBy("grp", F.floor(F.col("pos") / self.width).cast("long").alias("block"))

    def _up(self, nodes: DataFrame) -> DataFrame:
        width, fanout, most = self.width, self.fanout, self.block_levels

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pos")
            total = int(pdf.total.iat[0])
            top = climb(pdf.node, min(most, depth(total, fanout)), fanout)[-1]
            return pd.DataFrame({"grp": [pdf.grp.iat[0]], "pos": [int(pdf.pos.iat[0]) // width], "total": [-(-total // width)], "node": [top.tobytes().decode()]})

        return self.blocks(nodes.select("grp", "pos", "total", "node")).applyInPandas(run, "grp string, pos long, total long, node string")

    def down(self, paths: DataFrame, rows: int, run, schema: str) -> DataFrame:
        """``run`` for each block of a round: its nodes, the bytes of its levels, the path of its last node."""
        most, fanout = self.block_levels, self.fanout

        def each(nodes: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
            nodes = nodes.sort_values("pos").reset_index(drop=True)
            data = [m.tobytes() for m in climb(nodes.node, min(most, depth(int(nodes.total.iat[0]), fanout)), fanout)]
            return run(nodes, data, path.iloc[0])

        return self.blocks(self.rounds[rows]).cogroup(paths.groupBy("grp", "pos")).applyInPandas(each, schema)

    def paths(self, top: DataFrame, to: int) -> DataFrame:
        """Paths of the blocks of round ``to`` from those of the last nodes."""
        fanout = self.fanout

        def run(nodes: pd.DataFrame, data: list[bytes], path) -> pd.DataFrame:
            own = [siblings(data, i, fanout) for i in range(len(nodes))]
            return pd.DataFrame({
                "grp": nodes.grp, "pos": nodes.pos,
                "left": [[a.decode() for a, _ in p] + list(path.left) for p in own],
                "right": [[b.decode() for _, b in p] + list(path.right) for p in own],
                "subroot": path.subroot, "root": path.root,
            })

        paths = top
        for k in range(len(self.rounds) - 2, to, -1):
            paths = self.scratch.keep(self.down(paths, k, run, PATH), "paths")
        return paths


def manifest(docs: DataFrame, modulus: int = 3, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS, range_rows: int = RANGE_ROWS, proofs: bool = False) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified; with ``proofs`` also
    proof, the hex siblings left and right of the node a level.  Rows whose id's crc32 ``modulus`` divides
    are checked with their text's A-Z lower-cased."""
    scratch = Scratch(docs.sparkSession)
    text = F.col("text")
    fields = [F.col(c) for c in FIELDS]
    changed = F.when(crc_mod(F.col("doc_id"), modulus) == 0, leaf_digest(*fields[:-1], lowered(text)))
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    leaves = scratch.keep(docs.select(grp.alias("grp"), "doc_id", leaf_digest(*fields).alias("node"), changed.alias("changed")), "leaves")
    tree = Tree(placed(leaves, ["doc_id", "node"], scratch, range_rows), scratch, fanout, block_levels)
    subroots = tree.rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node")
    over = Tree(placed(subroots, ["name"], scratch, range_rows), scratch, fanout, block_levels)
    none = F.array().cast("array<string>")
    root = over.rounds[-1].select("grp", "pos", none.alias("left"), none.alias("right"), F.lit("").alias("subroot"), F.col("node").alias("root"))

    def run_subroot(nodes: pd.DataFrame, data: list[bytes], path) -> pd.DataFrame:
        own = [siblings(data, i, fanout) for i in range(len(nodes))]
        return pd.DataFrame({
            "grp": nodes.name, "pos": 0,
            "left": [[a.decode() for a, _ in p] + list(path.left) for p in own],
            "right": [[b.decode() for _, b in p] + list(path.right) for p in own],
            "subroot": nodes.node, "root": path.root,
        })

    top = scratch.keep(over.down(over.paths(root, 0), 0, run_subroot, PATH), "subroots")

    def run_leaf(nodes: pd.DataFrame, data: list[bytes], path) -> pd.DataFrame:
        above = [(a.encode(), b.encode()) for a, b in zip(path.left, path.right, strict=True)]
        told, folded, full = [], [], []
        for i, (leaf, changed) in enumerate(zip(nodes.node, nodes.changed, strict=True)):
            way = siblings(data, i, fanout) + above
            told.append(digest(b"".join(x for lr in way for x in lr)).decode())
            folded.append(fold((leaf if changed is None else changed).encode(), way).decode())
            if proofs:
                full.append([{"left": a.decode(), "right": b.decode()} for a, b in way])
        out = pd.DataFrame({"doc_id": nodes.doc_id, "grp": nodes.grp, "leaf": nodes.node, "subroot": path.subroot, "root": path.root, "proof_sha256": told, "folded_root": folded})
        return out.assign(proof=full) if proofs else out

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, grp string, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + ", proof array<struct<left: string, right: string>>" * proofs
    out = tree.down(tree.paths(top, 0), 0, run_leaf, schema)
    lang = F.when(F.col("grp") != "", F.substring("grp", 2, 2**31 - 1))
    return out.select("doc_id", lang.alias("lang"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *["proof"] * proofs)


def _item(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


#: crc32 is not a DuckDB function: its table rule over the decimal digits, a byte at a time.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda a, b: xor(a >> 8, list_reduce(list_prepend(xor(a & 255, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

ORACLE_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256({' || '.join(f'({_item(c)})' for c in FIELDS)}) AS leaf,
    sha256({' || '.join(f'({_item(c)})' for c in FIELDS[:-1])} || ({_item(f"translate(text, '{UPPER}', '{LOWER}')")})) AS changed,
    xor({_CRC}, 4294967295) % 3 = 0 AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS pos FROM l),
t AS (SELECT grp, 0 AS level, pos, count(*) OVER (PARTITION BY grp) AS n, leaf AS node FROM p
  UNION ALL SELECT grp, level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY grp, level, pos // 8),
s AS (SELECT grp, node, level AS height, row_number() OVER (ORDER BY grp) - 1 AS pos FROM t WHERE n = 1),
r AS (SELECT 0 AS level, pos, count(*) OVER () AS n, node FROM s
  UNION ALL SELECT level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM r WHERE n > 1 GROUP BY level, pos // 8),
w AS (
  SELECT p.doc_id, t.level, string_agg(t.node, '' ORDER BY t.pos) FILTER (WHERE t.pos < p.pos // (8 ** t.level)::BIGINT) AS lft, string_agg(t.node, '' ORDER BY t.pos) FILTER (WHERE t.pos > p.pos // (8 ** t.level)::BIGINT) AS rgt
  FROM p JOIN t ON p.grp = t.grp AND t.n > 1 AND t.pos // 8 = p.pos // (8 ** (t.level + 1))::BIGINT GROUP BY p.doc_id, t.level
  UNION ALL SELECT p.doc_id, s.height + r.level, string_agg(r.node, '' ORDER BY r.pos) FILTER (WHERE r.pos < s.pos // (8 ** r.level)::BIGINT), string_agg(r.node, '' ORDER BY r.pos) FILTER (WHERE r.pos > s.pos // (8 ** r.level)::BIGINT)
  FROM p JOIN s ON p.grp = s.grp JOIN r ON r.n > 1 AND r.pos // 8 = s.pos // (8 ** (r.level + 1))::BIGINT GROUP BY p.doc_id, s.height, r.level),
f AS (SELECT doc_id, 0 AS level, CASE WHEN tampered THEN changed ELSE leaf END AS node FROM p
  UNION ALL SELECT f.doc_id, f.level + 1, sha256(coalesce(lft, '') || f.node || coalesce(rgt, '')) FROM f JOIN w ON f.doc_id = w.doc_id AND f.level = w.level),
top AS (SELECT doc_id, arg_max(node, level) AS folded FROM f GROUP BY doc_id),
way AS (SELECT doc_id, string_agg(coalesce(lft, '') || coalesce(rgt, ''), '' ORDER BY level) AS told FROM w GROUP BY doc_id)
SELECT p.doc_id, p.leaf, s.node AS subroot, (SELECT node FROM r WHERE n = 1) AS root, sha256(coalesce(told, '')) AS proof_sha256, folded AS folded_root, folded = (SELECT node FROM r WHERE n = 1) AS verified
FROM p JOIN s ON p.grp = s.grp JOIN top ON p.doc_id = top.doc_id LEFT JOIN way ON p.doc_id = way.doc_id
"""
