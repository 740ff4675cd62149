"""The Merkle manifest against a plain recursive tree, and the rows it must stand."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import merkle

SCHEMA = "doc_id long, text string, source string, lang string, n_chars int, tie string, grp string, pos string, node string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def ascii_lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def tree(nodes):
    """The root, and for each node its siblings by level as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            first = k // 8 * 8
            paths[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 8])))
            at[i] = k // 8
        nodes = [h("".join(nodes[j : j + 8])) for j in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    by = defaultdict(list)
    for i, t, s, lang, n in rows:
        c = zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 0
        a = leaf(i, s, lang, n, t)
        by[lang].append((i is not None, i or 0, a, i, leaf(i, s, lang, n, ascii_lower(t)) if c else a))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    done = {k: tree([r[2] for r in sorted(by[k], key=lambda r: r[:3])]) for k in langs}
    root, above = tree([done[k][0] for k in langs])
    out = []
    for k, up in zip(langs, above, strict=True):
        sub, paths = done[k]
        for r, path in zip(sorted(by[k], key=lambda r: r[:3]), paths, strict=True):
            node = r[4]
            for left, right in path + up:
                node = h(left + node + right)
            out.append((r[3], r[2], sub, root, h("".join(a + b for a, b in path + up)), node, node == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA)


def some_rows(n, seed, langs):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["Text A", "é Ü", "", None, "low", "long word " * 50]), rng.choice(["s", None, ""]), rng.choice(langs), rng.choice([1, None, 10**6])) for i in range(n)]
    return rows + [rows[0], rows[0], (None, "Null ID", "s", langs[0], 1), (None, None, None, None, None), (7, "other text of an id", "s", langs[0], 3)]


@pytest.mark.parametrize("n,langs,options", [(700, ["en"] * 8 + [None, "de", "", "=x"], {"block_levels": 1, "range_rows": 40}), (300, ["en", "fr"], {"block_levels": 2}), (300, [f"l{i}" for i in range(80)], {"block_levels": 1}), (1, ["en"], {})])
def test_manifest(spark, n, langs, options):
    rows = some_rows(n, n, langs)
    assert rows_of(merkle.manifest(table(spark, rows).repartition(5), **options)) == brute(rows)


def test_manifest_lone_and_empty(spark):
    one = [(5, "ABC", None, None, None)]
    assert rows_of(merkle.manifest(table(spark, one))) == brute(one)
    assert merkle.manifest(table(spark, one).where("false")).collect() == []


def test_proofs_fold_to_the_root(spark):
    rows = some_rows(200, 3, ["en", "de", None])
    for r in merkle.manifest(table(spark, rows), block_levels=1, proofs=True).collect():
        way = [(p.left.encode(), p.right.encode()) for p in r.proof]
        assert merkle.fold(r.leaf.encode(), way).decode() == r.root
        assert merkle.fold(b"0" * 64, way).decode() != r.root


def test_verified_where_nothing_changed(spark):
    """A tampered row fails exactly if its text holds one of A-Z."""
    rows = some_rows(200, 4, ["en"])
    text = {r[0]: r[1] for r in rows[:200] if r[0] not in (0, 7)}
    for r in merkle.manifest(table(spark, rows)).collect():
        if r.doc_id in text:
            hit = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and ascii_lower(text[r.doc_id]) != text[r.doc_id]
            assert r.verified == (not hit)
