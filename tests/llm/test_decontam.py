"""Decontamination by suffix arrays against plain loops over words."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import decontam
from tessera.llm import queries as Q

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    grams = {}
    for name, t in items:
        w = words(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + k]), set()).add("" if name is None else str(name))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if g := grams.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= g
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def case(seed, n_docs=60, vocabulary=12):
    """Few words, so that windows of all lengths recur; copies, quotes and odd rows."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)] + ["é", "日本", "X9"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 9, 10, 11, 30])))) for i in range(12)] + [(3, "w0 w1 w2"), (None, "w1 w1 w1 W1"), (50, None), (51, " -- "), (52, "")]
    docs = []
    for i in range(n_docs):
        t = " ".join(rng.choices([*vocab, "other", "words"], k=rng.choice([0, 5, 60, 400])))
        if i % 3 == 0:
            t += "! " + rng.choice(items[:12])[1].upper() + "\n" + t
        docs.append((i, t))
    return docs + [docs[3], docs[3], (None, docs[6][1]), (98, None), (99, ""), (100, "w0," * 3000)], items


def tables(spark, docs, items):
    d = spark.createDataFrame([(*r, "a", "b", "c") for r in docs], "doc_id long, text string, doc string, hits string, n_words string").repartition(3)
    return d, spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, name string")


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"shard_words": 64}), (3, {"shard_words": 500, "chunk_bytes": 60}), (4, {"window": 3, "shard_words": 33})])
def test_marks(spark, seed, options):
    docs, items = case(seed)
    d, b = tables(spark, docs, items)
    got = sorted((tuple(r) for r in decontam.report(decontam.mark(d, b, **options)).collect()), key=repr)
    assert got == brute(docs, items, options.get("window", 10))


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in Q.op12_benchmark_decontamination(spark, sf).collect()), key=repr) == brute(docs, items)


def test_clean_documents_stay(spark):
    docs, items = case(5)
    d, b = tables(spark, docs, items)
    clean = decontam.decontaminate(d, b)
    assert clean.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted(((d, t) for d, t in docs if not brute([(d, t)], items)[0][5]), key=repr)


@pytest.mark.parametrize("shard_words", [40, 1 << 19])
def test_longest_matches(spark, shard_words):
    docs, items = case(6, n_docs=25)
    d, b = tables(spark, docs, items)
    want = {}
    for name, t in items:
        w = words(t)
        for i in range(len(w)):
            for doc, text in docs:
                v = words(text)
                for j in range(len(v)):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    if n >= min(10, len(w)):
                        key = ("" if name is None else str(name), i)
                        m = (-n, doc is None, doc or 0, j)
                        want[key] = min(want.get(key, m), m)
    got = {(r.item_id, r.item_start): (-r.length, r.doc_id is None, r.doc_id or 0, r.doc_start) for r in decontam.longest_matches(d, b, shard_words=shard_words).collect()}
    assert got == want


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(0)
    for n, top, depth in ((1, 1, 4), (300, 1, 50), (400, 3, 7), (2000, 2, 400), (500, 1 << 20, 20)):
        w = np.concatenate([rng.integers(0, top + 1, n), np.zeros(depth + 1, np.int64)]).astype(np.int32)
        w[n // 2 : n // 2 + n // 4] = w[: n // 4]

        def key(i, w=w, depth=depth):
            own = w[i : i + depth].tolist()
            return own[: own.index(0)] if 0 in own else own

        order = decontam.suffix_array(w, np.flatnonzero(w), depth)
        assert sorted(order.tolist()) == np.flatnonzero(w).tolist()
        keys = [key(i) for i in order.tolist()]
        assert keys == sorted(keys)


def test_words_are_cut_anywhere(monkeypatch):
    monkeypatch.setattr(decontam, "SLICE_BYTES", 3)
    t = "Ab9_é-日本 x  " * 5 + "end"
    assert [w.decode() for part in decontam.split_words(t.encode()) for w in part] == words(t)


def test_empty_tables(spark):
    d, b = tables(spark, *case(7))
    assert decontam.mark(d.where("false"), b).collect() == []
    assert not any(r.contaminated for r in decontam.report(decontam.mark(d, b.where("false"))).collect())
    assert decontam.longest_matches(d, b.where("false")).collect() == []
