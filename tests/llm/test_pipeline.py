"""Stages of the pipeline against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import mixing, setjoin, toxicity
from tests.llm.test_ops import brute_lines, check_pieces


def brute_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return [r for i, r in enumerate(rows) if find(i) == i]


def near_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    out = [None, "", " \n", "a b c", "A  b c", "a b d"]
    common = [rng.choice(words) for _ in range(30)]
    for n in (6, 12, 40, 60, 150, 400):
        for _ in range(4):
            t = [rng.choice(words) for _ in range(n)] + common * (n == 40)
            out.append(" ".join(t))
            for edits in (1, 1, 2, 4, 8):  # each copy edits the one before it: chains
                t = list(t)
                for _ in range(edits):
                    t[rng.randrange(len(t))] = rng.choice(words)
                out.append(" ".join(t))
    rng.shuffle(out)
    return list(enumerate(out))


def test_near_duplicates_stage(spark):
    rows = near_texts()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_kept(rows)
    assert len(want) < len(rows) - 30
    got = corpus_pipeline.drop_near_duplicates(spark, d, "")
    assert sorted(r.doc_id for r in got.collect()) == [i for i, _ in want]


def test_near_duplicates_stage_repeated_ids(spark):
    rows = [(7, "one two three four five six seven"), (7, "one two three four five six seven"), (None, "one two three four five six seven"), (7, "other words stand in here"), (3, None), (5, "")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(tuple(r) for r in got) == sorted([rows[0], rows[3], rows[4]], key=lambda r: (r[0], r[1] or ""))


def test_near_duplicates_stage_empty(spark):
    assert corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_near_duplicates_crowds(spark):
    """Groups larger than what the first rounds compare, some of whose texts are just beyond the likeness."""
    rng, words, out = random.Random(9), [f"w{i}" for i in range(500)], []
    for n in (30, 60, 90):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(60):
            t = list(base)
            for _ in range(rng.randrange(1, 5)):
                t[rng.randrange(n)] = rng.choice(words)
            out.append(" ".join(t))
    rows = list(enumerate(out))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [i for i, _ in brute_kept(rows)]
    assert len(want) > 3
    for window, block in ((1, 7), (1, 4096), (8, 25)):
        got = setjoin.near_duplicates(d, window=window, block=block).where("doc_id = component_id")
        assert sorted(r.doc_id for r in got.collect()) == want


def test_odd_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 5000):
        a = np.unique(rng.integers(0, 2**40, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**40, n // 3).astype(np.uint64)]))
        x, y = (np.frombuffer(setjoin.odd_sketch(v), np.uint8) for v in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


#: Names that the stages or their operators use for columns of their own.
CLASHES = ["_keep", "_row", "row", "doc", "id", "first", "kept", "n_dropped", "_key", "_salt", "lost", "d", "n", "h", "s", "times", "copy", "copies", "threshold", "component_id", "score", "leader"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns of clashing names, near copies, shared lines and odd rows."""
    rng, words = random.Random(2), [f"w{i}" for i in range(400)]
    rows = []
    for i in range(80):
        t = " ".join(rng.choice(words) for _ in range(rng.choice([8, 30, 120])))
        if i % 4 == 0:
            t += "\nA line that several documents hold"
        rows.append((i, rows[-1][1] + " tail" if i % 9 == 8 else t))
    rows += [(200, None), (201, ""), (202, "  \n\t"), (203, "word " * 4000)]
    data = [(i, t, "en", f"s{i % 4}" if i != 201 else None, None if t is None else len(t), *[f"{c}-{i}" for c in CLASHES]) for i, t in rows]
    return rows, spark.createDataFrame(data, ", ".join(f"`{c}` {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in COLUMNS)).repartition(3)


def told(df):
    assert df.columns == COLUMNS
    rows = df.collect()
    assert all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHES)
    return rows


def test_toxicity_stage(spark, sf):
    """What stays is what scores below the threshold, and nothing of it changes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = sorted(r.doc_id for r in docs.select("doc_id", model.column(docs.text).alias("score")).collect() if r.score < toxicity.THRESHOLD)
    got = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.select("doc_id").collect()) == want
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    assert len(set(want) - toxic) >= 0.95 * (docs.count() - len(toxic))


def test_toxicity_stage_clashes(clashing, spark, sf):
    rows, docs = clashing
    kept = told(corpus_pipeline.drop_toxic(spark, docs, sf))
    assert {(r.doc_id, r.text) for r in kept} <= set(rows)


def test_line_stage(clashing, spark):
    rows, docs = clashing
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in told(corpus_pipeline.dedup_lines(spark, docs, ""))), key=str)
    before = dict(rows)
    want = [(i, t, len(t) if gone else None if before[i] is None else len(t)) for i, _, gone, t in brute_lines(rows)]
    assert got == sorted(want, key=str)


def test_near_duplicates_stage_clashes(clashing, spark):
    rows, docs = clashing
    want = sorted(i for i, _ in brute_kept(rows))
    assert sorted(r.doc_id for r in told(corpus_pipeline.drop_near_duplicates(spark, docs, ""))) == want
    twice = docs.unionByName(docs.where("doc_id < 10"))  # ids that repeat
    assert sorted(r.doc_id for r in told(corpus_pipeline.drop_near_duplicates(spark, twice, ""))) == want


def test_mixing_stage(clashing, spark):
    """Each document as often as the mix takes it; those without words once."""
    rows, docs = clashing
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix_sources(docs).collect()}
    got = [r.doc_id for r in told(corpus_pipeline.mix(spark, docs, ""))]
    for i, _ in rows:
        size, words = taken[i]
        assert got.count(i) == (words // size if size else 1)


def test_packing_stage(clashing, spark):
    rows, docs = clashing
    check_pieces(corpus_pipeline.pack(spark, docs, "").collect(), rows)


def test_run_is_the_stages_in_order(spark, sf):
    """run's pieces are those of the stages applied one after another, and hold no document that a stage rejects."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = corpus_pipeline.dedup_lines(spark, corpus_pipeline.drop_toxic(spark, docs, sf), sf)
    kept = brute_kept([(r.doc_id, r.text) for r in clean.orderBy("doc_id").collect()])
    mixed = corpus_pipeline.mix(spark, clean.where(clean.doc_id.isin([i for i, _ in kept])), sf)
    check_pieces(corpus_pipeline.run(spark, sf).collect(), [(r.doc_id, r.text) for r in mixed.select("doc_id", "text").collect()])
