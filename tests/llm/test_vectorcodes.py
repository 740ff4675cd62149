"""Vector codes against the definition in plain Python integers."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<double>, label int, position string, part string, row string, x string"
LIMIT, LONG = vectorcodes.LIMIT, vectorcodes.LONG


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [max(-LIMIT, min(LIMIT, math.floor(1024 * Fraction(x)))) for x in v], lab) for i, v, lab in kept]
    ints.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(ints[0][1])
    ints = [r for r in ints if len(r[1]) == width]
    w = -(-width // parts)
    cut = lambda v: [tuple((v + [0] * (w * parts - width))[p * w : (p + 1) * w]) for p in range(parts)]
    rows = [(i, cut(v), lab) for i, v, lab in ints]
    books = [[r[1][p] for r in rows[:entries]] for p in range(parts)]

    def find(book, a):
        return min((sum((x - y) ** 2 for x, y in zip(a, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = defaultdict(list)
            for r in rows:
                own[find(book, r[1][p])[1]].append(r[1][p])
            new.append([tuple(sum(c) // len(own[k]) for c in zip(*own[k], strict=True)) if k in own else e for k, e in enumerate(book)])
        books = new
    out, total = [], defaultdict(int)
    for i, v, lab in rows:
        got = [find(b, a) for b, a in zip(books, v, strict=True)]
        error = sum(min(d, LONG) for d, _ in got)
        out.append((i, lab, "".join(f"{k:02x}" for _, k in got), min(error, LONG)))
        total[lab] += min(error, LONG)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, min(total[lab], LONG)) for i, lab, c, e in out), key=repr), digest


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, lab, "a", "b", "c", "d") for i, v, lab in rows], SCHEMA).repartition(3)
    codes, books = vectorcodes.compress(df, **options)
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in codes.collect()), key=repr), vectorcodes.books_digest(books)


def some(n, width, seed, spread=0.3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(width)], rng.choice([None, 1, 2])) for i in range(n)]


def test_codes(spark):
    rows = some(400, 8, 1)
    rows += [(1000 + i, rows[5][1], 3) for i in range(200)]  # a hot part
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("width", [4, 6, 1])
def test_few_entries_and_widths(spark, width):
    rows = some(60, width, width)
    assert run(spark, rows, entries=7, rounds=3) == brute(rows, entries=7, rounds=3)


def test_odd_rows(spark):
    rows = some(40, 8, 2)
    odd = [None, [], [0.1] * 7 + [None], [float("nan")] * 8, [float("inf")] + [0.0] * 7, [0.5] * 4, [0.5] * 12]
    rows += [(100 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(None, [0.25] * 8, None), (None, [-0.25] * 8, 1), (3, [0.1] * 8, 1), (3, [0.1] * 8, 1), (200, [-0.0] * 8, 2)]
    assert run(spark, rows) == brute(rows)


def test_large_numbers(spark):
    """Beyond 2**53 the products are Python integers; beyond a long, errors are the largest long."""
    rows = some(20, 4, 3) + [(50, [1e6, -1e6, 3e9, -3e9], 1), (51, [1e15, 5e15, -1e15, 0.0], 1), (52, [1e300, -1e300, 1.0, 0.0], 2)]
    assert run(spark, rows, entries=5) == brute(rows, entries=5)


def test_empty(spark):
    assert run(spark, [], entries=3)[0] == []
    assert run(spark, [(1, None, 1)])[0] == []


def test_codes_name_entries(spark):
    rows = some(300, 8, 5)
    df = spark.createDataFrame([(i, v, lab, "a", "b", "c", "d") for i, v, lab in rows], SCHEMA)
    codes, books = vectorcodes.compress(df, entries=16)
    for r in vectorcodes.decompress(codes, books).collect():
        x = vectorcodes.quantise(np.array(rows[r.vec_id][1]))
        y = np.floor(np.array(r.vector) * 1024).astype(int)
        assert int(((x - y) ** 2).sum()) == r.error


def test_pack_round_trip():
    x = np.array([[1, -32767], [32767, 0], [32768, 1], [-32768, 1], [2**31 - 1, 0], [2**31, 5], [-(2**62), 2**62]])
    packed = vectorcodes.pack(x)
    assert np.array_equal(vectorcodes.unpack(packed, 2), x) and len(set(packed)) == len(x)
