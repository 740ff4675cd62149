"""Operators against brute force on small tables, with the odd rows that each must stand."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import langmodel, linededup, mixing, packing, quality, secrets, simhash, tokencount, toxicity, winnow
from tessera.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t ", None),
    (4, "one two three four five six seven\nShared line of text here\nShared line of text here", "b"),
    (5, "  SHARED line of text HERE  \nown line of words\x1c\x85with odd\xa0spaces here", "b"),
    (6, "é ü ß 日本語 テスト\nshort\nshort", "é"),
    (7, "dup dup dup dup dup dup dup dup", "b"),
    (8, "dup dup dup dup dup dup dup dup", "b"),
    (None, "an id that is null shared line of text here\nshared line of text here", "a"),
    (9, "word " * 3000 + "password = 'abcdefgh1'", "c"),
    (9, "word " * 3000 + "password = 'abcdefgh1'", "c"),
    (10, "x", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, s, "en", "clash") for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size string").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


# --- 1 ------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp, max_bits=3):
    root = {i: i for i, _ in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in fp:
        for b, y in fp:
            if a < b and (x ^ y).bit_count() <= max_bits:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i, _ in fp}


def test_simhash_query(spark, sf, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op1_simhash_near_dedup(spark, sf).collect()}
    fp = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: f"{x:016x}" for i, x in fp.items()} == {i: x for i, (x, _) in got.items()}
    assert brute_components(sorted(fp.items())) == {i: c for i, (_, c) in got.items()}


@pytest.mark.parametrize("block_rows", [8, 64, 4096])
def test_simhash_chains_and_clusters(spark, block_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [base]
    for _ in range(6):
        fps.append(np.concatenate(fps)[:120] ^ (np.uint64(1) << rng.integers(0, 64, len(np.concatenate(fps)[:120])).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(np.concatenate(fps)[:120])).astype(np.uint64)))
    keys = np.unique(np.concatenate(fps))
    df = spark.createDataFrame([(int(x),) for x in keys.view(np.int64)], "fp long")
    from tessera.llm.common import Scratch

    scratch = Scratch(spark)
    links = simhash.trie_links(df, scratch, len(keys), block_rows=block_rows)
    got = {r.id: r.root for r in simhash.components(links, scratch).collect()}
    want = brute_components([(int(s), int(k)) for s, k in zip(keys.view(np.int64), keys, strict=True)])
    groups = lambda m: sorted(sorted(i for i in m if m[i] == r) for r in set(m.values()))
    assert groups({i: got.get(i, i) for i in want}) == groups(want)


@pytest.mark.parametrize("max_bits,n,m", [(3, 1000, 4), (3, 2**31, 5), (3, 2**45, 6), (1, 1000, 2), (0, 1000, 1), (5, 1000, 6)])
def test_simhash_segments(spark, max_bits, n, m):
    """Reordered bits come back, and any fingerprints within the budget agree at the top of some order."""
    widths = simhash.segments(n, max_bits)
    orders = simhash.choices(widths, max_bits)
    assert sum(widths) == 64 and len(widths) == m and len(orders) == math.comb(m, max_bits)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 50, dtype=np.uint64)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    from pyspark.sql import functions as F

    for o in orders:
        got = np.array([r[0] for r in df.select(simhash.reorder(F.col("fp"), widths, o)).collect()], dtype=np.int64).view(np.uint64)
        assert (simhash.restored(got, widths, o) == x).all()
        assert sorted(np.bitwise_count(got)) == sorted(np.bitwise_count(x))
    at = np.cumsum([0, *widths])
    for _ in range(200):
        bits = rng.choice(64, max_bits, replace=False)
        touched = {int(np.searchsorted(at, b, side="right")) - 1 for b in bits}
        assert any(not touched & set(o[: m - max_bits]) for o in orders)


@pytest.mark.parametrize("block_rows", [2, 10**6])
def test_simhash_links_of_bunched_fingerprints(spark, block_rows):
    """Fingerprints that differ in a few places only, more of them than a block holds."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 3, dtype=np.uint64)
    fp = np.unique([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, 4))) for b in base for _ in range(40)])
    d = spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "fp long")
    from tessera.llm.common import Scratch

    links = simhash.trie_links(d, Scratch(spark), len(fp), 3, block_rows).collect()
    root = {int(v): int(v) for v in fp.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        p, q = sorted((find(r.a), find(r.b)))
        root[q] = p
    want = brute_components([(int(v), int(v) & (2**64 - 1)) for v in fp.view(np.int64)])
    assert {k: find(k) for k in root} == want


def test_simhash_odd(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[8] == 7
    assert simhash.near_duplicates(empty).count() == 0


# --- 2 ------------------------------------------------------------------------------------------


def test_toxicity_restores():
    words = ["idiot", "stupid", "moron", "clown", "the", "hello", "world"] * 5
    m = char_model(words)
    assert [toxicity.restore(w, m) for w in ("1d10t", "$tupid", "m0r0n", "c.l.o.w.n", "stuuuupid", "hello,", "the***", "2024")] == ["idiot", "stupid", "moron", "clown", "stupid", "hello", "the", "2024"]
    assert toxicity.spaced_words(b"so i d i o t is".split(), m) == ["idiot"]


def char_model(words):
    return toxicity.CharModel(toxicity.gram_counts(words))


def test_char_model_is_interpolated():
    words = ["idiot", "stupid", "dido"]
    m, text = char_model(words), [f"^^{w}$" for w in words]
    count = lambda g: sum(t[i : i + len(g)] == g for t in text for i in range(2 if len(g) == 1 else 0, len(t)))
    n = sum(len(t) - 2 for t in text)
    for context, c in (("^^", "i"), ("di", "d"), ("id", "$"), ("zz", "i"), ("xd", "i"), ("zz", "q")):
        p3 = count(context + c) / count(context) if count(context + c) else 0.0
        after = sum(t[i] == context[1] for t in text for i in range(1, len(t) - 1))
        p2 = sum(t[i : i + 2] == context[1] + c for t in text for i in range(1, len(t) - 1)) / after if after else 0.0
        assert m.logp(context, c) == pytest.approx(math.log(0.7 * p3 + 0.2 * p2 + 0.09 * count(c) / n + 1e-4))


def test_toxicity_restores_at_any_length():
    m = char_model(["clown", "stupid", "you", "are", "the", "hello"])
    assert toxicity.restore("stu" + "u" * 60 + "pid", m) == "stupid"
    said = "you are the stupid clown you are the stupid clown".split()
    assert toxicity.restore(".".join("".join(said)), m).split() == said
    for before in range(30, 48, 3):  # a word across each place of the run
        run = " ".join(("the" * 16)[:before] + "stupid" + "clown")
        assert "stupid" in toxicity.spaced_words(run.encode().split(), m), before
    long = ".".join("youarestupid" * 2000)
    assert toxicity.restore(long, m).split() == ["you", "are", "stupid"] * 2000
    assert toxicity.Features(m).document(b"y.o.u.s.t.u.p.i.d") >= {"you", "stupid"}


def test_toxicity_restores_plain_disguises():
    m = char_model(["idiot", "stupid", "shit", "ass", "class", "the", "hello", "letter", "too", "wow", "book", "euro", "loser"])
    forms = {"stuupid": "stupid", "idiiot": "idiot", "shi+": "shit", "a$$": "ass", "cla$$": "class", "@ss": "ass", "\"$tupid!\"": "stupid", "€uro": "euro", "£oser": "loser", "|oser!!": "loser"}
    plain = {"hello": "hello", "letter,": "letter", "too": "too", "book!": "book", "wow!!": "wow", "(the)": "the", "2024": "2024", "$50": "50", "!!!": "", "...": "", "50%": "50"}
    assert {w: toxicity.restore(w, m) for w in forms | plain} == forms | plain
    assert toxicity.spaced_words(b"what an a s s he was".split(), m) == ["ass"]


def test_words_are_skipped_only_where_no_reading_matters(texts):
    """Limited to a model's names, features are those of all words that are names."""
    m = char_model(["idiot", "stupid", "moron", "clown", "the", "hello", "as", "loser"])
    names = {"idi*", "stupid", "stup*", "clown*", "as", "los*", "ounting"}
    every, some = toxicity.Features(m), toxicity.Features(m, names)
    tokens = "1d10t idiiot $tupid sstupid stu.p.i.d c.l.o.w.n a$ @s as! iiidiot |oser loooser ((clown)) you.stupid st-upid id i'd 51d10t".encode().split()
    for w in [*tokens, *{w for t in texts.values() for w in (t or "").encode().split()}]:
        assert some[w] == tuple(x for x in every[w] if x in names), w
    name_of = lambda f: f if isinstance(f, str) else f[0]
    for t in [b" ".join(tokens), *((t or "").encode() for t in texts.values())]:
        assert some.document(t) == {f for f in every.document(t) if name_of(f) in names}


def brute_decode(token, model):
    import itertools

    best = (-math.inf, "")
    for arcs in itertools.product(*toxicity.lattice(token)):
        text, s = "".join(a for a, _ in arcs), -sum(c for _, c in arcs)
        full = f"^^{text}$"
        s += sum(model.logp(full[i : i + 2], full[i + 2]) for i in range(len(full) - 2))
        best = max(best, (s, text))
    return best


def test_viterbi_is_exact():
    m = char_model(("idiot", "stupid", "tree", "boss", "tools"))
    for token in ("1d10t", "t00l$", "b0ss", "tr33", "5.t.u", "aaa1", "!!|"):
        got = toxicity.decode(token, m)
        assert got == brute_decode(token, m)[1], token


def test_toxicity_query(spark, labels):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score_documents(d, lab).join(lab, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    hit = [r for r in held if r.predicted]
    assert sum(r.toxic for r in hit) / len(hit) > 0.9
    assert sum(r.predicted for r in held if r.toxic) / sum(r.toxic for r in held) > 0.75


def test_toxicity_model_is_of_the_rows_alone(spark):
    """The same rows in other files and orders give the same model."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    a, b = toxicity.fit(d.coalesce(1), lab), toxicity.fit(d.repartition(7, "text"), lab.repartition(3))
    assert a.counts == b.counts and a.names == b.names
    assert a.weights.tolist() == pytest.approx(b.weights.tolist()) and a.bias == pytest.approx(b.bias)


def test_toxicity_never_sees_the_held_out_labels(spark):
    from pyspark.sql import functions as F

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    other = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(d, lab), toxicity.fit(d, other)
    assert a.names == b.names and a.weights.tolist() == b.weights.tolist() and a.counts == b.counts


def test_penalty_is_chosen_by_the_training_rows():
    """Features that say nothing are shrunk away; one that says all is not."""
    rng = np.random.default_rng(2)
    x = (rng.random((400, 30)) < 0.3).astype(float)
    fold, one = np.arange(400) % toxicity.FOLDS, np.ones(400)
    noise = (rng.random(400) < 0.3).astype(float)
    assert toxicity.choose_penalty(x, noise, one, fold) == max(toxicity.PENALTIES)
    assert toxicity.choose_penalty(x, x[:, 0], one, fold) == min(toxicity.PENALTIES)
    w, b = toxicity.fit_logistic(np.repeat(x, 2, axis=0), np.repeat(x[:, 0], 2), np.ones(800))
    w2, b2 = toxicity.fit_logistic(x, x[:, 0], 2 * one)
    assert w.tolist() == pytest.approx(w2.tolist()) and b == pytest.approx(b2)


def test_toxicity_odd(spark, odd, empty, labels):
    none = labels.where("false")
    assert all(r.score < 1e-6 for r in toxicity.score_documents(odd, none).collect())
    assert toxicity.score_documents(empty, labels).count() == 0
    some = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (6, None), (7, 1), (8, 0), (9, 0)], "doc_id long, toxic int")
    got = toxicity.score_documents(odd, some).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)


# --- 3 ------------------------------------------------------------------------------------------


def brute_base(text):
    out = [(*m.span(), "assign") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(*m.span(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    return out + [(*m.span(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 32]


def test_secret_query(spark, sf, texts):
    order = ("assign", "access", "hex")
    for r in Q.op3_secret_scan(spark, sf).collect():
        want = sorted(brute_base(texts[r.doc_id]), key=lambda x: (x[0], order.index(x[2])))
        said = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, _, k in want) for x in order)
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_secret_links():
    weak = "Zk3Qp9Lm2Xv8Rt5Yb1Nc7W"
    alone = f"some words {weak} and more"
    assert secrets.scan(alone)[1] == []
    text = f"user = alice\nhost: db.example.com:5432\nvalue {weak} end"
    assert [k for _, _, k in secrets.scan(text)[1]] == ["ident", "endpoint", "secret"]
    assert secrets.scan("user = alice\n" + "x " * 400 + weak)[1] == []
    assert secrets.scan(f"user = alice\n\n{weak}")[1] == []
    assert secrets.scan("ſecret = abcdefgh12 toKen: x")[0] == []
    assert [x[2] for x in secrets.scan("AKIA" + "A" * 12 + " and " + weak)[1]] == ["secret"]


def brute_linked(text, strong, weak, reach):
    """The interval join over all pairs of parts."""
    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    scope = lambda s: sum(b <= s for b in breaks)
    need = {"secret": ("ident", "endpoint"), "ident": ("secret",), "endpoint": ("secret",)}
    out = []
    for s, e, k in weak:
        for s2, e2, k2 in {*strong, *weak}:
            if secrets.ROLE[k2] in need[k] and scope(s) == scope(s2) and s2 <= e + reach and e2 >= s - reach:
                out.append((s, e, k))
                break
    return out


@pytest.mark.parametrize("seed", range(8))
def test_secret_links_are_the_interval_join(seed):
    import random

    rng = random.Random(seed)
    parts = ["user = alice", "login: bob77", "host: db.example.com:5432", "postgres://h.example/x", "Zk3Qp9Lm2Xv8Rt5Yb1Nc7W", "AKIA" + "B2" * 8, "password = hunter2hunter2", "0a1b2c3d" * 5, "\n\n", "\n \n", "plain words here", "account_id=acme"]
    for _ in range(30):
        text = " ".join(rng.choice(parts) + " x" * rng.randrange(0, 60) for _ in range(rng.randrange(1, 14)))
        reach = rng.choice([0, 10, 60, 400])
        strong = secrets.base_spans(text, text.lower())
        weak = secrets.weak_parts(text, text.lower(), strong)
        assert secrets.linked(text, strong, weak, reach) == brute_linked(text, strong, weak, reach)


def test_secret_odd(odd, empty):
    got = secrets.scan_documents(odd).collect()
    assert len(got) == len(ODD) and [r.n_assign for r in got if r.doc_id == 9] == [1, 1]
    assert secrets.scan_documents(empty).count() == 0


# --- 4 ------------------------------------------------------------------------------------------


def test_mix_targets(spark, docs):
    got = mixing.mix_sources(docs).toPandas()
    src = docs.select("doc_id", "source").toPandas()
    got = got.merge(src, on="doc_id")
    total = got["size"].sum()
    size = got.groupby("source")["size"].sum()
    names = sorted(size.index)
    w = {n: [1, 2, 3][i % 3] for i, n in enumerate(names)}
    target, open_, left = {}, set(names), float(total)
    while True:
        share = left / sum(w[n] for n in open_)
        over = [n for n in open_ if share * w[n] > 3 * size[n]]
        if not over:
            target.update({n: share * w[n] for n in open_})
            break
        for n in over:
            target[n] = 3.0 * size[n]
            left -= target[n]
            open_.discard(n)
    for n in names:
        g = got[got.source == n]
        assert g.target.iloc[0] == pytest.approx(target[n]) and g.source_size.iloc[0] == size[n]
        assert abs(g.taken.sum() - target[n]) <= g["size"].max()
    assert (got.taken <= 3 * got["size"]).all()


def test_mix_is_nested_and_repeats(docs):
    half = {r.doc_id: r.taken for r in mixing.mix_sources(docs, budget=0.5).collect()}
    full = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    assert full == {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert all(half[i] <= full[i] for i in full) and sum(half.values()) < sum(full.values())


def test_mix_odd(odd, empty):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(ODD) and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    assert set(mixing.mixed_documents(odd).columns) == set(odd.columns)


# --- 5 ------------------------------------------------------------------------------------------


def check_pieces(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in texts]
    by_doc, seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for i, x in ids:
        want.setdefault(i, []).append(x)
    for i, docs_ in want.items():
        assert sum(r.length for r in by_doc[i]) == sum(map(len, docs_))
        for r in by_doc[i]:
            ok = [x for x in docs_ if len(x) == r.doc_tokens]
            assert any(r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *x[r.start : r.start + r.length])) for x in ok)
    pad = 0
    for parts in seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    assert pad == 0


def test_packing(spark, docs, texts):
    check_pieces(packing.pack_documents(docs.where("doc_id < 60"), shard_ids=20_000).collect(), [(i, t) for i, t in texts.items() if i < 60])


def test_packing_odd(odd, empty):
    check_pieces(packing.pack_documents(odd).collect(), [(i, t) for i, t, _ in ODD])
    assert packing.pack_documents(empty).count() == 0


def test_packing_ids_are_the_librarys(spark, texts):
    """Added tokens, contractions, runs of spaces and other scripts."""
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path())
    odd = ["x <|endoftext|> y", "<|endoftext|><|endoftext|>", "a  b \n\n c \t", "   ", " \xa0 x\u3000 y ", "it's we'll IT'S they've 'd", "日本語 ١٢٣ naïve e\u0301", "\x1c\x85 \x0b\x0c", "a<|endoftext|", "'" * 50, "9" * 400, "ab" * 5000]
    for x in [*odd, *texts.values()]:
        assert e.ids(x or "").tolist() == t.encode(x or "", add_special_tokens=False).ids
    rows = list(enumerate(odd))
    check_pieces(packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def word_hashes(texts_):
    """Word hashes and their numbers, as the packing reads them off the ids, and the corpus of just these texts."""
    e = packing.Encoder(packing.tokenizer_path())
    ids = [np.append(e.ids(t), np.uint16(1)) for t in texts_]
    size = np.array([len(x) for x in ids])
    words, n = e.words(np.concatenate(ids), np.cumsum(size) - size)
    df = np.zeros(1 << packing.BIN_BITS, dtype=np.int64)
    for x in np.split(packing.bins_of(words), np.cumsum(n)[:-1]):
        df[x] += 1
    return ids, words, n, packing.Corpus(df, len(n), float(n.mean()))


def test_packing_words(texts):
    """Runs of ids between spaces and punctuation are words: equal words after a space have equal hashes, others not."""
    sample = [re.sub(r"[^A-Za-z]+", " ", " " + t) for t in texts.values() if t and t.isascii()][:40]
    _, words, n, _ = word_hashes(sample)
    want = [w for t in sample for w in t.split()]
    assert n.sum() == len(want)
    assert len(set(zip(words.tolist(), want, strict=True))) == len(set(want)) == len(set(words.tolist()))


def brute_bm25(texts_, q, d):
    tf = [Counter(t.split()) for t in texts_]
    n, mean, s = len(tf), sum(x.total() for x in tf) / len(tf), 0.0
    for w in tf[q]:
        df = sum(w in x for x in tf)
        idf = max(0.0, math.log((n - df + 0.5) / (df + 0.5)))
        if df > 1:
            s += idf * tf[d][w] * 2.2 / (tf[d][w] + 1.2 * (0.25 + 0.75 * tf[d].total() / mean))
    return s


def test_bm25_scores():
    docs_ = [" alpha beta gamma delta", " alpha beta x", " gamma gamma delta y z", " q r s t u v", " m n o p"]
    _, words, n, corpus = word_hashes(docs_)
    index = packing.Index(words, n, corpus)
    for q in range(len(docs_)):
        for d in range(len(docs_)):
            assert index.scores(q)[d] == pytest.approx(brute_bm25(docs_, q, d))


def test_packing_walk():
    """The greedy walk against its definition: the seed's best unused neighbour follows, else the next unused."""
    import random

    rng = random.Random(3)
    vocab = [f" {w}{v}" for w in ("sun", "moon", "star", "rain", "snow") for v in "abcdefgh"]
    docs_ = ["".join(rng.choice(vocab) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    ids, words, n, corpus = word_hashes(docs_)
    window, lengths = 64, np.array([len(x) for x in ids])
    got = packing.order_documents(packing.Index(words, n, corpus), lengths, window).tolist()
    want, left, at, seed = [], list(range(len(docs_))), 0, 0
    for i in range(len(docs_)):
        best = left[0]
        if at % window and i:
            scores = [(round(brute_bm25(docs_, seed, d), 9), -d) for d in left]
            if max(scores)[0] > 0:
                best = -max(scores)[1]
        left.remove(best)
        want.append(best)
        before, at = at, at + int(lengths[best])
        if before % window == 0 or before // window != at // window:
            seed = best
    assert got == want


def test_packing_leaders():
    """The rarest words that enough documents hold; rarer ones only where none has so many."""
    df = np.zeros(1 << packing.BIN_BITS, dtype=np.int64)
    df[[3, 4, 5, 6, 7]] = 1, 2, 300, 260, 9
    bins, n = np.array([3, 4, 5, 6, 7, 5, 6, 3, 4, 7, 3]), np.array([5, 2, 0, 3, 1])
    lead, second = packing.leaders(bins, n, df, least=256)
    part = lambda x: (-1 if x < 0 else int(x) & ((1 << packing.BIN_BITS) - 1))
    assert [part(x) for x in lead] == [6, 6, -1, 4, -1]
    assert [part(x) for x in second] == [5, 5, -1, 7, -1]


def test_packing_brings_copies_together(spark):
    """Near copies that are far apart in the table land in one shard and follow each other."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(150):
        t = [word() for _ in range(60)]
        rows += [(i, " ".join(t)), (1000 + i, " ".join([*t[:-2], word()]))]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shard_ids=4000).collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r.doc_id, set()).add(r.sequence_id)
    near = sum(min(abs(a - b) for a in seqs[i] for b in seqs[1000 + i]) <= 1 for i in range(150))
    assert near >= 135


# --- 6 ------------------------------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, sf, texts):
    for r in Q.op6_quality_rules(spark, sf).collect():
        want = brute_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_quality_ratio(spark, docs, labels):
    trusted = labels.where("quality = 1").select("doc_id")
    counts = quality.bin_counts(docs, trusted, 64)
    same = quality.bin_counts(docs, trusted, 64, broadcast_rows=1)  # the shuffled join
    assert sorted(counts.collect()) == sorted(same.collect())
    ratios = quality.log_ratios(counts, 64)
    c = {r.bin: (r.raw, r.target) for r in counts.collect()}
    raw, target = sum(x for x, _ in c.values()), sum(x for _, x in c.values())
    for b in range(64):
        x, y = c.get(b, (0, 0))
        assert ratios[b] == pytest.approx(math.log((y + 1) / (target + 64)) - math.log((x + 1) / (raw + 64)))


def test_quality_verdicts(spark, sf, docs, labels, texts):
    """Scores and verdicts against multinomials over the same bins, counted by hand."""
    from pyspark.sql import functions as F

    words_ = sorted({w for t in texts.values() for w in WORD.findall(t or "")})
    h = dict(spark.createDataFrame([(w,) for w in words_], "w string").select("w", F.xxhash64("w")).collect())
    pairs = sorted({(h[a], h[b]) for t in texts.values() for w in [WORD.findall(t or "")] for a, b in zip(w, w[1:], strict=False)})
    h2 = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    bins = {}
    for i, t in texts.items():
        w = [h[x] for x in WORD.findall(t or "")]
        bins[i] = [x % quality.BUCKETS for x in [*w, *(h2[p] for p in zip(w, w[1:], strict=False))]]
    raw = Counter(b for v in bins.values() for b in v)
    target = Counter(b for i, v in bins.items() if i in trusted for b in v)
    ratio = lambda b: math.log((target[b] + 1) / (target.total() + quality.BUCKETS)) - math.log((raw[b] + 1) / (raw.total() + quality.BUCKETS))
    for r in quality.quality_rules(docs, labels.where("quality = 1").select("doc_id")).collect():
        want = sum(map(ratio, bins[r.doc_id])) / len(bins[r.doc_id]) if bins[r.doc_id] else 0.0
        assert r.score == pytest.approx(want)
        n, _, _, _, repeated = brute_rules(texts[r.doc_id])
        failed = n < 50 or 100 * repeated > 50 * n
        assert r.base_failed == failed and r.kept == (not failed and r.score >= quality.MIN_SCORE)


def test_quality_odd(spark, odd, empty, labels):
    none = labels.where("false").select("doc_id")
    got = quality.quality_rules(odd, none).collect()
    for r in got:
        t = [t for i, t, _ in ODD if i == r.doc_id][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t)
    many = "\n".join(f"a{i} b{i} c{i} d{i}" for i in range(40))
    d = spark.createDataFrame([(1, f"{many}\n{many} tail")], "doc_id long, text string")
    r = quality.quality_rules(d, none).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(f"{many}\n{many} tail")
    assert quality.quality_rules(empty, none).count() == 0


# --- 7 ------------------------------------------------------------------------------------------


def test_token_counts_against_library(texts):
    from tokenizers import Tokenizer, models

    m = tokencount.Unigram.load(tokencount.vocabulary_path())
    lib = Tokenizer(models.Unigram([("<unk>", -1000.0), *m.score.items()], 0))
    words = {tokencount.WORD_START + w for t in list(texts.values())[:40] for w in t.split()}
    known = [w for w in words if all(c in m.score for c in w)]
    got = m.counts(words)
    assert len(known) > 1000
    assert {w: got[w] for w in known} == {w: len(lib.encode(w, add_special_tokens=False).ids) for w in known}


def test_token_counts_brute():
    m = tokencount.Unigram(["a", "b", "ab", "abc", "bc", "c", "aba"])

    def best(w):
        if not w:
            return (0.0, 0)
        out = []
        for n in range(1, len(w) + 1):
            if w[:n] in m.score:
                s, k = best(w[n:])
                out.append((m.score[w[:n]] + s, -(k + 1)))
        if w[0] not in m.score:
            s, k = best(w[1:])
            n = len(w[0].encode())
            out.append((n * m.byte + s, -(k + n)))
        s, k = max(out)
        return s, -k

    words = ["abcabc", "ababab", "abxc", "é", "aébc", "cba", "a", "abab"]
    assert m.counts(words) == {w: best(w)[1] for w in words}


def test_token_counts_query(spark, sf, texts):
    """The whole query against the segmentations of each word by themselves."""
    m = tokencount.Unigram.load(tokencount.vocabulary_path())
    memo = {}

    def length(w):
        if w not in memo:
            best = [(0.0, 0)]
            for end in range(1, len(w) + 1):
                ways = [(best[i][0] + m.score[w[i:end]], -best[i][1] - 1) for i in range(end) if w[i:end] in m.score]
                if w[end - 1] not in m.score:
                    n = len(w[end - 1].encode())
                    ways.append((best[end - 1][0] + n * m.byte, -best[end - 1][1] - n))
                s, k = max(ways)
                best.append((s, -k))
            memo[w] = best[-1][1]
        return memo[w]

    for r in Q.op7_token_counts(spark, sf).collect():
        w = WORD.findall(texts[r.doc_id] or "")
        assert (r.n_pretokens, r.n_tokens) == (len(w), sum(length(tokencount.WORD_START + x) for x in w))


def test_token_counts_odd(odd, empty):
    got = tokencount.count_tokens(odd).collect()
    assert len(got) == len(ODD) and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert tokencount.count_tokens(empty).count() == 0


# --- 8 ------------------------------------------------------------------------------------------


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip))
    holder = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            holder.setdefault(key(x), set()).add(linededup.NO_ID if i is None else i)
    out = []
    for i, t in rows:
        me = linededup.NO_ID if i is None else i
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or min(holder[key(x)]) == me]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(50_000, 200_000), (5, 7)])
def test_line_dedup(docs, odd, texts, sizes):
    for d, rows in ((docs, list(texts.items())), (odd, [(i, t) for i, t, _ in ODD])):
        got = linededup.dedup_lines(d, shard_keys=sizes[0], group_probes=sizes[1]).select("doc.doc_id", "n_lines", "n_dropped", "kept").collect()
        assert sorted(map(tuple, got), key=str) == brute_lines(rows)


def test_line_dedup_hot_line(spark):
    """A line of every document, among many tiny shards: only its shard has copies, and no copy has many probes."""
    from pyspark.sql import functions as F

    from tessera.llm.common import Scratch

    rows = [(i, f"the line that all of them share\nthe line of pair {i // 2}\nown line of document {i}") for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lines = linededup.line_hashes(d).withColumn("shard", F.pmod("h1", F.lit(1000)).cast("int"))
    hot = linededup.shard_copies(lines, 100).collect()
    assert len(hot) == 1 and hot[0].copies >= 60
    got = linededup.decisions(d, Scratch(spark), shard_keys=3, group_probes=100)
    assert {r.doc_id: len(r.lost) for r in got.collect()} == {i: 1 + i % 2 for i in range(1, 6000)}


def test_line_dedup_empty(empty):
    assert linededup.dedup_lines(empty).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    for h in (linededup.PerfectHash.build(keys), linededup.PerfectHash.load(linededup.PerfectHash.build(keys).dump())):
        assert sorted(h.place(keys).tolist()) == list(range(len(keys)))
    with_rest = linededup.PerfectHash([], keys)
    assert with_rest.place(keys).tolist() == list(range(len(keys)))


# --- 9 ------------------------------------------------------------------------------------------


def brute_winnow(hashes, window):
    """Positions of the rightmost least hash of each window."""
    out = []
    for i in range(max(1, len(hashes) - window + 1)):
        w = hashes[i : i + window]
        if w:
            j = max(j for j, x in enumerate(w) if x == min(w)) + i
            if j not in out:
                out.append(j)
    return out


def test_winnowing_choice(spark, docs):
    from pyspark.sql import functions as F

    d = docs.where("doc_id < 40").select("doc_id", "text")
    fp = winnow.add_fingerprint(d, F.col("text"), "fp", 3, 8).select("doc_id", "text", winnow.positions(F.col("fp")).alias("at"), F.transform("fp", lambda x: F.shiftright(x, 31)).alias("h"))
    full = winnow.add_fingerprint(d, F.col("text"), "fp", 3, 1).select("doc_id", F.transform("fp", lambda x: F.shiftright(x, 31)).alias("all"))
    for r in fp.join(full, "doc_id").collect():
        n = len(WORD.findall(r.text))
        assert len(r["all"]) == max(1, n - 2)
        want = brute_winnow(list(r["all"]), 8)
        assert list(r["at"]) == want and list(r["h"]) == [r["all"][j] for j in want]


def brute_next(rows):
    order = sorted(rows, key=lambda r: (-(winnow.NO_ID if r[0] is None else r[0]), -r[2], r[1]))
    return [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t, _) in enumerate(order)]


@pytest.mark.parametrize("range_rows", [1, 3, 40, 10**6])
def test_next_document(spark, docs, odd, range_rows):
    """Unique ids, odd rows, one id and the null id in many rows."""
    from pyspark.sql import functions as F

    many = spark.createDataFrame([(7 if i % 2 else None, f"text {i % 30}") for i in range(80)] + [(i, "x") for i in range(-3, 9)], "doc_id long, text string")
    for d in (docs, odd, many):
        rows = [tuple(r) for r in d.select("doc_id", F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
        for most in (4, 10**6):
            got = winnow.next_document(d, winnow.id_bounds(d, len(rows), range_rows, most)).select("doc_id", "text", "next_text").collect()
            assert sorted(map(tuple, got), key=str) == sorted(brute_next(rows), key=str)


def test_ranges_divide_a_hot_id(spark):
    d = spark.createDataFrame([(None, f"text {i}") for i in range(400)] + [(i, "x") for i in range(50)], "doc_id long, text string")
    bounds = winnow.id_bounds(d, 450, 20)
    assert len(bounds) > 15 and sum(i == winnow.NO_ID for i, _ in bounds) > 12


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_run_hashes_are_polynomials(spark, k):
    from pyspark.sql import functions as F

    rows = [(0, "a b c d e f g h i j k"), (1, "a"), (2, ""), (3, "b a"), (4, "c d e f g h i j k l m n o p")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    word = {r[0]: r[1] % winnow.PRIME for r in spark.createDataFrame([(w,) for w in "abcdefghijklmnop"], "w string").select("w", F.xxhash64("w")).collect()}
    got = winnow.add_fingerprint(d, F.col("text"), "fp", k, 1).select("text", F.transform("fp", lambda x: F.shiftright(x, 31)).alias("h"))
    for r in got.collect():
        h = [word[w] for w in r.text.split()]
        runs = [(h[i : i + k] + [0] * k)[:k] for i in range(max(min(1, len(h)), len(h) - k + 1))]
        assert list(r.h) == [sum(x * winnow.BASE ** (k - 1 - j) for j, x in enumerate(run)) % winnow.PRIME for run in runs]


def test_winnow_query(spark, sf, texts):
    got = {r.doc_id: r for r in Q.op9_winnowing_fingerprints(spark, sf).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1
    assert np.mean([r.near_edited for r in got.values()]) > 3 * np.mean([r.near_next for r in got.values()])


def test_winnow_strings_and_likeness(spark, sf, texts):
    """Fingerprint strings and likeness against sets of the winnowed run hashes of both texts."""
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in Q.op9_winnowing_fingerprints(spark, sf).collect()}
    ids = sorted(texts, reverse=True)
    full = {}
    every = spark.createDataFrame([(i, texts[i], texts[ids[(k + 1) % len(ids)]]) for k, i in enumerate(ids)], "doc_id long, text string, nxt string")
    third = F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - third), F.substring("nxt", F.lit(1), third))
    d = winnow.add_fingerprint(winnow.add_fingerprint(every.withColumn("edited", edited), F.col("text"), "a", winnow.K, 1), F.col("edited"), "b", winnow.K, 1)
    for r in d.select("doc_id", *[F.transform(c, lambda x: F.shiftright(x, 31)).alias(c) for c in ("a", "b")]).collect():
        full[r.doc_id] = [(list(h), brute_winnow(list(h), winnow.WINDOW)) for h in (r.a, r.b)]
    like = lambda x, y: 1.0 if not x | y else len(x & y) / len(x | y)
    sets = {i: [{h[j] for j in at} for h, at in v] for i, v in full.items()}
    for k, i in enumerate(ids):
        (h, at), (he, ate) = full[i]
        assert got[i].fingerprint == ",".join(f"{h[j]:X}@{j:X}" for j in at) and got[i].edited_fingerprint == ",".join(f"{he[j]:X}@{j:X}" for j in ate)
        assert got[i].near_edited == pytest.approx(like(*sets[i])) and got[i].near_next == pytest.approx(like(sets[i][0], sets[ids[(k + 1) % len(ids)]][0]))


def test_winnow_short_edited_texts(spark):
    """Texts whose unchanged part holds 8 whole words stay alike; two thirds of 13 words do."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{x:05d}" for x in rng.integers(0, 90_000, 13 + i % 60))) for i in range(240)]
    got = winnow.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 240 and min(r.near_edited for r in got) > 0


def test_winnow_odd(spark, odd, empty):
    got = winnow.fingerprint_documents(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[1] == by[2] == by[3] == "" and by[7] == by[8] != ""
    assert winnow.fingerprint_documents(empty).count() == 0
    null = spark.createDataFrame([(None, "a b c"), (None, "d e f")], "doc_id long, text string")
    assert {r.edited_sha256 for r in winnow.fingerprint_documents(null).collect()} == {hashlib.sha256(t).hexdigest() for t in (b"a b d", b"d e a")}
    pair = winnow.next_document(null, winnow.id_bounds(null, 2)).collect()
    assert {(r.text, r.next_text) for r in pair} == {("a b c", "d e f"), ("d e f", "a b c")}


# --- 10 -----------------------------------------------------------------------------------------


def brute_lm(rows, weights=None):
    tok = lambda t: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(x for i, t in rows if not held(i) for x in tok(t))
    n, v = c.total(), len(c)
    return [(i, held(i), len(tok(t)), sum(c[x] > 0 for x in tok(t)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tok(t))) for i, t in rows]


@pytest.mark.parametrize("block_bytes", [20_000, 10**9])
def test_lm_base(docs, odd, texts, block_bytes):
    for d, rows in ((docs, list(texts.items())), (odd, [(i, t) for i, t, _ in ODD])):
        got = sorted(langmodel.score_documents(d, block_bytes=block_bytes).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
        want = sorted(brute_lm(rows), key=lambda r: (str(r[0]), r[2]))
        assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
        assert [r.base_score for r in got] == pytest.approx([r[5] for r in want])
        assert all(math.isfinite(r.score) for r in got)


def brute_lm_scores(rows, fold_of):
    """Deleted interpolation by its definition, on dictionaries; ``fold_of``: which training rows the weights are learned on."""
    tok = lambda t: [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split(), None]
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]

    def counted(rows_):
        uni, pair, ctx = Counter(), Counter(), Counter()
        for _, t in rows_:
            w = tok(t)
            uni.update(w)
            pair.update(zip([0, *w], w, strict=False))
            ctx.update([0, *w[:-1]])
        ctx[None] = uni[None]
        return uni, pair, ctx

    uni, pair, ctx = counted(train)
    uni_, pair_, ctx_ = counted([r for r in train if not fold_of(r[0])])
    n, v, n_ = uni.total(), len(uni), uni_.total()
    bucket = lambda c: c.bit_length()
    q = lambda a, b: 2 ** (round(langmodel.OCTAVE * math.log2(a / b)) / langmodel.OCTAVE) if a else 0.0
    seen = Counter()
    for i, t in train:
        if fold_of(i):
            w = tok(t)
            for u, x in zip([0, *w], w, strict=False):
                seen[bucket(ctx_[u]), q(pair_[u, x], max(ctx_[u], 1)), q(uni_[x], n_)] += 1
    weights = langmodel.weights_by_bucket(langmodel.expectation_maximisation(np.array([(*k, c) for k, c in seen.items()], dtype=float), 1 / (v + 1)))
    out = {}
    for i, t in rows:
        w, s = tok(t), 0.0
        for u, x in zip([0, *w], w, strict=False):
            a = weights[bucket(ctx[u])]
            s += math.log10(a[0] * pair[u, x] / max(ctx[u], 1) + a[1] * uni[x] / n + a[2] / (v + 1))
        out[i] = s
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 20_000, "slice_bits": 3}, {"block_bytes": 20_000, "slice_bits": 2, "fan": 3, "team": 2}])
def test_lm_scores(spark, docs, texts, options):
    """Scores against the definition, for one block, many blocks, and blocks that add up in teams of teams."""
    from pyspark.sql import functions as F

    ids = [r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(langmodel.FOLD)) == 0).collect()]
    want = brute_lm_scores(list(texts.items()), set(ids).__contains__)
    got = {r.doc_id: r.score for r in langmodel.score_documents(docs, **options).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_lm_totals_beyond_32_bits():
    """Many blocks' counts of a word add up to more than 2**32, and beyond what doubles hold exactly."""
    docs_ = langmodel._table([(b"a a b",)], "text binary").set_column(0, "text", [["a a b"]])
    tok = langmodel.Tokens([b"a a b"])
    for big in (2**32 - 1, 2**53 + 1):
        full = lambda k: np.full(len(k), big, dtype=np.uint64)  # noqa: B023, E731
        rows = []
        for unit in range(3):
            counts = {k: (keys, full(keys), full(keys) * np.uint64(unit == 1)) for k, keys in (("uni", tok.uni[tok.order]), ("pair", tok.pair))}
            rows += langmodel._entries(unit, counts, 0 or 1, 0, 2)
        t = langmodel._table(rows, langmodel._ENTRY)
        import pyarrow as pa

        parts = [langmodel._sum_up(t.filter(np.array(t.column("slice")) == s)) for s in (0, 1) if s in t.column("slice").to_pylist()]
        answers = pa.concat_tables(parts)
        got = langmodel.Block(docs_, answers.filter(np.array(answers.column("unit")) == 0))
        assert set(got.uni.tolist()) == set(got.pair.tolist()) == {3 * big} and set(got.uni_fold.tolist()) == set(got.pair_fold.tolist()) == {big}


def test_lm_is_a_distribution():
    """Over the vocabulary and one unknown word, probabilities after each context sum to 1."""
    texts_ = [b"a b a c", b"b a", b"c c a b"]
    tok = langmodel.Tokens(texts_)
    uni = np.bincount(tok.word, minlength=len(tok.uni)).astype(float)
    uni[0] = len(texts_)
    n, vocab = uni[1:].sum(), [i for i in range(1, len(uni)) if uni[i]]
    a = langmodel.weights_by_bucket({-1: np.array([0.5, 0.3, 0.2])})
    pairs = Counter(zip(tok.before.tolist(), tok.word.tolist(), strict=True))
    for u in {int(x) for x in tok.before}:
        w = a[langmodel.bucket(np.array([uni[u]]))[0]]
        total = sum(w[0] * pairs[u, x] / uni[u] + w[1] * uni[x] / n + w[2] / (len(vocab) + 1) for x in vocab) + w[2] / (len(vocab) + 1)
        assert total == pytest.approx(1.0)


def test_em_finds_the_mixture():
    rng = np.random.default_rng(1)
    p2, p1 = rng.random(4000), rng.random(4000)
    p0, true = 0.01, np.array([0.6, 0.3, 0.1])
    mix = true[0] * p2 + true[1] * p1 + true[2] * p0
    rows = np.stack([np.ones(4000), p2, p1, mix * 1000], axis=1)  # occurrences in proportion to the mixture
    got = langmodel.expectation_maximisation(rows, p0, rounds=300)[1]
    like = lambda a: (rows[:, 3] * np.log(a[0] * p2 + a[1] * p1 + a[2] * p0)).sum()
    assert like(got) >= like(true) - 1e-6 * abs(like(true))


def test_lm_empty(empty):
    assert langmodel.score_documents(empty).count() == 0
