"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A token that may be disguised (digits or symbols for letters, separators between letters, letters
repeated, single letters spaced out) becomes a lattice of what each of its characters can stand
for, each reading at a channel cost; Viterbi decoding under a character trigram model finds the
likeliest word.  A token with one path through its lattice stands for itself and is not decoded; so
does a number.  The features of a logistic model are how often the restored words and their prefixes
stand in a text, as steps (so many times at least, such a share of the words at least).

The character model counts every distinct plain word of the labelled training rows once, in
``2**GRAM_BITS`` bins of the hash of a run of characters, so it depends on the rows alone and its size is
bounded for any alphabet.  The logistic model is fitted on at most about ``max_rows`` labelled training
rows, chosen by a hash of the id, which is the documented bound of the fit; of the features those that
tell the classes apart best stay (``max_features``), and the ridge penalty is the one of ``PENALTIES`` under
which folds of these rows predict each other best.  Labels, lang, source and doc_id are no inputs of a
score.

Edge cases: a null or empty text scores what the model's intercept gives; without training rows or
without both classes every score is the share of toxic training rows (0 without any); several
labels of one id count by their mean; ids that repeat are scored row by row.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, Scratch, bounded_broadcast, crc_mod, utf8

#: Labelled rows that the fit may use, and features that it may keep.
MAX_ROWS, MAX_FEATURES = 20_000, 500
#: Steps of a word's or prefix's occurrences, and of its share of a text's words in hundredths.
LEVELS, SHARES = (2, 3, 4, 6), (1, 2, 4)
#: Ridge penalties to choose from, and folds of the training rows that choose.
PENALTIES, FOLDS = (0.03, 0.1, 0.3, 1.0, 3.0), 4
#: Bits of the bins in which runs of characters are counted.
GRAM_BITS = 20
THRESHOLD = 0.7
PREFIXES = range(3, 9)
HEAD = min(PREFIXES)
#: Words that a worker remembers the features of.
CACHE = 200_000

#: Letters that digits and symbols commonly stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l"}
SEPARATORS = ".-_*~^'`,/\\#%&"
COST = {"leet": 1.0, "drop": 1.0, "repeat": 1.0, "break": 1.0}

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Edges that cannot stand for letters.
_PLAIN_EDGE = re.compile(r"^(?:[^\w@$!|+€(£]|_)+|(?:[^\w@$!|+€(£]|_)+$")
#: A character that can be read in more than one way: the lattice has several paths.
_SIGNS = re.compile(r"[0-9@$!|+€(£]|[.\-_*~^'`,/\\#%&]|(.)\1", re.DOTALL)
_THRICE = re.compile(r"(.)\1\1")
#: Digits without a letter are a number, with its currency sign and stops.
_NUMBER = re.compile(r"[$€£+(]?[\d\W]*\d[%€$£+]?!*")
_BROKEN = re.compile(r"(?:[^\W_]|[@$!|+€(£])[.\-_*~^'`,/\\#%&]+(?:[^\W_]|[@$!|+€(£])")


def gram_bin(kind: str, gram: str) -> int:
    return zlib.crc32((kind + gram).encode("utf-8", "replace")) & ((1 << GRAM_BITS) - 1)


def gram_counts(words: Iterable[str]) -> Counter:
    """Bins of the trigrams of ``^^word$`` (3), their last two (2) and last (1) characters, and the contexts of
    both (b, a), with how often each comes; their number in all under -1."""
    grams: Counter = Counter()
    for w in words:
        s = f"^^{w}$"
        grams.update(map("".join, zip(s, s[1:], s[2:])))  # noqa: B905
    out: Counter = Counter()
    for g, n in grams.items():
        for kind, part in (("3", g), ("2", g[1:]), ("1", g[2]), ("b", g[:2]), ("a", g[1])):
            out[gram_bin(kind, part)] += n
        out[-1] += n
    return out


class CharModel:
    """Trigram model of words, interpolated with bigrams, unigrams and a floor."""

    def __init__(self, counts: dict[int, int]):
        self.counts = counts
        self.memo: dict[tuple[str, str], float] = {}

    def _of(self, kind: str, gram: str) -> int:
        return self.counts.get(gram_bin(kind, gram), 0)

    def logp(self, context: str, c: str) -> float:
        got = self.memo.get((context, c))
        if got is None:
            ratio = lambda n, of: n / of if of else 0.0
            p3 = ratio(self._of("3", context + c), self._of("b", context))
            p2 = ratio(self._of("2", context[1] + c), self._of("a", context[1]))
            p1 = ratio(self._of("1", c), self.counts.get(-1, 0))
            got = self.memo[context, c] = math.log(0.7 * p3 + 0.2 * p2 + 0.09 * p1 + 1e-4)
        return got


def lattice(token: str, spaced: bool = False) -> Iterator[list[tuple[str, float]]]:
    """For each run of one character, what it can stand for and the cost of that.  Symbols at the
    edges may also be punctuation, which is dropped at no cost."""
    core = _EDGE.sub("", token)
    first = token.find(core) if core else len(token)
    last = first + len(core)
    for m in re.finditer(r"(.)\1*", token, re.DOTALL):
        c, n = m[1], len(m[0])
        arcs = [(m[0], 0.0)]
        if n > 1:
            arcs += [(c, COST["repeat"])] + [(c * 2, COST["repeat"])] * (n > 2)
        for letter in LEET.get(c, ""):
            arcs += [(letter, COST["leet"] + (n > 1) * COST["repeat"])] + [(letter * 2, COST["leet"])] * (n == 2)
        if core and (m.end() <= first or m.start() >= last):
            arcs.append(("", 0.0))
        elif c in SEPARATORS:
            arcs.append(("", COST["drop"]))
        if spaced:
            arcs += [(" " + s, cost + COST["break"]) for s, cost in arcs]
        yield arcs


def heads_of(token: str) -> set[str]:
    """The first characters, ``HEAD`` of them, of all that a token can be read as; shorter readings whole."""
    out, open_ = set(), {""}
    for arcs in lattice(token):
        longer = {h + emit for h in open_ for emit, _ in arcs}
        out.update(x[:HEAD] for x in longer if len(x) >= HEAD)
        open_ = {x for x in longer if len(x) < HEAD}
        if not open_:
            break
    return out | open_


def _greater(a: tuple, b: tuple) -> bool:
    """Whether the text that ends in node ``a`` is the greater one; the nodes are of one step."""
    x, y = [], []
    while a is not b:
        x.append(a[1])
        y.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(x)) > "".join(reversed(y))


def decode(token: str, model: CharModel, spaced: bool = False) -> str:
    """The likeliest word, or words where ``spaced``, behind a token: Viterbi over its lattice with
    the last two characters as state.  A state's text is a chain of nodes (node before, piece), so
    the time is linear in the token."""
    root: tuple = ()
    states: dict[str, tuple[float, tuple]] = {"^^": (0.0, root)}
    for arcs in lattice(token, spaced):
        new: dict[str, tuple[float, tuple]] = {}
        for ctx, (score, node) in states.items():
            for emit, cost in arcs:
                s, c2 = score - cost, ctx
                for c in emit:
                    if c == " ":
                        if c2 == "^^":
                            s = -math.inf
                        else:
                            s, c2 = s + model.logp(c2, "$"), "^^"
                    else:
                        s, c2 = s + model.logp(c2, c), c2[1] + c
                if s == -math.inf:
                    continue
                old = new.get(c2)
                if old is None or s > old[0] or (s == old[0] and _greater((node, emit), old[1])):
                    new[c2] = (s, (node, emit))
        states = new
    best, end = -math.inf, root
    for ctx, (score, node) in states.items():
        s = score + model.logp(ctx, "$")
        if s > best or (s == best and _greater(node, end)):
            best, end = s, node
    out = []
    while end:
        out.append(end[1])
        end = end[0]
    return "".join(reversed(out))


def decode_token(token: str, model: CharModel) -> str:
    """A token with separators between letters may hold several words."""
    return decode(token, model, spaced=bool(_BROKEN.search(token)))


def restore(word: str, model: CharModel) -> str:
    """A word without edge punctuation, decoded if it can be read in more than one way.  A symbol at an
    edge may be a letter or punctuation, which costs nothing to drop; the character model decides."""
    bare, whole = _EDGE.sub("", word), _PLAIN_EDGE.sub("", word)
    if not _SIGNS.search(whole) or _NUMBER.fullmatch(whole) or (not bare and len(set(whole)) < 2):
        return bare
    return decode_token(whole, model)


#: Word lengths in bytes to 1 where the word can be one letter.
_SHORT = bytes(1 <= n <= 2 for n in range(256))
_RUN = re.compile(rb"\x01{3,}")


def spaced_words(words: list[bytes], model: CharModel) -> list[str]:
    """Words spelled as three or more single letters in a row."""
    try:
        lengths = bytes(map(len, words))
    except ValueError:  # a word of over 255 bytes
        lengths = bytes([min(len(w), 255) for w in words])
    out = []
    for m in _RUN.finditer(lengths.translate(_SHORT)):
        run: list[str] = []
        for w in [*words[m.start() : m.end()], b""]:
            t = w.decode("utf-8", "replace").lower()
            if len(t) == 1 and (t.isalnum() or t in "@$!"):
                run.append(t)
                continue
            if len(run) >= 3 and sum(map(str.isalpha, run)) * 2 > len(run):
                out += decode("".join(run), model, spaced=True).split()
            run = []
    return out


def steps(name, count: int, size: int) -> Iterator:
    """The features that ``count`` occurrences of a word or prefix in a text of ``size`` words have."""
    yield name
    yield from ((name, n, 0) for n in LEVELS if count >= n)
    yield from ((name, 0, n) for n in SHARES if 100 * count >= n * size)


def as_text(feature) -> str:
    return feature if isinstance(feature, str) else f"{feature[0]} #{feature[1]}" if feature[1] else f"{feature[0]} %{feature[2]}"


class Openings(dict):
    """First letters of a word of ASCII letters -> whether the word may matter: it begins as a name does, or a
    letter is doubled, so that it has several readings."""

    def __init__(self, heads: set[str]):
        super().__init__()
        self.heads = heads

    def __missing__(self, p: bytes) -> bool:
        got = self[p] = len(p) < HEAD or any(a == b for a, b in zip(p, p[1:])) or p.decode() in self.heads  # noqa: B905
        return got


class Features(dict):
    """word (bytes) -> the restored words and their prefixes, filled as words come; ``names`` limits them to
    those of a model, and then a word none of whose readings begins as a name does is not decoded."""

    def __init__(self, model: CharModel, names: set[str] | None = None):
        super().__init__()
        self.model, self.names = model, names
        self.heads = None if names is None else {x.removesuffix("*")[:HEAD] for x in names}
        self.openings = None if names is None else Openings(self.heads)

    def _matters(self, token: str) -> bool:
        if self.heads is None:
            return True
        bare = token.rstrip(".,")
        if bare.isalpha() and len(bare) >= HEAD and bare[0] != bare[1] != bare[2]:
            return bare[:HEAD] in self.heads  # the only head: a letter doubled later does not change it
        whole = _PLAIN_EDGE.sub("", token)
        return bool(_BROKEN.search(whole)) or _EDGE.sub("", token)[:HEAD] in self.heads or not self.heads.isdisjoint(heads_of(whole))

    def of(self, word: str) -> tuple:
        out = (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n))
        return out if self.names is None else tuple(x for x in out if x in self.names)

    def __missing__(self, word: bytes) -> tuple:
        if len(self) > CACHE:
            self.clear()
        token = word.decode("utf-8", "replace").lower()
        bare = restore(token, self.model) if self._matters(token) else ""
        got = self[word] = tuple(x for w in bare.split() for x in self.of(w))
        return got

    def document(self, text: bytes) -> set:
        words = text.split()
        count: Counter = Counter()
        distinct = set(words)
        if (may := self.openings) is not None:  # most words, at little cost
            distinct = [w for w in distinct if not (v := w.rstrip(b".,")).isalpha() or may[v[:HEAD].lower()]]
        hits = [w for w in distinct if self[w]]
        times = Counter(words) if len(hits) > 8 else {w: words.count(w) for w in hits}
        for w in hits:
            for f in self[w]:
                count[f] += times[w]
        for w in spaced_words(words, self.model):
            count.update(self.of(w))
        return {x for f, n in count.items() for x in steps(f, n, len(words))}


class Model:
    """A fitted scorer; small, bounded by ``max_features`` and the bins of characters."""

    def __init__(self, counts: dict[int, int], names: list[str], weights: np.ndarray, bias: float):
        self.counts, self.names, self.weights, self.bias = counts, names, weights, bias

    def scorer(self):
        features = Features(CharModel(self.counts), {x.split(" ")[0] for x in self.names})
        weight, bias = dict(zip(self.names, self.weights.tolist(), strict=True)), self.bias

        def score(text: bytes) -> float:
            z = bias + math.fsum(weight.get(as_text(f), 0.0) for f in features.document(text))
            return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))

        return score

    def column(self, text: Column) -> Column:
        """The score as a column; non-deterministic to the planner so that it is evaluated once."""
        model = self
        kept: list = []

        def score(batches: Iterator) -> Iterator:
            if not kept:
                kept.append(model.scorer())
            for texts in batches:
                yield pd.Series([kept[0]((t or "").encode()) for t in texts], dtype="float64")

        import pandas as pd

        score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(score, "double").asNondeterministic()(text)


def train_rows(docs: DataFrame, labels: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, text, toxic) of labelled documents outside the held-out third."""
    per_id = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    per_id = bounded_broadcast(per_id.where(crc_mod(F.col("id"), 3) != 1), broadcast_rows)
    return docs.select(F.col("doc_id").alias("id"), "text").join(per_id, "id")


def char_counts(rows: DataFrame) -> dict[int, int]:
    """``gram_counts`` of the distinct plain words of all rows."""
    import pyarrow as pa

    def words(batches: Iterator) -> Iterator:
        for b in batches:
            seen = set().union(*map(bytes.split, utf8(b.column(0)))) if b.num_rows else ()
            bare = {_EDGE.sub("", w.decode("utf-8", "replace").lower()) for w in seen}
            yield pa.RecordBatch.from_arrays([pa.array([w for w in bare if w.isalpha() and not _THRICE.search(w)], pa.string())], ["word"])

    def bins(batches: Iterator) -> Iterator:
        for b in batches:
            count = gram_counts(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int32()), pa.array(list(count.values()), pa.int64())], ["bin", "n"])

    found = rows.select("text").mapInArrow(words, "word string").distinct().mapInArrow(bins, "bin int, n long")
    t = found.groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # at most the bins
    return dict(sorted(zip(t.column("bin").to_pylist(), t.column("n").to_pylist(), strict=True)))


def pick_features(sample: DataFrame, counts: dict[int, int], n: int, n_toxic: int, max_features: int) -> list[str]:
    """The features that tell the classes apart best: highest z-score of the toxic share."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        features = Features(CharModel(counts))
        for b in batches:
            total, toxic = Counter(), Counter()
            for t, y in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
                f = features.document(t)
                total.update(f)
                if y:
                    toxic.update(f)
            yield pa.RecordBatch.from_arrays([pa.array(list(map(as_text, total)), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([toxic[k] for k in total], pa.int64())], ["f", "n", "k"])

    p = n_toxic / n
    z = (F.col("k") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)) + 1.0)
    found = sample.select("text", "toxic").mapInArrow(run, "f string, n long, k long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    found = found.where((F.col("k") >= 3) & (F.col("k") > F.col("n") * min(0.5, 3 * p))).select("f", z.alias("z")).where("z >= 3")
    return [r.f for r in found.orderBy(F.desc("z"), "f").limit(max_features).collect()]


def fit_logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, l2: float = 0.1, rounds: int = 600) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression of rows that come ``times`` times each, by accelerated gradient
    steps; the bias is not shrunk."""
    n, d = x.shape
    x1 = np.hstack([x, np.ones((n, 1), dtype=x.dtype)])
    shrink = np.append(np.full(d, l2), 0.0)
    v = np.full(d + 1, 1 / math.sqrt(d + 1))
    for _ in range(20):  # largest eigenvalue: the step size
        v = x1.T @ (times * (x1 @ v))
        v /= np.linalg.norm(v) or 1.0
    step = 1 / (0.25 * float(v @ (x1.T @ (times * (x1 @ v)))) + l2)
    w = ahead = np.zeros(d + 1)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ ahead, -30, 30)))
        new = ahead - step * (x1.T @ (times * (p - y)) + shrink * ahead)
        ahead, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def choose_penalty(x: np.ndarray, y: np.ndarray, times: np.ndarray, fold: np.ndarray) -> float:
    """The penalty under which each fold of the training rows is likeliest given the others; the first of equals."""

    def loss(l2: float) -> float:
        out = 0.0
        for k in range(FOLDS):
            own = fold == k
            if own.any() and 0 < y[~own].sum() < (~own).sum():
                w, bias = fit_logistic(x[~own], y[~own], times[~own], l2, 200)
                z = np.clip(x[own] @ w + bias, -30, 30)
                out += float((times[own] * (np.log1p(np.exp(z)) - y[own] * z)).sum())
        return out

    return min(PENALTIES, key=lambda l2: (loss(l2), l2))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, broadcast_rows: int = BROADCAST_ROWS) -> Model:
    import pyarrow as pa

    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(train_rows(docs, labels, broadcast_rows), "train")
    n_all = rows.count()
    counts = char_counts(rows)
    share = min(1.0, max_rows / max(1, n_all))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    n, k = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < k < n:
        share = min(max(k / n if n else 0.0, 1e-9), 1 - 1e-9)
        return Model(counts, [], np.empty(0), math.log(share / (1 - share)))
    # Many candidates stand in the same rows: four times as many are looked at, and one of each kind stays.
    names = pick_features(sample, counts, n, k, 4 * max_features)
    known = {f: i for i, f in enumerate(names)}

    def vectors(batches: Iterator) -> Iterator:
        features = Features(CharModel(counts), {x.split(" ")[0] for x in names})
        for b in batches:
            own = [sorted(i for f in features.document(t) if (i := known.get(as_text(f))) is not None) for t in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(own, pa.list_(pa.int32()))], ["y", "fold", "f"])

    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    got = sample.select("text", "toxic", fold).mapInArrow(vectors, "y int, fold int, f array<int>").toArrow()  # at most about max_rows
    alike = Counter(zip(got.column("y").to_pylist(), got.column("fold").to_pylist(), map(tuple, got.column("f").to_pylist()), strict=True))
    rows_of: dict[int, list[int]] = {i: [] for i in range(len(names))}
    kinds = sorted(alike)
    for r, (_, _, f) in enumerate(kinds):
        for i in f:
            rows_of[i].append(r)
    first = {tuple(v): i for i, v in sorted(rows_of.items(), reverse=True)}
    kept = sorted(first.values())[:max_features]
    place = {i: j for j, i in enumerate(kept)}
    x = np.zeros((len(kinds), len(kept)))
    for r, (_, _, f) in enumerate(kinds):
        x[r, [place[i] for i in f if i in place]] = 1.0
    y, folds = (np.array([k[c] for k in kinds], dtype=np.float64) for c in (0, 1))
    times = np.array([alike[k] for k in kinds], dtype=np.float64)
    weights, bias = fit_logistic(x, y, times, choose_penalty(x, y, times, folds))
    scratch.drop(rows)
    return Model(counts, [names[i] for i in kept], weights, bias)


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, max_rows)
    d = docs.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), model.column(F.col("text")).alias("score"))
    return d.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
