"""Token counts under a unigram model, by trie-shared dynamic programming.

The distinct pre-tokens (words with the word-start sign before them) of a batch form a trie.  A
walk over it carries, for the prefix at each depth, the best score of a segmentation into pieces
and that segmentation's length; a prefix that many pre-tokens share is scored once, and a
terminal's length is stored as the pre-token's count.  A document's count is the sum of its
pre-tokens' stored counts.

The vocabulary is a public one; a piece's score is the logarithm of a Zipf law of its place in the
file.  A character that no piece covers falls back to its UTF-8 bytes.  Of segmentations with equal
scores the shorter counts.

Edge cases: a null or blank text has no token; a pre-token of any length is scored whole; ids that
repeat are counted row by row.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import utf8

WORD_START = "▁"
#: Pre-tokens whose counts a worker remembers from batch to batch, and the longest of them in bytes.
CACHE, LONGEST = 400_000, 64


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Unigram:
    """Pieces with log probabilities, and the price of a byte."""

    def __init__(self, pieces: list[str]):
        h = sum(1 / (i + 1) for i in range(len(pieces) + 256))
        self.score = {p: -math.log((i + 1) * h) for i, p in enumerate(pieces)}
        self.byte = -math.log((len(pieces) + 256) * h)
        self.longest = max(map(len, pieces), default=1)

    @classmethod
    def load(cls, path: str) -> Unigram:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        return cls([sp.id_to_piece(i) for i in plain])

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of each distinct word.  In sorted order a word's common prefix with the one before
        is the path they share in the trie, and the stacks hold the scores along the path."""
        score, longest, byte = self.score, self.longest, self.byte
        best, length, before, out = [0.0], [0], "", {}
        for word in sorted(set(words)):
            n = 0
            for a, b in zip(before, word):  # noqa: B905
                if a != b:
                    break
                n += 1
            del best[n + 1 :], length[n + 1 :]
            for end in range(n + 1, len(word) + 1):
                top, size = -math.inf, 0
                for start in range(end - 1, max(-1, end - 1 - longest), -1):
                    s = score.get(word[start:end])
                    if s is not None and ((t := best[start] + s) > top or t == top and length[start] + 1 < size):
                        top, size = t, length[start] + 1
                if word[end - 1] not in score:
                    extra = len(word[end - 1].encode("utf-8", "surrogatepass"))
                    if (t := best[end - 1] + extra * byte) > top:
                        top, size = t, length[end - 1] + extra
                best.append(top)
                length.append(size)
            out[word] = length[-1]
            before = word
        return out


@lru_cache(maxsize=1)
def worker_state(path: str) -> tuple[Unigram, dict[bytes, int]]:
    """A worker's vocabulary and remembered counts, kept from task to task."""
    return Unigram.load(path), {}


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens."""
    import pyarrow as pa

    path = path or vocabulary_path()

    def run(batches: Iterator) -> Iterator:
        model, known = worker_state(path)
        for b in batches:
            texts = [t.split() for t in utf8(b.column(1))]
            new = set().union(*texts).difference(known)
            if len(known) + len(new) > CACHE:
                known.clear()
                new = set().union(*texts)
            names = {WORD_START + w.decode("utf-8", "replace"): w for w in new}
            known.update((names[k], n) for k, n in model.counts(names).items())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(map(known.__getitem__, t)) for t in texts], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"]
            )
            for w in [w for w in new if len(w) > LONGEST]:
                del known[w]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
