"""Token counts of a unigram tokenizer, without the tokens.

An Aho-Corasick automaton of the vocabulary enumerates every piece that ends at each place of a
word. Viterbi's dynamic programme carries, for each place, the best score of a path there and how
many pieces that path has; no path is kept and none is walked back. Tie rules are those of the
tokenizers library's unigram model: the path of a higher score, of equal ones the one whose last
piece is longest; a character without a piece of its own may stand as an unknown one, for the
least score minus ten, and then counts as its UTF-8 bytes (byte fallback).

Words begin at spaces, each with the mark that stands for a space, as the library's Metaspace
splitter has them; a word's count is kept in a cache of bounded size.

Cases: null and empty texts have no tokens and score 0; repeated rows each get a row; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TwoGenerationCache, documents

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


#: Bytes of the cache of words, beside their values; it goes with its task.
CACHE = 96 << 20


class CountingViterbi:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.words = TwoGenerationCache(lambda new: [self.count(MARK + w) for w in new], CACHE)

    def count(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best path through a word."""
        n = len(word)
        score: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        score[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, found in self.automaton.iter(word):
            ends[last + 1].append(found)
        single, unknown = self.single, self.unknown
        for e in range(1, n + 1):
            best, pieces = None, 0
            for length, s in sorted(ends[e], reverse=True):
                s += score[e - length]
                if best is None or s > best:
                    best, pieces = s, count[e - length] + 1
            c = word[e - 1]
            if c not in single:
                s = unknown + score[e - 1]
                if best is None or s > best:
                    best, pieces = s, count[e - 1] + len(c.encode("utf-8", "surrogatepass"))
            score[e], count[e] = best, pieces
        return count[n], score[n]

    def counts(self, texts: list[str]) -> list[tuple[int, float]]:
        """(tokens, score) of texts."""
        split = []
        for t in texts:
            words = t.split(" ")
            split.append(words[1:] if not words[0] else words)
        self.words.fetch(set().union(*split))
        out = []
        for words in split:
            found = [self.words[w] for w in words]
            out.append((sum(c for c, _ in found), sum((s for _, s in found), 0.0)))
        return out


@functools.cache
def load(path: str) -> CountingViterbi:
    return CountingViterbi(vocabulary(path))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, score (of the best paths) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            got = []
            for lo in range(0, b.num_rows, 256):
                got += model.counts(b.column(1).slice(lo, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "n_tokens", "score"])
        model.words.release()

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, score double")
