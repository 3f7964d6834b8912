"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the vocabulary's word mark in front.  Distinct pre-tokens are inserted in a trie; a node
holds the best unigram segmentation of its prefix (score, and number of tokens; fewer tokens win a tie), computed once
from its ancestors when the node is made, so a shared prefix is never segmented twice.  The node where a
pre-token ends gives its count.  A document's count is the sum over its words.

The vocabulary is a public sentencepiece file, named by parameter and read where the task runs.  Pieces of a merge
vocabulary carry ranks, not probabilities: a piece of rank r gets the log-probability ``-ln(r + 2)``.  A
character that no piece covers costs its UTF-8 bytes as byte tokens, each rarer than any piece.

The trie takes the first ``DEEP`` characters of a pre-token; what follows is segmented by the same recursion with only
the last few prefixes in memory (as many as the longest piece has characters), so a text without any space is counted in
memory that doesn't grow with it.  The trie is kept between batches up to ``NODES`` nodes, then begun anew; neither
changes a count.

Null and blank texts have no tokens.  A word's count depends on the word alone: equal words and rows are counted alike, and
of equally likely segmentations the one with fewer tokens counts.  Every input row gives one output row, an empty table
none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

VOCABULARY, MARK, NODES, DEEP = "piece_bpe_32k.model", "▁", 2_000_000, 512


def log_probabilities(path: str) -> dict[str, float]:
    """piece -> log-probability."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    by_rank = sorted(pieces, key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -math.log(r + 2) for r, i in enumerate(by_rank)}


class Trie:
    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.byte = -math.log(len(scores) + 2) - 10.0
        self.begin()

    def begin(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def reached(self, word: str, j: int, before) -> tuple[float, int]:
        """Score and tokens of the best segmentation of the first ``j`` characters; ``before(i)`` gives those of the first i."""
        ch = word[j - 1]
        n = len(ch.encode("utf-8", "surrogatepass"))
        top, fewest = before(j - 1)
        top, fewest = top + n * self.byte, fewest + n
        for i in range(max(0, j - self.longest), j):
            s = self.scores.get(word[i:j])
            if s is not None:
                value, tokens = before(i)
                value, tokens = value + s, tokens + 1
                if value > top or value == top and tokens < fewest:
                    top, fewest = value, tokens
        return top, fewest

    def tokens(self, word: str) -> int:
        """Number of tokens of the best segmentation of ``word``."""
        if len(self.best) > NODES:
            self.begin()
        node, path = 0, [0]
        child, best, count = self.child, self.best, self.count
        for j, ch in enumerate(word[:DEEP], 1):
            below = child.get((node, ch))
            if below is None:
                top, fewest = self.reached(word, j, lambda i: (best[path[i]], count[path[i]]))
                below = child[node, ch] = len(best)
                best.append(top)
                count.append(fewest)
            node = below
            path.append(node)
        if len(word) <= DEEP:
            return count[node]
        ring = self.longest + 1  # prefixes still within reach of a piece
        last = [(0.0, 0)] * ring
        for i in range(max(0, DEEP - self.longest), DEEP + 1):
            last[i % ring] = best[path[i]], count[path[i]]
        for j in range(DEEP + 1, len(word) + 1):
            last[j % ring] = self.reached(word, j, lambda i: last[i % ring])
        return last[len(word) % ring][1]


class Counts(dict):
    """Word -> tokens: the terminal counts."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.trie = Trie(scores)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        n = self.trie.tokens(MARK + word.decode("utf-8", "replace"))
        if len(word) <= DEEP:
            self[word] = n
        return n


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counts = Counts(log_probabilities(public_tokenizers.path(vocabulary)))
        for b in shared.byte_slices(batches, "text"):
            words = [t.split() if t else [] for t in shared.raw_texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(counts.__getitem__, w)) for w in words], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return shared.keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
