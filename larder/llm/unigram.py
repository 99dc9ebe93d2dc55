"""Token counts by trie-shared dynamic programming (operator 5).

A text's pre-tokens are its runs of characters other than white space, each with the word mark in front. Under a
unigram model a pre-token's tokens are the split into pieces with the greatest sum of log-probabilities (ties: the
fewest tokens). Each distinct pre-token of the corpus is looked at once (see ``wordtable``): they arrive sorted and
go into a trie, and a node's forward score, computed from its ancestors' when the node is made, serves every
pre-token below it; words of one beginning are shuffled to one trie. Terminal nodes give the counts, which are put back by position and added up by document.

The pieces are those of a public vocabulary file; tokenizers are never trained, so the log-probabilities follow
from the published order of pieces by Zipf's law, p(rank) = 1 / (rank * H). A character that no piece covers costs
one byte token for each byte of its UTF-8.

Defined cases: a null or empty text, or one of white space only, has no words and no tokens; repeated rows give
repeated results; null ids stay null; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larder.llm import wordtable

#: Fixed value: the mark that stands for the space before a word.
MARK = "▁"
#: A trie is dropped when it has so many nodes; characters of a word that go into it. What follows in a longer word is
#: shared with few others: its scores are computed on, with as many states as the longest piece needs.
MOST_NODES, SHARED = 400_000, 64


class ByBeginning(wordtable.Splitter):
    """Words of one beginning meet in one bucket, and so in one trie; long words, such as addresses, are dealt out further."""

    def spread(self, word: bytes) -> int:
        return zlib.crc32(word[:3]) + zlib.crc32(word[12:]) % 64


class Unigram:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranked = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        harmonic = math.log(sum(1 / r for r in range(1, len(ranked) + 1)))
        self.pieces = {model.id_to_piece(i): -math.log(r) - harmonic for r, i in enumerate(ranked, 1)}
        self.byte = -math.log(len(ranked) + 1) - harmonic - 1
        # by last character, the lengths of pieces that end so: what a new node has to try
        self.lengths: dict[str, list[int]] = {}
        for p in self.pieces:
            self.lengths.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: sorted(n) for c, n in self.lengths.items()}
        self.longest = max(map(len, self.pieces), default=1)
        self._reset()

    def _reset(self) -> None:
        # a node: (children, score, count)
        self.root: tuple[dict, float, int] = ({}, 0.0, 0)
        self.nodes = 1

    def counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One value a word. Sorted words share the trie's nodes before it is dropped."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out = np.empty(len(words), np.int32)
        for i in order:
            out[i] = self.count(MARK + words[i])
        return np.ones(len(words), np.int64), out

    def count(self, word: str) -> int:
        """Walk or grow the trie along the word's shared part; the last node holds the count of its best split."""
        if self.nodes > MOST_NODES:
            self._reset()
        path, node = [self.root], self.root
        for depth, ch in enumerate(word[:SHARED], 1):
            below = node[0].get(ch)
            if below is None:
                below = node[0][ch] = ({}, *self._best(word, depth, ch, path, 0))
                self.nodes += 1
            node = below
            path.append(node)
        if len(word) <= SHARED:
            return node[2]
        # states of the last positions only; position p is at path[p - before]
        before, most = 0, max(self.longest, 2)
        for depth in range(SHARED + 1, len(word) + 1):
            path.append((None, *self._best(word, depth, word[depth - 1], path, before)))
            if len(path) > 8 * most:
                cut = len(path) - most
                del path[:cut]
                before += cut
        return path[-1][2]

    def _best(self, word: str, depth: int, ch: str, path: list, before: int) -> tuple[float, int]:
        """Score and count of the best split of the word's first ``depth`` characters, the last of which is ``ch``."""
        score, count, pieces = -math.inf, 0, self.pieces
        for n in self.lengths.get(ch, ()):
            if n > depth:
                break
            p = pieces.get(word[depth - n : depth])
            if p is not None:
                last = path[depth - n - before]
                total = last[1] + p
                if total > score or (total == score and last[2] + 1 < count):
                    score, count = total, last[2] + 1
        if ch not in pieces:
            size, last = len(ch.encode("utf-8", "surrogatepass")), path[depth - 1 - before]
            total = last[1] + size * self.byte
            if total > score or (total == score and last[2] + size < count):
                score, count = total, last[2] + size
        return score, count


@functools.lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    return Unigram(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens), a row for each row of ``docs``."""

    def assemble(n: np.ndarray, offsets: np.ndarray, packs: Iterator) -> pa.Table:
        n = n.astype(np.int64)
        ids, words, tokens = [], [], []
        for (some,), lens, codes in packs:
            sums = np.concatenate([[0], np.cumsum(n[codes])])
            ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
            ids += some
            words += lens.tolist()
            tokens += (sums[ends[1:]] - sums[ends[:-1]]).tolist()
        return pa.table({id_col: pa.array(ids, pa.int64()), "n_words": pa.array(words, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())})

    return wordtable.apply(docs, [id_col], text, ByBeginning, lambda: unigram(path).counts, "int32", f"`{id_col}` long, n_words long, n_tokens long", assemble)
