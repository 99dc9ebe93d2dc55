"""BPE encoding and decoding with a distinct-word table (operator 4).

Texts are split into the pre-tokens of the vocabulary's own pattern; each distinct pre-token of the corpus is
encoded once; ids go back to the documents by position (see ``wordtable``). Decoding joins ids with the
id-to-piece table, whose size is that of the vocabulary whatever the corpus, so it is broadcast.

Defined cases: a null text is an empty one; an empty text has no ids; null document ids stay null; repeated
rows give repeated results; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import string
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import wordtable

#: Fixed value: the pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Blocks whose letters and digits are the same in all pattern engines since Unicode 12. Texts with other
#: characters, which newer Unicode versions add to, are split by the tokenizer's library itself.
AGREED = r"\u0000-\u052F\u2000-\u206F\u20A0-\u20BF\u2100-\u218B\u2190-\u23FF\u2500-\u27BF\u3000-\u30FF\u4E00-\u9FEF\uAC00-\uD7A3\uFF01-\uFFBE\U0001F300-\U0001F64F"

MARKS = frozenset(string.punctuation)

#: A space that a pre-token begins with, and one that might not be.
SPACE, LOOSE = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")


class Vocabulary(wordtable.Splitter):
    """A byte-level BPE vocabulary file and the two tables made of it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.words_only = Tokenizer.from_file(path)
        self.own_split = self.words_only.pre_tokenizer
        self.words_only.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words_only.encode_special_tokens = True
        self.words_only.no_truncation(), self.words_only.no_padding()
        self.added = {t.content: i for i, t in self.words_only.get_added_tokens_decoder().items()}
        self.added_at = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.find = regex.compile(PATTERN).findall
        self.kind = "uint16" if self.words_only.get_vocab_size(True) <= 1 << 16 else "uint32"
        self.odd = regex.compile(f"[^{AGREED}]")

    def cut(self, text: str) -> list:
        """Pieces that can be split into pre-tokens one by one: a pre-token always begins at a space that something
        other than white space follows. A piece is the text after such a space; what no space stands before, the
        text's beginning and added tokens, is in a tuple."""
        out: list = []
        for k, p in enumerate(self.added_at.split(text)) if self.added and any(x in text for x in self.added) else [(0, text)]:
            if k % 2:
                out.append((p, True))
            elif p:
                parts = SPACE.split(p) if LOOSE.search(p) else p.split(" ")
                parts[0] = (parts[0], False)
                out += parts
        return out

    def words(self, piece) -> list[str]:
        """The pre-tokens of a piece."""
        if isinstance(piece, tuple):
            text, added = piece
            if added:
                return [text]
        else:
            text = " " + piece
            # most pieces are a word, or one and a mark; letters up to there are the same for all
            if piece.isalpha():
                if max(piece) < "\u0530":
                    return [text]
            elif piece[-1:] in MARKS and piece[:-1].isalpha() and max(piece) < "\u0530":
                return [text[:-1], piece[-1]]
        if not text.isascii() and self.odd.search(text):
            return [text[a:b] for _, (a, b) in self.own_split.pre_tokenize_str(text)]
        return self.find(text)

    def split(self, text: str) -> list[str]:
        return [w for p in self.cut(text) for w in self.words(p)]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids."""
        got = [[self.added[w]] if w in self.added else e.ids for w, e in zip(words, self.words_only.encode_batch_fast(words, add_special_tokens=False))]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return lens, np.fromiter(itertools.chain.from_iterable(got), np.int64, int(lens.sum()))

    @functools.cached_property
    def ids(self) -> Callable[[str], list[int]]:
        """One word to its ids, as ``encode`` gives them: the library's model alone, without what it notes of each word's characters."""
        merge, added = self.words_only.model.tokenize, self.added
        letter = {b: c for c, b in byte_alphabet().items()}
        letters = "".join(letter[b] for b in range(256))
        space = letter[32]

        def ids(word: str) -> list[int]:
            if word in added:
                return [added[word]]
            own = word[1:]
            if word[0] == " " and own.isascii() and own.isalpha():
                return [t.id for t in merge(space + own)]
            return [t.id for t in merge(word.encode().decode("latin-1").translate(letters))]

        return ids

    @functools.cached_property
    def pieces(self) -> list[bytes]:
        """By id: the bytes of each piece, read back through the byte-level alphabet."""
        byte = byte_alphabet()
        out = [b""] * (max(self.words_only.get_vocab(True).values()) + 1)
        for piece, i in self.words_only.get_vocab(True).items():
            out[i] = piece.encode() if piece in self.added else bytes(byte[c] for c in piece)
        return out


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, as characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


Keys = str | Sequence[str]


def _encoded(docs: DataFrame, path: str, keys: Sequence[str], text: str, schema: str, assemble: wordtable.Assemble, block_bytes: int) -> DataFrame:
    return wordtable.apply(docs, keys, text, lambda: vocabulary(path), lambda: vocabulary(path).encode, vocabulary(path).kind, schema, assemble, block_bytes)


def _named(keys: Keys) -> tuple[list[str], str]:
    """Key columns, whole numbers of a document that are carried along, and their part of a schema."""
    names = [keys] if isinstance(keys, str) else list(keys)
    return names, ", ".join(f"`{k}` long" for k in names)


def encode(docs: DataFrame, path: str, id_col: Keys = "doc_id", text: str = "text", block_bytes: int = wordtable.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each document's text."""
    keys, kinds = _named(id_col)

    def assemble(flat: np.ndarray, offsets: np.ndarray, packs: Iterator) -> pa.Table:
        lens = np.diff(offsets)
        columns, out_lens, out_flat = [[] for _ in keys], [], [np.empty(0, np.int32)]
        for own, counts, codes in packs:
            out_flat.append(wordtable.gather(flat, offsets, codes).astype(np.int32))
            ends = np.concatenate([[0], np.cumsum(lens[codes])])
            at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            out_lens += (ends[at[1:]] - ends[at[:-1]]).tolist()
            for column, more in zip(columns, own):
                column += more
        ends = np.concatenate([[0], np.cumsum(out_lens)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out_flat)))
        return pa.table({**{k: pa.array(c, pa.int64()) for k, c in zip(keys, columns)}, "n_tokens": pa.array(out_lens, pa.int64()), "ids": tokens})

    return _encoded(docs, path, keys, text, f"{kinds}, n_tokens long, ids array<int>", assemble, block_bytes)


def round_trip(docs: DataFrame, path: str, id_col: Keys = "doc_id", text: str = "text", block_bytes: int = wordtable.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): hashes of the decimal ids and of the text decoded from them.

    Within a block each distinct word's ids are joined with the id-to-piece table once (ids are dense, so the join is
    a gather by id); the pieces follow the ids into place.
    """
    keys, kinds = _named(id_col)

    def assemble(flat: np.ndarray, offsets: np.ndarray, packs: Iterator) -> pa.Table:
        pieces = vocabulary(path).pieces
        decimals = [str(i) for i in range(len(pieces))]
        lens, ends = np.diff(offsets), offsets.tolist()
        # by word of the block; made when a document first has it
        decimal: list[str | None] = [None] * len(lens)
        decoded: list[bytes | None] = [None] * len(lens)
        columns: list[list] = [[] for _ in keys]
        rows: tuple[list, list, list] = ([], [], [])
        for own_keys, counts, codes in packs:
            for column, more in zip(columns, own_keys):
                column += more
            sums, k = np.concatenate([[0], np.cumsum(lens[codes])]), 0
            for w in np.unique(codes).tolist():
                if decimal[w] is None:
                    ids = flat[ends[w] : ends[w + 1]].tolist()
                    decimal[w], decoded[w] = ",".join([decimals[i] for i in ids]), b"".join([pieces[i] for i in ids])
            for count in counts.tolist():
                own = codes[k : k + count].tolist()
                body = b"".join([decoded[c] for c in own]).decode("utf-8", "replace")
                for column, value in zip(rows, (int(sums[k + count] - sums[k]), hashlib.sha256(",".join([decimal[c] for c in own]).encode()).hexdigest(), hashlib.sha256(body.encode()).hexdigest())):
                    column.append(value)
                k += count
        return pa.table({**{k: pa.array(c, pa.int64()) for k, c in zip(keys, columns)}, "n_tokens": pa.array(rows[0], pa.int64()), "ids_sha256": pa.array(rows[1], pa.string()), "decoded_sha256": pa.array(rows[2], pa.string())})

    return _encoded(docs, path, keys, text, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string", assemble, block_bytes)


def piece_table(spark, path: str) -> DataFrame:
    """(id, piece): one row for each id of the vocabulary."""
    return spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(vocabulary(path).pieces)], "id int, piece binary")


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): ids exploded with their positions, joined with the broadcast piece table, put together in order.

    ``key`` must be unique. A null or empty list decodes to an empty text; an id outside the vocabulary to nothing.
    """
    pieces = F.broadcast(piece_table(tokens.sparkSession, path))  # bounded by the vocabulary
    rows = tokens.select(F.col(key).alias("_key"), F.posexplode_outer(ids).alias("_pos", "id"))
    hexes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.hex("piece").alias("h")))), lambda x: x["h"]), "")
    joined = rows.join(pieces, "id", "left").groupBy("_key").agg(hexes.alias("h"))
    return joined.select(F.col("_key").alias(key), F.decode(F.unhex("h"), "UTF-8").alias("text"))
