"""Distinct-word tables: do work on a word once, then put the results back by position.

1. Documents are taken in blocks, as the scan deals them out (a block ends at ``block_bytes`` of UTF-8, or with the
   document that passes it). Each block is written, once, as the numbers of its documents' words, packed, and the
   table of its distinct words, numbered by falling frequency and dealt out to hash buckets.
2. Word rows are shuffled by bucket, so that equal words of all blocks meet. Each distinct word is worked on once,
   and the results are written in the words' place.
3. Results and documents meet in a cogroup by block, where numbers are replaced by results.

Only distinct words and packed numbers are shuffled, never one row a word occurrence. A task holds one block, or
one bucket's distinct words; the number of buckets grows with the number of shuffle partitions.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Written, release, releasing

BLOCK_BYTES = 48 << 20
#: Packed numbers (not bytes) in one row.
PACK = 2 << 20
LEAST_BUCKETS, MOST_BUCKETS = 64, 4096
#: Blocks that one task puts together, one after another, however much text there is.
BLOCKS_A_TASK = 2


class Splitter:
    """Text to pieces, cheaply, and a piece to words, once for each distinct piece of a block. By default they are the same."""

    def cut(self, text: str) -> list:
        return text.split()

    def words(self, piece) -> list[str]:
        return [piece]

    def spread(self, word: bytes) -> int:
        """Words of equal hashes meet in one bucket; equal words must have equal ones."""
        return zlib.crc32(word)


Split = Callable[[], Splitter]
#: Words to (how many values each word has, all values one after another).
Work = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def squeeze(raw: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def unsqueeze(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def pack(codes: np.ndarray) -> bytes:
    """Numbers in 7-bit groups, low first; all numbers' first bytes, then all others, are compressed each by itself.
    Frequent words have small numbers."""
    codes = codes.astype(np.uint32)
    long = codes > 127
    first = (codes & 127 | np.where(long, 128, 0)).astype(np.uint8)
    more = codes[long] >> np.uint32(7)
    width = 1 + sum((more >> s > 0).astype(np.int64) for s in (7, 14, 21))
    at = np.cumsum(width) - width
    rest = np.zeros(int(width.sum()), np.uint8)
    for k in range(int(width.max(initial=0))):
        has = np.flatnonzero(width > k)
        rest[at[has] + k] = (more[has] >> np.uint32(7 * k)).astype(np.uint8) & 127 | np.where(width[has] > k + 1, 128, 0).astype(np.uint8)
    head = squeeze(first.tobytes(), 9)
    return len(head).to_bytes(4, "little") + head + squeeze(rest.tobytes(), 9)


def unpack(blob: bytes) -> np.ndarray:
    cut = 4 + int.from_bytes(blob[:4], "little")
    first, rest = np.frombuffer(unsqueeze(blob[4:cut]), np.uint8), np.frombuffer(unsqueeze(blob[cut:]), np.uint8)
    out = (first & 127).astype(np.int64)
    ends = np.flatnonzero(rest < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    width, more = ends - starts + 1, (rest[starts] & 127).astype(np.int64)
    for k in range(1, int(width.max(initial=0))):
        has = np.flatnonzero(width > k)
        more[has] |= (rest[starts[has] + k].astype(np.int64) & 127) << 7 * k
    out[first > 127] |= more << 7
    return out


def gather(flat: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """flat[offsets[i]:offsets[i + 1]] for each i of ``at``, one after another."""
    n = offsets[at + 1] - offsets[at]
    before = np.cumsum(n) - n
    return flat[np.repeat(offsets[at] - before, n) + np.arange(int(n.sum()))]


_BLOCK = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("lids", pa.binary()), ("body", pa.binary())])


def _row(block: int, bucket: int | None, ids: list | None, lens: bytes, lids: bytes | None, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.binary()), pa.array([lids], pa.binary()), pa.array([body], pa.binary())], schema=_BLOCK)


def blocks(docs: DataFrame, keys: Sequence[str], text: str, split: Split, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of two kinds. Without a bucket: some documents' keys, how many words each has, their packed numbers. With
    one: the lengths of words in bytes, their numbers, and the words. ``ids`` has each document's keys side by side."""
    width = len(keys)

    def flush(block: int, by: Splitter, pieces: list, ids: list, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(len(pieces), np.int64)
        for i in range(0, len(rows), 1000):
            times += np.bincount(np.concatenate(rows[i : i + 1000]), minlength=len(pieces))
        # pieces to words, words to numbers by falling frequency; pieces are let go on the way
        seen: dict[str, int] = {}
        codes, lens = array("i"), np.empty(len(pieces), np.int32)
        pieces.reverse()
        for n in range(len(pieces)):
            before = len(codes)
            codes.extend([seen.setdefault(w, len(seen)) for w in by.words(pieces.pop())])
            lens[n] = len(codes) - before
        flat = np.frombuffer(codes, np.int32) if len(codes) else np.empty(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        order = np.argsort(-np.bincount(flat, np.repeat(times, lens), len(seen)), kind="stable").astype(np.int32)
        words = [w.encode("utf-8", "surrogatepass") for w in seen]
        seen.clear()
        lid = np.empty(len(words), np.int32)
        lid[order] = np.arange(len(words), dtype=np.int32)
        flat = lid[flat]
        at = 0
        while at < len(rows):
            end, total, counts, parts = at, 0, [], []
            while end < len(rows) and (end == at or total <= PACK):
                parts.append(gather(flat, offsets, rows[end]) if len(rows[end]) else np.empty(0, np.int32))
                counts.append(len(parts[-1]))
                total, end = total + counts[-1], end + 1
            yield _row(block, None, ids[at * width : end * width], pack(np.array(counts)), None, pack(np.concatenate(parts)))
            at = end
        bucket = np.fromiter((by.spread(w) % buckets for w in words), np.int32, len(words))[order]
        by_bucket = np.argsort(bucket, kind="stable")  # within a bucket, numbers rise
        cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            own = by_bucket[cuts[b] : cuts[b + 1]]
            some = [words[i] for i in order[own]]
            yield _row(block, int(b), None, pack(np.fromiter(map(len, some), np.int64, len(some))), pack(np.diff(own, prepend=0)), squeeze(b"".join(some)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size, by = TaskContext.get().partitionId(), 0, 0, split()
        number: dict = {}
        ids: list = []
        rows: list[np.ndarray] = []

        def done() -> Iterator[pa.RecordBatch]:
            pieces, own, texts = list(number), ids[:], rows[:]
            number.clear(), ids.clear(), rows.clear()
            yield from flush(part << 24 | seq, by, pieces, own, texts)

        for batch in batches:
            texts, sizes = batch.column(width), pc.fill_null(pc.binary_length(batch.column(width)), 0).to_pylist()
            for key, t, n in zip(zip(*(batch.column(i).to_pylist() for i in range(width))), texts, sizes):
                pieces = by.cut(t.as_py() or "")
                rows.append(np.fromiter([number.setdefault(w, len(number)) for w in pieces], np.int32, len(pieces)))
                ids.extend(key)
                size += n + 8
                if size >= block_bytes:
                    yield from done()
                    seq, size = seq + 1, 0
                    release()
        if rows:
            yield from done()

    return docs.select(*[F.col(k).cast("long") for k in keys], F.col(text)).mapInArrow(releasing(run), "block long, bucket int, ids array<long>, lens binary, lids binary, body binary")


class Grown:
    """Numbers one after another in an array whose room doubles, so that adding some costs in proportion to them."""

    def __init__(self, kind, *first) -> None:
        self.room, self.size = np.empty(1024, kind), 0
        self.extend(np.array(first, kind))

    def extend(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self.room):
            room = np.empty(max(end, 2 * len(self.room)), self.room.dtype)
            room[: self.size] = self.all
            self.room = room
        self.room[self.size : end] = more
        self.size = end

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]


def once_a_word(words: DataFrame, work: Callable[[], Work], kind: str) -> DataFrame:
    """(block, lens, lids, body): values in the words' place. ``work()`` gives the function that gets each distinct
    word exactly once; values are numbers of numpy's type ``kind``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do, bucket = work(), None
        known: dict[bytes, int] = {}
        offsets, flat = Grown(np.int64, 0), Grown(kind)
        for batch in batches:
            for block, b, n, lids, body in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if b != bucket:
                    bucket, known, offsets, flat = b, {}, Grown(np.int64, 0), Grown(kind)
                raw, ends = unsqueeze(body), np.cumsum(unpack(n)).tolist()
                ws = [raw[x:y] for x, y in zip([0, *ends], ends)]
                fresh = [w for w in ws if w not in known]
                if fresh:
                    more, values = do([w.decode("utf-8", "surrogatepass") for w in fresh])
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
                    offsets.extend(offsets.all[-1] + np.cumsum(more))
                    flat.extend(values)
                at = np.fromiter((known[w] for w in ws), np.int64, len(ws))
                begin = offsets.all
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([pack(begin[at + 1] - begin[at])], pa.binary()), pa.array([lids], pa.binary()), pa.array([squeeze(gather(flat.all, begin, at).tobytes())], pa.binary())], ["block", "lens", "lids", "body"])
    return words.select("block", "bucket", "lens", "lids", "body").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(releasing(run), "block long, lens binary, lids binary, body binary")


#: (values of all words flat, where each word's begin), and packs of (key columns, numbers of words, words' numbers).
Assemble = Callable[[np.ndarray, np.ndarray, Iterator[tuple[list[list], np.ndarray, np.ndarray]]], pa.Table]


def apply(docs: DataFrame, keys: Sequence[str], text: str, split: Split, work: Callable[[], Work], kind: str, schema: str, assemble: Assemble, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Split, work on each distinct word once, join back by block and position, and ``assemble`` each block's rows."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 2 * partitions))
    stored = Written(blocks(docs, keys, text, split, buckets, block_bytes), "blocks").frame
    values = once_a_word(stored.where("bucket is not null"), work, kind)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(np.cumsum(unpack(lids)), unpack(n), np.frombuffer(unsqueeze(body), kind)) for n, lids, body in zip(*(left.column(c).to_pylist() for c in ("lens", "lids", "body")))]
        size = 1 + max((int(at[-1]) for at, _, _ in parts), default=-1)
        lens = np.zeros(size, np.int64)
        for at, n, _ in parts:
            lens[at] = n
        offsets = np.concatenate([[0], np.cumsum(lens)])
        flat = np.empty(int(offsets[-1]), kind)
        for at, n, own in parts:
            flat[np.repeat(offsets[at] - (np.cumsum(n) - n), n) + np.arange(len(own))] = own

        def packs():
            for ids, n, codes in zip(*(right.column(c).to_pylist() for c in ("ids", "lens", "body"))):
                yield [ids[j :: len(keys)] for j in range(len(keys))], unpack(n), unpack(codes)

        made = assemble(flat, offsets, packs())
        parts = flat = offsets = left = right = None
        release()
        return made

    texts = stored.where("bucket is null").select("block", "ids", "lens", "body")
    tasks = max(partitions, -(-texts.agg(F.count_distinct("block")).first()[0] // BLOCKS_A_TASK))
    return values.repartition(tasks, "block").groupBy("block").cogroup(texts.repartition(tasks, "block").groupBy("block")).applyInArrow(run, schema)
