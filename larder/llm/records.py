"""Token ids as length-delimited binary records with an offset index (operator 12).

Format. A data file (``.rec``) is nothing but records, one after another:

    length of the body       8 bytes, little-endian
    masked CRC-32 of length  4 bytes
    body                     a byte of flags (1: no document id), a byte for the bytes of one token id (2 or 4), the
                             document id (8 bytes), then the token ids, all little-endian
    masked CRC-32 of body    4 bytes

A checksum is masked by turning it right by 15 bits and adding 0xA282EAD8, so that checksums of bytes that hold
checksums stay sound. Beside each data file lies an index (``.idx``): the offset of every record and the end of the
last, 8 bytes each. A loader reads the index and then any record by itself (``read_at``), which is what a shuffled
epoch does.

``write`` deals documents out by ranges of their ids, so that one shuffle moves the texts once; each task encodes its
texts in order (a text's pieces are looked up among those the worker has met lately; others go to the tokenizer's library) and writes files of a bounded size under names of its own attempt. What was
written is listed in a Parquet table, one row a file. Spark commits one attempt of each task to that table, so files of
lost or repeated attempts are never read. ``read`` opens the listed files, checks every record, and gives the running number
of ids by sums of files' counts. Files are reached by ``pyarrow.fs``, in whatever store the path names.

Defined cases: a null text is an empty one and gets the end id alone; null document ids come first, equal ids in the order of their
texts' hashes (repeated rows each have a record); a text of any length is one record; a damaged length, checksum or index
raises ``Damaged``; an empty table gives no files and no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import functools
import gc
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm import bpe
from larder.llm.common import Written, releasing, shared_dir

#: Bytes of text that a task gets, about; a data file ends with the record that passes FILE_BYTES.
TASK_BYTES, FILE_BYTES = 64 << 20, 64 << 20
#: Pieces that are met before a worker forgets others.
REMEMBERED = 500_000
#: Parts summed in one group; files that one task reads, one after another, in large tables.
COARSE, FILES_A_TASK = 1024, 8
END = 2
FILES = "part int, seq int, file string, records long, tokens long, bytes long"


class Damaged(ValueError):
    """Bytes that aren't what was written."""


def masked(crc: int) -> int:
    return (crc >> 15 | crc << 17) + 0xA282EAD8 & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    size = struct.pack("<Q", len(body))
    return b"".join((size, struct.pack("<I", masked(zlib.crc32(size))), body, struct.pack("<I", masked(zlib.crc32(body)))))


def unframe(source: BinaryIO, length: int | None = None) -> bytes | None:
    """The next record's body; None at the end. ``length`` is the whole record's, if an index tells it."""
    head = source.read(12)
    if not head and length is None:
        return None
    if len(head) < 12 or masked(zlib.crc32(head[:8])) != int.from_bytes(head[8:], "little"):
        raise Damaged("a record's length is damaged")
    size = int.from_bytes(head[:8], "little")
    if length is not None and length != size + 16:
        raise Damaged("the index doesn't fit the records")
    rest = source.read(size + 4)
    if len(rest) < size + 4 or masked(zlib.crc32(rest[:size])) != int.from_bytes(rest[size:], "little"):
        raise Damaged("a record's body is damaged")
    return rest[:size]


def body(doc: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<BBq", doc is None, width, doc or 0) + ids


def parse(record: bytes) -> tuple[int | None, np.ndarray]:
    """(document id, token ids as 32-bit numbers)."""
    none, width, doc = struct.unpack_from("<BBq", record)
    if none > 1 or width not in (2, 4) or (len(record) - 10) % width:
        raise Damaged("a record's body isn't a document's")
    return None if none else doc, np.frombuffer(record, f"<u{width}", offset=10).astype("<u4")


def offsets(raw: bytes, records: int, size: int) -> np.ndarray:
    """An index file's offsets, if they are of so many records and bytes."""
    at = np.frombuffer(raw[: len(raw) // 8 * 8], "<i8")
    if len(raw) != 8 * (records + 1) or at[-1] != size or at[0] or (np.diff(at) <= 0).any():
        raise Damaged("an index is damaged")
    return at


class Remembered:
    """Pieces of text to the bytes of their ids; a new one is encoded when it is asked for. It lives as long as the worker: when ``most`` pieces have
    been met, those that weren't met since the last time are forgotten."""

    def __init__(self, by: bpe.Vocabulary, most: int) -> None:
        self.by, self.most, self.width = by, most, np.dtype(by.kind).itemsize
        self.older: dict = {}
        self.recent = Met(self)

    def ids(self, text: str) -> bytes:
        found = b"".join(map(self.recent.__getitem__, self.by.cut(text)))
        if len(self.recent) > self.most:
            self.older = self.recent
            self.older.older, self.recent = {}, Met(self)
        return found


class Met(dict):
    """The pieces met lately. What it lacks it takes from the older ones, or encodes."""

    def __init__(self, whole: Remembered) -> None:
        self.older, self.by, self.ids, self.kind = whole.older, whole.by, whole.by.ids, f"<u{whole.width}"
        self.code = {2: "H", 4: "I"}[whole.width] if sys.byteorder == "little" else ""

    def __missing__(self, piece) -> bytes:
        raw = self.older.get(piece)
        if raw is None:
            if isinstance(piece, str) and piece.isascii() and piece.isalpha():  # most are a word
                raw = self._encoded(" " + piece)
            else:
                words = self.by.words(piece)
                # a word is a piece too, so that one with a mark behind it needs only the mark
                parts = [piece if isinstance(piece, tuple) and piece[1] else w[1:] if w[0] == " " < w else (w, False) for w in words]
                raw = self._encoded(words[0]) if parts == [piece] else b"".join([self[x] for x in parts])
        self[piece] = raw
        return raw

    def _encoded(self, word: str) -> bytes:
        ids = self.ids(word)
        return array(self.code, ids).tobytes() if self.code else np.array(ids, self.kind).tobytes()


@functools.lru_cache(maxsize=1)
def remembered(vocabulary: str) -> Remembered:
    return Remembered(bpe.vocabulary(vocabulary), REMEMBERED)


def acyclic(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run`` without the search for cycles, which goes through all pieces that are remembered again and again and finds none."""

    @functools.wraps(run)
    def task(batches: Iterable) -> Iterator:
        on = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if on:
                gc.enable()

    return task


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path.split("/", 1)[0] else f"file://{path}")


def write(docs: DataFrame, path: str, vocabulary: str, end: int = END, id_col: str = "doc_id", text: str = "text", task_bytes: int = TASK_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``docs`` under ``path``, a folder that all executors reach; the table of files (see ``FILES``), which is already written.

    In the order of part and seq, files hold the documents by rising id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    # at small sizes, as many tasks as a shuffle has, of a megabyte at least
    tasks = max(1, -(-size // task_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 20))
    ordered = rows.repartitionByRange(int(tasks), F.asc_nulls_first("doc"), "h").sortWithinPartitions(F.asc_nulls_first("doc"), "h").select("doc", "text")
    run_id = uuid.uuid4().hex[:8]

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, (store, folder) = TaskContext.get(), _store(path)
        known = remembered(vocabulary)
        width = np.dtype(known.by.kind).itemsize
        last = int(end).to_bytes(width, "little")
        seq, name, out, at, tokens = 0, "", None, array("q"), 0

        def done() -> pa.RecordBatch:
            out.close()
            with store.open_output_stream(f"{folder}/{name}.idx") as index:
                index.write(np.frombuffer(at, np.int64).astype("<i8").tobytes())
            row = (task.partitionId(), seq, name, len(at) - 1, tokens, at[-1])
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["part", "seq", "file", "records", "tokens", "bytes"])

        store.create_dir(folder, recursive=True)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = known.ids(text.as_py() or "") + last
                if out is None:
                    name, at, tokens = f"{task.partitionId():08d}-{seq:06d}-{run_id}-{task.taskAttemptId()}", array("q", [0]), 0
                    out = store.open_output_stream(f"{folder}/{name}.rec", buffer_size=1 << 20)
                record = frame(body(doc, ids, width))
                out.write(record)
                at.append(at[-1] + len(record))
                tokens += len(ids) // width
                if at[-1] >= file_bytes:
                    yield done()
                    seq, out = seq + 1, None
        if out is not None:
            yield done()

    return Written(ordered.mapInArrow(releasing(acyclic(save)), FILES), "files").frame


def begun(files: DataFrame) -> DataFrame:
    """``files`` with ``start``: how many ids the files before each hold. Sums of parts, by group of parts first, so that no task
    gets a row of every file."""
    files = files.withColumn("coarse", F.expr(f"part div {COARSE}"))
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    groups = files.groupBy("coarse").agg(F.sum("tokens").alias("tokens"))
    groups = groups.select("coarse", before(Window.orderBy("coarse")).alias("_before"))
    within = files.withColumn("_within", before(Window.partitionBy("coarse").orderBy("part", "seq")))
    return within.join(groups, "coarse").withColumn("start", F.col("_before") + F.col("_within")).drop("coarse", "_before", "_within")


def read(files: DataFrame, path: str, id_col: str = "doc_id", ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each record of the listed files, and with ``ids`` the ids; every record is checked."""
    kinds = [(id_col, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if ids else [])]
    schema = pa.schema(kinds)

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        columns: list[list] = [[] for _ in kinds]
        for batch in batches:
            for name, records, size, tokens, start in zip(*(batch.column(i).to_pylist() for i in range(5))):
                with store.open_input_stream(f"{folder}/{name}.idx") as index:
                    lengths = np.diff(offsets(index.read(), records, size)).tolist()
                first, held = start, 0
                with store.open_input_stream(f"{folder}/{name}.rec", buffer_size=1 << 20) as source:
                    for length in lengths:
                        doc, own = parse(unframe(source, length))
                        for column, value in zip(columns, (doc, start, len(own), zlib.crc32(own.tobytes()), own.astype(np.int64) if ids else None)):
                            column.append(value)
                        start, held = start + len(own), held + len(own) * ids
                        if held > 1 << 20 or len(columns[0]) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
                            columns, held = [[] for _ in kinds], 0
                    if source.read(1) or start - first != tokens:
                        raise Damaged("a file holds more than its index")
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    listed = begun(files).select("file", "records", "bytes", "tokens", "start")
    count, partitions = files.count(), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of its own: the list is small, what it names isn't, so tasks mustn't be put together by the list's size
    shuffled = listed.repartition(max(1, min(count, max(partitions, -(-count // FILES_A_TASK)))), "file")
    return shuffled.mapInArrow(releasing(load), f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else ""))


def read_at(path: str, name: str, places: Iterable[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids) of a file's records in any order, each found by the index: for loaders without Spark."""
    store, folder = _store(path)
    with store.open_input_stream(f"{folder}/{name}.idx") as index:
        at = np.frombuffer(index.read(), "<i8")
    with store.open_input_file(f"{folder}/{name}.rec") as source:
        for k in places:
            source.seek(int(at[k]))
            yield parse(unframe(source, int(at[k + 1] - at[k])))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder among the shared ones that goes when the application ends."""
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    store.deleteOnExit(folder)
    return path


def round_trip(docs: DataFrame, vocabulary: str, end: int = END, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the documents' ids to files in a shared scratch folder and read them back."""
    path = scratch_folder(docs.sparkSession)
    return read(write(docs, path, vocabulary, end, id_col, text), path, id_col)
