"""Operator 12: the files byte by byte, damage, and the query against the tokenizer's library."""

import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from larder.llm import bpe, records
from tests.llm.cases import ROWS, no_documents, odd_documents

BPE = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.no_truncation(), t.no_padding()
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def expected(rows):
    """By id, nulls first; rows that repeat an id in any order."""
    start, out = 0, []
    for (doc, _), ids in zip(rows, library([t for _, t in rows])):
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_frame_layout_and_damage():
    record = records.frame(records.body(5, np.array([7, 300, 2], "<u2").tobytes(), 2))
    size, crc = struct.unpack_from("<QI", record)
    assert size == 10 + 6 and len(record) == 8 + 4 + size + 4 and crc == records.masked(zlib.crc32(record[:8]))
    assert struct.unpack("<I", record[-4:])[0] == records.masked(zlib.crc32(record[12:-4]))
    assert records.masked(0) == 0xA282EAD8 and records.masked(0x8000) == 0xA282EAD9
    doc, ids = records.parse(records.unframe(io.BytesIO(record), len(record)))
    assert doc == 5 and ids.tolist() == [7, 300, 2]
    assert records.parse(records.body(None, b"", 4))[0] is None
    for k in range(len(record)):
        hurt = bytearray(record)
        hurt[k] ^= 1
        with pytest.raises(records.Damaged):
            records.parse(records.unframe(io.BytesIO(bytes(hurt))))
        with pytest.raises(records.Damaged):
            records.unframe(io.BytesIO(record[:k]), len(record))
    with pytest.raises(records.Damaged):
        records.unframe(io.BytesIO(record), len(record) - 1)
    assert records.unframe(io.BytesIO(b"")) is None
    for raw in (b"", b"1234567", struct.pack("<qq", 0, 9), struct.pack("<qqq", 0, 5, 5), struct.pack("<qq", 1, 10)):
        with pytest.raises(records.Damaged):
            records.offsets(raw, 1, 10)


def test_a_new_word_goes_to_the_model_alone_and_once(monkeypatch):
    """Its ids are those of the whole library; a piece that was met, lately or before, isn't encoded again."""
    by = bpe.vocabulary(BPE)
    words = [" the", "the", " ", "  \n", "\n", " é", "ção", " ßx", "日本語", " 12345", "...", "'s", "a" * 500, "\x00\x1f\x7f", "\u00a0", " 😀", "don", " Éa" * 90, *by.added]
    lens, ids = by.encode(words)
    assert [by.ids(w) for w in words] == [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])]
    asked, of = [], by.ids
    monkeypatch.setattr(by, "ids", lambda w: asked.append(w) or of(w))
    monkeypatch.setattr(by, "encode", None)
    known = records.Remembered(by, 4)
    first = known.ids("one two one, two. three one")
    assert sorted(asked) == sorted({*asked}) and known.older and not known.recent and not known.older.older
    assert known.ids("one two one, two. three one") == first and len(asked) == len({*asked})


def test_encoding_forgets_and_learns_again():
    r = random.Random(2)
    known = records.Remembered(bpe.vocabulary(BPE), 20)
    for _ in range(40):
        texts = [" ".join(r.choice(["the", "cat", "naïve", "漢字", "<|endoftext|>", "x" * 30, "12", " ", "\n"]) + str(r.randrange(40)) for _ in range(r.randrange(30))) for _ in range(3)]
        got = [np.frombuffer(known.ids(x or ""), "<u2").tolist() + [2] for x in [*texts, None]]
        assert got == library([*texts, None]) and len(known.recent) < 150 and len(known.older) < 150


def test_files_and_reading_in_any_order(spark, tmp_path):
    r = random.Random(4)
    data = [(i * 3 - 50, " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(r.randrange(200))), "x") for i in range(200)]
    r.shuffle(data)
    docs = spark.createDataFrame(data, "doc_id long, text string, part string").repartition(7)
    files = records.write(docs, str(tmp_path), BPE, file_bytes=3000, task_bytes=20_000)
    listed = files.orderBy("part", "seq").collect()
    assert len(listed) > 8 and len({x.part for x in listed}) > 2 and sum(x.records for x in listed) == 200
    assert all(x.bytes < 3000 + 2 * 200 * 2 + 30 for x in listed)
    want = expected(sorted((d, t) for d, t, _ in data))
    assert sorted(map(tuple, records.read(files, str(tmp_path)).collect())) == want
    with_ids = {x.doc_id: x.ids for x in records.read(files, str(tmp_path), ids=True).collect()}
    texts = {d: t for d, t, _ in data}
    assert with_ids == dict(zip(texts, library(texts.values())))
    # files in order hold rising ids; an index leads to any record
    ids = []
    for x in listed:
        forward = [d for d, _ in records.read_at(str(tmp_path), x.file, range(x.records))]
        assert forward == [d for d, _ in records.read_at(str(tmp_path), x.file, reversed(range(x.records)))][::-1]
        ids += forward
    assert ids == sorted(texts)
    # what isn't listed, such as a lost attempt's files, isn't read; what is damaged is told
    (tmp_path / "00000000-000000-lost.rec").write_bytes(b"half a record")
    assert records.read(files, str(tmp_path)).count() == 200
    hurt = tmp_path / f"{listed[0].file}.rec"
    hurt.write_bytes(hurt.read_bytes()[:-1] + b"\0")
    with pytest.raises(Exception, match="Damaged"):
        records.read(files, str(tmp_path)).collect()


def test_starts_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(records, "COARSE", 4)
    r = random.Random(1)
    files = [(p, s, f"f{p}.{s}", 1, r.randrange(1, 99), 1) for p in range(0, 60, 2) for s in range(r.randrange(1, 4))]
    got = {x.file: x.start for x in records.begun(spark.createDataFrame(files, records.FILES)).collect()}
    at = 0
    for p, s, name, _, n, _ in files:
        assert got[name] == at
        at += n


def test_odd_and_empty_documents(spark):
    got = sorted(map(tuple, records.round_trip(odd_documents(spark), BPE).collect()), key=lambda x: x[1])
    order = sorted(((d, t) for d, t, *_ in ROWS), key=lambda x: (x[0] is not None, x[0] or 0))
    assert got == expected(order)
    assert records.round_trip(no_documents(spark), BPE).collect() == []
    # one id holds most of the rows: still dealt out, by texts
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows = records.round_trip(docs, BPE).orderBy("start").collect()
    assert len(rows) == 3000 and [x.doc_id for x in rows] == sorted(x.doc_id for x in docs.collect())
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
