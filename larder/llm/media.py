"""Media columns: MPEG audio (operator 1).

``store`` writes a payload losslessly into an MPEG-1 Layer III stream: an ID3v2 tag, a Xing frame with a table of
contents, then frames of varying bitrate whose side information declares no main data, so that the rest of each
frame is ancillary data that players skip and readers of this module take as payload. Every frame carries the
CRC-16 of its header and side information, and the first frame a CRC-32 of all audio bytes.

``read`` takes any bytes: it skips ID3v2, APE and ID3v1 tags, resynchronises on frame headers (a header counts if
the next frame follows where its length says, or the stream or its closing tags begin there; closing tags don't count
where frames go on and the declared length or the table wants more of them), parses the
variable-bitrate table (Xing, Info or VBRI) and compares its seek points with the frames found, checks the checksums
of all three layers, and gives exact durations (samples over sample rate, not rounded) and the offset of every frame.

Defined cases: null and empty payloads are stored as 64 zero bytes; bytes that hold no frame give zero frames and
an empty payload; a frame with a wrong checksum is counted and kept; a table that is cut short counts as far as it goes
and isn't sound; a declared payload length of over 18 digits counts as none; equal payloads give equal media; repeated
rows give repeated results; null ids stay null; an empty table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import releasing

UNIT = 64
#: Fixed values of the MPEG audio format: kbit/s by (MPEG-1?, layer) and index, Hz by version and index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: What this module writes: MPEG-1 Layer III, 32 kHz, mono, with checksums.
RATE, SIDE, HEAD = 32000, 17, 4


@lru_cache(maxsize=65536)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The format's CRC (x^16 + x^15 + x^2 + 1, high bit first) of all or the first bits; headers repeat, so results are remembered."""
    crc = 0xFFFF
    for i in range(8 * len(data) if bits is None else bits):
        crc ^= (data[i >> 3] >> (7 - i % 8) & 1) << 15
        crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    length: int
    samples: int
    mono: bool
    bound: int  # the subband from which on two channels share their bit allocation

    @property
    def side(self) -> int:
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(maxsize=65536)
def header(four: bytes) -> Header | None:
    """A frame header, or None if these bytes can't be one."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bits, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    kbit, hz, pad = BITRATES[version == 3, layer][bits], RATES[version][rate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12 * kbit * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hz + pad
    bound = 4 * (four[3] >> 4 & 3) + 4 if four[3] >> 6 == 1 else 32
    return Header(version, layer, not four[1] & 1, kbit, hz, length, samples, four[3] >> 6 == 3, bound)


#: Fixed values of the format: bits of each subband's allocation in layer II, as (subbands up to here, bits).
ALLOCATIONS = {
    "a": ((11, 4), (23, 3), (27, 2)),
    "b": ((11, 4), (23, 3), (30, 2)),
    "c": ((2, 4), (8, 3)),
    "d": ((2, 4), (12, 3)),
    "lsf": ((4, 4), (11, 3), (30, 2)),
}


def protected_bits(h: Header, body: bytes) -> int:
    """How many bits after header and checksum the checksum covers: side information, or bit allocation and what selects scale factors."""
    channels = 1 if h.mono else 2
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (channels * min(h.bound, 32) + 32 - min(h.bound, 32))
    each = h.bitrate // channels
    table = "lsf" if h.version != 3 else ("d" if h.rate == 32000 else "c") if each <= 48 else "b" if each >= 96 and h.rate != 48000 else "a"
    at = used = band = 0
    for upto, bits in ALLOCATIONS[table]:
        while band < upto:
            for _ in range(channels if band < h.bound else 1):
                value = int.from_bytes(body[at >> 3 : (at >> 3) + 2].ljust(2, b"\0"), "big") >> (16 - bits - at % 8) & (1 << bits) - 1
                used += (value > 0) * (1 if band < h.bound else channels)
                at += bits
            band += 1
    return at + 2 * used


def _frame_bytes(index: int) -> bytes:
    return bytes([0xFF, 0xFA, index << 4 | 2 << 2, 0xC0])


#: By bitrate index, the frame's length; and what of it is free.
LENGTHS = [0] + [header(_frame_bytes(i)).length for i in range(1, 15)]
ROOM = [n - HEAD - 2 - SIDE for n in LENGTHS]


def _frame(index: int, body: bytes) -> bytes:
    head, side = _frame_bytes(index), bytes(SIDE)
    return b"".join((head, struct.pack(">H", crc16(head[2:] + side)), side, body, bytes(ROOM[index] - len(body))))


def padded(text: bytes) -> bytes:
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def store(payload: bytes) -> bytes:
    """The payload as an MPEG stream. The ID3v2 tag holds the payload's length; the frames' size varies at the end."""
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        index = 14 if left >= ROOM[14] else next(i for i in range(1, 15) if ROOM[i] >= left)
        frames.append(_frame(index, payload[at : at + ROOM[index]]))
        at += ROOM[index]
    audio = b"".join(frames)
    size = LENGTHS[14] + len(audio)
    text = b"\x00larder.payload\x00%d" % len(payload)
    body = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    tag = b"ID3\x03\x00\x00" + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + body
    ends, total, toc = [LENGTHS[14]], LENGTHS[14], bytearray()
    for f in frames:
        total += len(f)
        ends.append(total)
    for percent in range(100):
        toc.append(min(255, 256 * ends[percent * len(frames) // 100] // size))
    info = b"Xing" + struct.pack(">III", 7, len(frames), size) + bytes(toc) + struct.pack(">I", zlib.crc32(audio))
    return b"".join((tag, _frame(14, info), audio))


@dataclass
class Parsed:
    frames: int = 0
    samples: int = 0
    rate: int = 0
    skipped: int = 0
    checked: int = 0
    failed: int = 0
    low: int = 0
    high: int = 0
    tags: list[str] = field(default_factory=list)
    declared: int | None = None
    table: bool = False
    table_ok: bool = False
    seek_ok: bool | None = None
    audio_ok: bool | None = None
    offsets: list[int] = field(default_factory=list)
    payload: bytes = b""

    @property
    def feature(self) -> str:
        return ";".join(f"{k}={v}" for k, v in (("frames", self.frames), ("samples", self.samples), ("rate", self.rate), ("kbit", f"{self.low}-{self.high}"), ("tags", "+".join(self.tags) or "-"), ("vbr", int(self.table_ok)), ("seek", {None: "-", True: 1, False: 0}[self.seek_ok]), ("crc", f"{self.checked - self.failed}/{self.checked}"), ("audio", {None: "-", True: 1, False: 0}[self.audio_ok]), ("skipped", self.skipped)))


def _tags_at_front(data: bytes, out: Parsed) -> int:
    at = 0
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = sum((data[at + 6 + i] & 127) << s for i, s in enumerate((21, 14, 7, 0)))
        body = data[at + 10 : at + 10 + size]
        out.tags.append(f"id3v2.{data[at + 3]}")
        key = b"\x00larder.payload\x00"
        if key in body:
            digits = body.split(key, 1)[1].split(b"\x00", 1)[0]
            out.declared = int(digits) if digits.isdigit() and len(digits) <= 18 else None
        at += 10 + size + (10 if data[at + 5] & 16 else 0)
    return min(at, len(data))


def _ends(data: bytes) -> dict[int, list[str]]:
    """Where the audio may end: at the end of all, or where an ID3v1 or APE tag that closes the stream begins; and those tags."""
    out: dict[int, list[str]] = {len(data): []}
    end, names = len(data), []
    if data[-128:-125] == b"TAG":
        end, names = end - 128, ["id3v1"]
        out[end] = names
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I", data[end - 20 : end - 16])[0], struct.unpack("<I", data[end - 12 : end - 8])[0]
        out[max(0, end - size - (32 if flags >> 31 else 0))] = [*names, "ape"]
    return out


def _number(data: bytes, at: int, size: int = 4) -> int | None:
    """A big-endian number, unless the bytes end before it does."""
    return int.from_bytes(data[at : at + size], "big") if at + size <= len(data) else None


@dataclass
class Table:
    """A variable-bitrate table: how many frames and bytes there are, and seek points (share of the frames, least and
    greatest share of the bytes that it may stand for)."""

    frames: int | None
    size: int | None = None
    seek: list[tuple[float, float, float]] = field(default_factory=list)
    check: int | None = None

    @staticmethod
    def of(frame: bytes, body: bytes) -> Table | None:
        if body[:4] in (b"Xing", b"Info"):
            flags, at, out = _number(body, 4) or 0, 8, Table(None)
            if flags & 1:
                out.frames, at = _number(body, at), at + 4
            if flags & 2:
                out.size, at = _number(body, at), at + 4
            if flags & 4:
                out.seek, at = [(i / 100, (x - 1) / 256, (x + 2) / 256) for i, x in enumerate(body[at : at + 100])], at + 100
            out.check = _number(body, at)
            return out
        if frame[36:40] == b"VBRI":
            out = Table(_number(frame, 50), _number(frame, 46))
            entries, scale, width, each = (_number(frame, at, 2) or 0 for at in (54, 56, 58, 60))
            points = [_number(frame, 62 + i * width, width) for i in range(entries)] if 0 < width <= 4 else []
            if out.frames and out.size and points and None not in points:
                sums = list(itertools.accumulate(x * scale for x in points))
                out.seek = [((i + 1) * each / out.frames, (x - scale) / out.size, (x + scale) / out.size) for i, x in enumerate(sums) if (i + 1) * each < out.frames]
            return out
        return None

    def fits(self, start: int, offsets: list[int]) -> bool | None:
        """Whether every seek point leads to the frame it names; None without any."""
        if not self.seek or not self.size or not offsets:
            return None
        places = ((offsets[min(len(offsets) - 1, int(share * len(offsets)))] - start) / self.size for share, _, _ in self.seek)
        return all(low <= place <= high for place, (_, low, high) in zip(places, self.seek))


def read(data: bytes) -> Parsed:
    out = Parsed()
    at, parts, audio = _tags_at_front(data, out), [], 0
    ends = _ends(data)
    alike = lambda a, b: (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)
    stops = sorted(e for e in ends if e >= at)
    locked: Header | None = None
    table: Table | None = None
    begin, held = at, 0

    def closed(at: int) -> bool:
        """Whether the audio ends here. What looks like closing tags doesn't count while frames go on and the declared length or the table's
        frames say that more is to come: a payload may hold any bytes."""
        if at not in ends or at == len(data):
            return at in ends
        whole = (out.declared is None or held >= out.declared) and (table is None or table.frames in (None, out.frames))
        h = header(data[at : at + 4])
        return whole or h is None or locked is None or not alike(h, locked) or at + h.length > len(data)

    while at + 4 <= len(data) and not closed(at):
        h = header(data[at : at + 4])
        good = h is not None and (after := at + h.length) <= len(data) and (locked is None or alike(h, locked))
        if good and after not in ends and (locked is None or after + 4 <= len(data)):
            follow = header(data[after : after + 4])
            good = follow is not None and alike(h, follow)
        if not good:  # resynchronise: on to the next byte that can begin a header, or to closing tags before it
            to = data.find(b"\xff", at + 1)
            to = min([to if to >= 0 else len(data), *(e for e in stops if e > at)])
            out.skipped += to - at
            at = to
            continue
        frame = data[at:after]
        body = frame[HEAD + 2 * h.protected + (h.side if h.layer == 3 else 0) :]
        if h.protected:
            out.checked += 1
            own = frame[HEAD + 2 :]
            bits = protected_bits(h, own)
            if bits > 8 * len(own) or int.from_bytes(frame[4:6], "big") != crc16(frame[2:4] + own[: (bits + 7) >> 3], 16 + bits):
                out.failed += 1
        found = Table.of(frame, body) if locked is None and h.layer == 3 else None
        if found is not None:
            out.table, table, begin = True, found, at
        else:
            out.offsets.append(at)
            out.frames, out.samples, out.rate = out.frames + 1, out.samples + h.samples, h.rate
            out.low, out.high = min(out.low or h.bitrate, h.bitrate), max(out.high, h.bitrate)
            audio = zlib.crc32(frame, audio)
            parts.append(body)
            held += len(body)
        locked = h
        at = after
    if closed(at):
        out.tags += ends[at]
    else:
        out.skipped += max(0, len(data) - at)
    if table is not None:
        out.table_ok, out.seek_ok = table.frames == out.frames, table.fits(begin, out.offsets)
        if out.declared is not None:
            out.audio_ok = table.check == audio
    joined = b"".join(parts)
    out.payload = joined if out.declared is None else joined[: out.declared]
    return out


def media_column(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8, padded with zero bytes to a multiple of 64, as MPEG audio."""
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, media, held = [], [], [], 0
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                ids.append(doc), sizes.append(len(raw)), media.append(store(padded(raw)))
                held += len(media[-1])
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], schema=schema)
                    ids, sizes, media, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(releasing(run), f"`{id_col}` long, n_bytes long, media binary")


def features(stored: DataFrame, id_col: str = "doc_id", offsets: bool = False) -> DataFrame:
    """(doc_id, n_bytes, payload and media digests, feature, samples, sample_rate) read back from stored bytes.

    The duration is exactly samples / sample_rate seconds. With ``offsets``, also every frame's offset.
    """
    fields = [(id_col, pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("samples", pa.int64()), ("sample_rate", pa.int32())]
    kinds = f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, sample_rate int"
    if offsets:
        fields.append(("frame_offsets", pa.list_(pa.int64())))
        kinds += ", frame_offsets array<long>"
    schema = pa.schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            for doc, size, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                media = media.as_py() or b""
                p = read(media)
                values = (doc, size, len(p.payload), hashlib.sha256(p.payload).hexdigest(), zlib.crc32(p.payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), p.feature, p.samples, p.rate, p.offsets)
                for column, value in zip(rows, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return stored.select(F.col(id_col).cast("long"), "n_bytes", "media").mapInArrow(releasing(run), kinds)
