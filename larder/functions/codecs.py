"""S-04, S-05: bytes of picture files to pixels and back: PNG of all colour types, and baseline JPEG; null for anything else.

Pictures are as elsewhere grey, or blue, green and red. What follows from the formats' published descriptions: transparency is dropped,
16-bit samples keep their high bytes, fewer bits are widened, interlaced files and JPEG of other processes (progressive,
arithmetic) aren't read. A file that is cut short or damaged (lengths, checksums, codes) gives null, as a reader that gives nothing for
what isn't a picture.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.images import Image

PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff"
#: Samples of a pixel, by PNG's colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pixels of a picture at most: what says it has more is taken for damaged.
MOST_PIXELS = 1 << 28


class Damaged(ValueError):
    """Bytes that aren't a picture of a known kind."""


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(PNG)
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise Damaged("a chunk is cut or damaged")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return
    raise Damaged("the end is missing")


def unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes, the first of each its filter, as they were before filtering: each byte was taken less what its left (``step`` bytes
    before), upper, or both neighbours foretell."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1 + step), np.uint8)  # an empty row above and an empty pixel to the left
    for i, row in enumerate(rows, 1):
        kind, x, up = int(row[0]), row[1:], out[i - 1, step:]
        if kind == 0:
            out[i, step:] = x
        elif kind == 1:  # a running sum for each byte of a pixel
            pad = -len(x) % step
            out[i, step:] = np.cumsum(np.pad(x, (0, pad)).reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(x)]
        elif kind == 2:
            out[i, step:] = x + up
        elif kind in (3, 4):
            for at in range(0, len(x), step):  # each pixel needs the one before
                left, above, corner = out[i, at : at + step].astype(int), out[i - 1, at + step : at + 2 * step].astype(int), out[i - 1, at : at + step].astype(int)
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    far = [np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)]
                    guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
                out[i, at + step : at + 2 * step] = x[at : at + step] + guess
        else:
            raise Damaged("an unknown filter")
    return out[1:, step:]


def decode_png(data: bytes) -> Image:
    head, palette, packed = None, None, []
    for kind, body in png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[3] not in SAMPLES or head[2] not in (1, 2, 4, 8, 16) or any(head[4:]) or not 0 < head[0] * head[1] <= MOST_PIXELS:
        raise Damaged("no header that can be read")
    width, height, bits, colour = head[:4]
    samples = SAMPLES[colour]
    line = (width * samples * bits + 7) // 8
    raw = zlib.decompressobj().decompress(b"".join(packed), height * (line + 1))
    if len(raw) != height * (line + 1):
        raise Damaged("pixels are missing")
    rows = unfiltered(np.frombuffer(raw, np.uint8).reshape(height, line + 1), max(1, samples * bits // 8))
    if bits == 16:
        rows = rows[:, ::2]
    elif bits < 8:
        each = np.unpackbits(rows, axis=1).reshape(height, -1, bits)[:, : width * samples]
        rows = (each @ (1 << np.arange(bits)[::-1])).astype(np.uint8)
        if colour != 3:
            rows = (rows.astype(int) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    pixels = rows.reshape(height, width, samples)
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise Damaged("a colour isn't in the palette")
        return palette[pixels[:, :, 0]][:, :, ::-1].copy()
    return pixels[:, :, 0].copy() if colour in (0, 4) else pixels[:, :, 2::-1].copy()


#: The order in which JPEG writes the places (row by row) of a block of 8 by 8: along diagonals, to and fro.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
_k = np.arange(8)
#: One-dimensional cosine transform: row k is wave k at the 8 places.
WAVES = np.sqrt(np.where(_k[:, None] == 0, 1, 2) / 8) * np.cos((2 * _k[None] + 1) * _k[:, None] * np.pi / 16)


class Bits:
    """Bits of an entropy-coded part, which stuffed zero bytes have been taken out of; zeros after its end, a few."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.value, self.have = data, 0, 0, 0

    def _fill(self, n: int) -> None:
        while self.have < n:
            if self.at > len(self.data) + 8:
                raise Damaged("the picture is cut")
            self.value = self.value << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at, self.have = self.at + 1, self.have + 8
        self.value &= (1 << self.have) - 1

    def take(self, n: int) -> int:
        self._fill(n)
        self.have -= n
        return self.value >> self.have & (1 << n) - 1

    def code(self, table: list[tuple[int, int] | None]) -> int:
        """A symbol, found by the next 16 bits."""
        self._fill(16)
        found = table[self.value >> self.have - 16 & 0xFFFF]
        if found is None:
            raise Damaged("no such code")
        self.have -= found[0]
        return found[1]

    def signed(self, n: int) -> int:
        value = self.take(n) if n else 0
        return value if not n or value >> n - 1 else value - (1 << n) + 1


def code_table(counts: bytes, symbols: bytes) -> list[tuple[int, int] | None]:
    """By 16 bits: (length, symbol). Codes of a length are one after another, and go on, doubled, where the length grows."""
    table: list[tuple[int, int] | None] = []
    at = 0
    for length, count in enumerate(counts, 1):
        for symbol in symbols[at : at + count]:
            table += [(length, symbol)] * (1 << 16 - length)
        at += count
    if len(table) > 1 << 16 or at > len(symbols):
        raise Damaged("a table of codes is too long")
    return table + [None] * ((1 << 16) - len(table))


def decode_jpeg(data: bytes) -> Image:
    at, frame, quant, codes, restart = 2, None, {}, {}, 0
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise Damaged("a marker is missing")
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if len(body) != size - 2:
            raise Damaged("a part is cut")
        if mark == 0xDB:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                quant[n] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(float)
                body = body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                total = sum(body[1:17])
                codes[body[0]] = code_table(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif mark in (0xC0, 0xC1):
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if precision != 8 or n not in (1, 3) or not 0 < width * height <= MOST_PIXELS or any(not (1 <= a <= 4 and 1 <= b <= 4) for _, a, b, _ in frame):
                raise Damaged("a frame of another kind")
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise Damaged("a process that isn't read")
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            break
    if frame is None or body[0] != len(frame):
        raise Damaged("channels in several scans aren't read")
    chosen = {body[1 + 2 * i]: (codes[body[2 + 2 * i] >> 4], codes[16 | body[2 + 2 * i] & 15]) for i in range(body[0])}
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
    across, down = max(f[1] for f in frame), max(f[2] for f in frame)
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    # parts between restart markers; a stuffed zero follows every other byte 255
    scan, parts = data[at:], []
    begin = k = 0
    while True:
        k = scan.find(b"\xff", k)
        if k < 0 or k + 1 >= len(scan):
            raise Damaged("the end is missing")
        if scan[k + 1] == 0:
            k += 2
            continue
        parts.append(scan[begin:k].replace(b"\xff\x00", b"\xff"))
        if not 0xD0 <= scan[k + 1] <= 0xD7:
            break
        begin = k = k + 2
    planes = [np.zeros((rows * v, columns * h, 64)) for _, h, v, _ in frame]
    every = restart or rows * columns
    if len(parts) != -(-rows * columns // every):
        raise Damaged("parts are missing")
    for p, part in enumerate(parts):
        bits, last = Bits(part), [0] * len(frame)
        for unit in range(p * every, min((p + 1) * every, rows * columns)):
            for c, (name, h, v, _) in enumerate(frame):
                means, waves = chosen[name]
                for b in range(h * v):
                    block = planes[c][unit // columns * v + b // h, unit % columns * h + b % h]
                    last[c] += bits.signed(bits.code(means))
                    block[0], i = last[c], 1
                    while i < 64:
                        symbol = bits.code(waves)
                        run, n = symbol >> 4, symbol & 15
                        if not n:
                            if run != 15:
                                break
                            i += 16
                            continue
                        i += run
                        if i > 63:
                            raise Damaged("a block is too long")
                        block[i] = bits.signed(n)
                        i += 1
        if bits.at - (bits.have >> 3) > len(part):
            raise Damaged("the picture is cut")
    channels = []
    for (_, h, v, q), plane in zip(frame, planes):
        blocks = np.zeros_like(plane)
        blocks[..., ZIGZAG] = plane * quant[q]
        spatial = np.einsum("ki,abkl,lj->aibj", WAVES, blocks.reshape(*plane.shape[:2], 8, 8), WAVES, optimize=True) + 128
        flat = np.clip(np.rint(spatial.reshape(plane.shape[0] * 8, plane.shape[1] * 8)), 0, 255)
        # a sample of fewer ones stands for all places it covers
        channels.append(np.repeat(np.repeat(flat, down // v, axis=0), across // h, axis=1)[:height, :width])
    if len(channels) == 1:
        return channels[0].astype(np.uint8)
    y, cb, cr = channels[0], channels[1] - 128, channels[2] - 128
    return np.clip(np.rint(np.stack([y + 1.772 * cb, y - 0.344136 * cb - 0.714136 * cr, y + 1.402 * cr], axis=2)), 0, 255).astype(np.uint8)


def decode(data: bytes | None) -> Image | None:
    """The pixels of a file, or None if it can't be read."""
    data = data or b""
    try:
        return decode_png(data) if data[:8] == PNG else decode_jpeg(data) if data[:3] == JPEG else None
    except (Damaged, zlib.error, struct.error, KeyError, IndexError, ValueError):
        return None


def decoded(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``files`` with height, width and pixels of their contents; nulls for files that can't be read."""
    kept = [c for c in files.columns if c != content]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a picture at a time: they may be large
                image = decode(batch.column(len(kept))[at].as_py())
                shape = image.shape[:2] if image is not None else (None, None)
                own = [batch.column(i).slice(at, 1) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, pa.array([shape[0]], pa.int32()), pa.array([shape[1]], pa.int32()), pa.array([image.tobytes() if image is not None else None], pa.binary())], [*kept, "height", "width", "pixels"])

    rest = files.select(*kept, F.col(content))
    fields = ", ".join(f"`{c}` {rest.schema[c].dataType.simpleString()}" for c in kept)
    return rest.mapInArrow(run, f"{fields}, height int, width int, pixels binary")


def encoded(images: DataFrame, key: str, kept: Sequence[str] = ()) -> DataFrame:
    """(key, kept columns, content): pictures (key, height, width, pixels) as PNG files' bytes; null for what isn't a picture."""
    from larder.functions.images import by_row, encode_png, picture

    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for h, w, pixels in by_row(batch, 1, 2, 3):
                image = picture(h, w, pixels)
                made.append(encode_png(image) if image is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(c) for c in kept), pa.array(made, pa.binary())], ["key", *kept, "content"])

    given = images.select(F.col(key).alias("key"), "height", "width", "pixels", *(c for c in kept if c not in ("height", "width", "pixels")))
    fields = "".join(f", `{c}` {given.schema[c].dataType.simpleString()}" for c in kept)
    return given.mapInArrow(run, f"key {kind}{fields}, content binary")
