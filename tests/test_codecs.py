"""Picture files against pictures: PNG written with every filter, and JPEG made by a plain writer."""

import random
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from larder.functions import codecs as C
from larder.functions import images


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(rows, width, bits, colour, step, filters, palette=None, cut=3):
    """Rows of packed bytes, filtered in turn by ``filters``."""
    out, above = b"", bytes(len(rows[0]))
    for n, row in enumerate(rows):
        kind, made = filters[n % len(filters)], bytearray()
        for i, x in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            nearest = min(((abs(p - v), k, v) for k, v in enumerate((a, b, c))))[2]
            made.append(x - (0, a, b, (a + b) // 2, nearest)[kind] & 255)
        out, above = out + bytes([kind]) + bytes(made), row
    packed = zlib.compress(out)
    size = max(1, len(packed) // cut)
    parts = b"".join(chunk(b"IDAT", packed[i : i + size]) for i in range(0, len(packed), size))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), bits, colour, 0, 0, 0))
    return C.PNG + head + chunk(b"tEXt", b"x") + (chunk(b"PLTE", palette) if palette else b"") + parts + chunk(b"IEND", b"")


def test_png_of_every_kind():
    r = np.random.default_rng(1)
    for colour, samples in C.SAMPLES.items():
        for bits in (1, 2, 4, 8, 16):
            if bits < 8 and colour not in (0, 3) or bits == 16 and colour == 3:
                continue
            h, w = 11, 13
            values = r.integers(0, 1 << bits, (h, w, samples))
            packed = np.unpackbits(values.astype(">u2").view(np.uint8).reshape(h, w * samples, 2), axis=2)[:, :, 16 - bits :].reshape(h, -1)
            rows = [np.packbits(x).tobytes() for x in packed]
            palette = r.integers(0, 256, (1 << min(bits, 8), 3)).astype(np.uint8)
            file = png(rows, w, bits, colour, max(1, samples * bits // 8), (0, 1, 2, 3, 4, 4, 3), palette.tobytes() if colour == 3 else None)
            got = C.decode(file)
            if colour == 3:
                want = palette[values[:, :, 0]][:, :, ::-1]
            else:
                wide = values >> 8 if bits == 16 else values * 255 // ((1 << bits) - 1)
                want = wide[:, :, 0] if colour in (0, 4) else wide[:, :, 2::-1]
            assert np.array_equal(got, want), (colour, bits)


def test_damaged_files_give_nothing():
    image = np.arange(600, dtype=np.uint8).reshape(20, 30)
    file, r = images.encode_png(image), random.Random(2)
    assert np.array_equal(C.decode(file), image)
    for k in range(0, len(file) - 1, 3):
        assert C.decode(file[:k]) is None
    for _ in range(200):
        hurt = bytearray(file)
        hurt[r.randrange(len(file))] ^= 1 << r.randrange(8)
        assert C.decode(bytes(hurt)) is None
    assert C.decode(None) is C.decode(b"") is C.decode(b"GIF89a") is C.decode(C.JPEG) is C.decode(C.PNG) is None
    huge = C.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 2**31, 2**31, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"0")) + chunk(b"IEND", b"")
    assert C.decode(huge) is None


def jpeg(planes, factors, quant=1, restart=0, width=0, height=0):
    """A plain baseline writer: planes of channels, each (values, factors across and down), all codes eight bits long."""
    order = []
    y = x = 0
    for _ in range(64):  # the diagonal walk, step by step
        order.append(8 * y + x)
        if (x + y) % 2 == 0:
            y, x = (y + 1, x) if x == 7 else (max(y - 1, 0), x + 1)
        else:
            y, x = (y, x + 1) if y == 7 else (y + 1, max(x - 1, 0))
    dc, ac = list(range(12)), [run << 4 | n for run in range(16) for n in range(11) if n or run in (0, 15)]
    table = lambda kind, symbols: bytes([kind, *([0] * 8), len(symbols), *([0] * 7)]) + bytes(symbols)  # noqa: E731  nine bits
    part = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    bits, out, last = [], b"", [0] * len(planes)

    def put(value, n):
        bits.extend(value >> i & 1 for i in range(n - 1, -1, -1))

    def number(v):
        n = abs(int(v)).bit_length()
        return n, (int(v) if v >= 0 else int(v) + (1 << n) - 1)

    def flush():
        while len(bits) % 8:
            bits.append(1)
        raw = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
        bits.clear()
        return raw

    basis = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * i + 1) * k * np.pi / 16) for i in range(8)] for k in range(8)])
    across, down = max(f[0] for f in factors), max(f[1] for f in factors)
    columns, rows, done = -(-width // (8 * across)), -(-height // (8 * down)), 0
    for unit in range(rows * columns):
        if restart and unit and unit % restart == 0:
            out += flush() + b"\xff" + bytes([0xD0 + done % 8])
            done, last = done + 1, [0] * len(planes)
        for c, (plane, (h, v)) in enumerate(zip(planes, factors)):
            for b in range(h * v):
                by, bx = (unit // columns * v + b // h) * 8, (unit % columns * h + b % h) * 8
                block = np.rint(basis @ (plane[by : by + 8, bx : bx + 8] - 128.0) @ basis.T / quant).astype(int).ravel()[order]
                n, code = number(block[0] - last[c])
                last[c] = block[0]
                put(dc.index(n), 9), put(code, n)
                zeros = 0
                for k in range(1, 64):
                    if block[k] == 0:
                        zeros += 1
                        continue
                    while zeros > 15:
                        put(ac.index(0xF0), 9)
                        zeros -= 16
                    n, code = number(block[k])
                    put(ac.index(zeros << 4 | n), 9), put(code, n)
                    zeros = 0
                if zeros:
                    put(ac.index(0), 9)
    out += flush()
    frame = struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors))
    scan = bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + b"\0\x3f\0"
    return b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xDB, b"\0" + bytes([quant] * 64)) + part(0xC0, frame) + part(0xC4, table(0, dc) + table(16, ac)) + (part(0xDD, struct.pack(">H", restart)) if restart else b"") + part(0xDA, scan) + out + b"\xff\xd9"


def smooth(h, w, seed):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    return np.clip(128 + 60 * np.sin(x / 7 + seed) + 50 * np.cos(y / 5) + r.normal(0, 4, (h, w)), 0, 255).round()


def test_jpeg_gray_and_colours():
    plane = smooth(40, 56, 1)
    for restart in (0, 1, 4):
        got = C.decode(jpeg([plane], [(1, 1)], 1, restart, 50, 37))
        assert got.shape == (37, 50) and np.abs(got - plane[:37, :50]).max() <= 2
    # coarser steps lose more, but no more than they may
    assert np.abs(C.decode(jpeg([plane], [(1, 1)], 16, 0, 50, 37)).astype(int) - plane[:37, :50]).mean() < 8
    y, cb, cr = smooth(32, 48, 2), np.full((16, 24), 90.0), np.full((16, 24), 170.0)
    cb[:, 12:], cr[8:] = 150.0, 110.0
    got = C.decode(jpeg([y, cb, cr], [(2, 2), (1, 1), (1, 1)], 1, 2, 45, 30)).astype(float)
    b, r = np.kron(cb, np.ones((2, 2))) - 128, np.kron(cr, np.ones((2, 2))) - 128
    want = np.clip(np.stack([y + 1.772 * b, y - 0.344136 * b - 0.714136 * r, y + 1.402 * r], axis=2), 0, 255)[:30, :45]
    assert got.shape == (30, 45, 3) and np.abs(got - want).max() <= 5
    file = jpeg([plane], [(1, 1)], 1, 4, 50, 37)
    for k in range(0, len(file) - 2, 7):
        assert C.decode(file[:k]) is None
    assert C.decode(file.replace(b"\xff\xc0", b"\xff\xc2")) is None  # another process
    r = random.Random(1)
    for _ in range(300):  # damage is told, or gives other pixels, but never fails
        hurt = bytearray(file)
        hurt[r.randrange(len(file))] ^= 1 << r.randrange(8)
        C.decode(bytes(hurt))


def test_files_to_pixels_and_back(spark, tiny, tmp_path):
    from larder.plans import extras
    from larder.sources import presets

    made = extras.pictures(spark, tiny).select("p_partkey", "height", "width", "pixels")
    files = C.encoded(made, "p_partkey")
    for r in files.collect():
        (tmp_path / f"{r['key']}.png").write_bytes(r["content"])
    (tmp_path / "90.jpg").write_bytes(jpeg([smooth(16, 16, 3)], [(1, 1)], 1, 0, 16, 16))
    (tmp_path / "91.png").write_bytes((tmp_path / "1.png").read_bytes()[:-20])
    (tmp_path / "92.txt").write_bytes(b"no picture")
    read = C.decoded(presets.read_images(spark, str(tmp_path)), "path").withColumn("k", F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long"))
    got = {r["k"]: (r["height"], r["width"], r["pixels"]) for r in read.collect()}
    want = {r["p_partkey"]: (r["height"], r["width"], r["pixels"]) for r in made.collect()}
    assert {k: got[k] for k in want} == want
    assert got[90][:2] == (16, 16) and got[91] == got[92] == (None, None, None)


def test_pictures_go_along_with_their_files(spark, tiny):
    from larder.plans import extras

    found = extras.s04_files(spark, tiny)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # a join would broadcast all pixels
    rows = found.collect()
    assert rows and all(r["same"] == (r["key"] % 4 < 2) == (r["height"] is not None) for r in rows)
