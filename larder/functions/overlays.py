"""I-26: boxes drawn over pictures, for audits: outlines, shaded boxes and numbers on a copy in colour."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.images import Image, encode_png, picture

#: Blue, green and red of an outline, and its width.
GREEN, WIDTH = (0, 255, 0), 2
#: By digit: five rows of three places, a bit a place.
ROWS = ("75557", "26227", "71747", "71717", "55711", "74717", "74757", "71111", "75757", "75717")

#: Left, top, right, bottom; an outline runs through all four.
Box = tuple[int, int, int, int]


def canvas(image: Image) -> Image:
    """A copy with three channels."""
    return np.repeat(image[:, :, None], 3, axis=2) if image.ndim == 2 else image.copy()


def _filled(on: Image, x1: int, y1: int, x2: int, y2: int, colour: tuple, share: float) -> None:
    """Pixels from the first to the last corner take that share of a colour; what lies outside isn't drawn."""
    h, w = on.shape[:2]
    part = on[max(0, y1) : max(0, min(h, y2 + 1)), max(0, x1) : max(0, min(w, x2 + 1))]
    part[:] = np.rint(part * (1 - share) + np.array(colour) * share).astype(np.uint8)


def outline(on: Image, box: Box, colour: tuple = GREEN, width: int = WIDTH) -> None:
    """A frame through a box's corners, half of its width, rounded up, inside."""
    x1, y1, x2, y2 = box
    out, into = width // 2, width - width // 2 - 1
    _filled(on, x1 - out, y1 - out, x2 + out, y1 + into, colour, 1.0)
    _filled(on, x1 - out, y2 - into, x2 + out, y2 + out, colour, 1.0)
    _filled(on, x1 - out, y1 + into + 1, x1 + into, y2 - into - 1, colour, 1.0)
    _filled(on, x2 - into, y1 + into + 1, x2 + out, y2 - into - 1, colour, 1.0)


def number(on: Image, x: int, y: int, value: int, colour: tuple = GREEN, size: int = 1) -> None:
    """A whole number, its digits three by five places of ``size`` pixels with one place between."""
    for at, digit in enumerate(str(value)):
        for row, bits in enumerate(map(int, ROWS[int(digit)])):
            for column in range(3):
                if bits >> 2 - column & 1:
                    left, top = x + (4 * at + column) * size, y + row * size
                    _filled(on, left, top, left + size - 1, top + size - 1, colour, 1.0)


def overlay(image: Image, boxes: list[Box], numbered: bool = False, shade: float = 0.0) -> Image:
    """A copy with the outline of each box, in order, with a share of colour in it and its number at its corner, if asked for."""
    on = canvas(image)
    for n, box in enumerate(boxes):
        if shade:
            _filled(on, *box, GREEN, shade)
        outline(on, box)
        if numbered:
            number(on, box[0] + 3, box[1] + 3, n)
    return on


def overlays(images: DataFrame, boxes: DataFrame, key: str, numbered: bool = False, shade: float = 0.0) -> DataFrame:
    """(key, png, painted): pictures (key, height, width, pixels) with their boxes (key, cell, x, y, w, h) drawn over them, as PNG, and how many
    pixels that changed. Pictures without boxes are given as they are; nulls for what isn't a picture."""
    kind = images.schema[key].dataType.simpleString()
    lists = boxes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("cell", "x", "y", "w", "h"))).alias("boxes"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                k, h, w, pixels, own = (batch.column(i).slice(at, 1) for i in range(5))
                image = picture(h[0].as_py(), w[0].as_py(), pixels[0].as_py())
                made, painted = None, None
                if image is not None:
                    drawn = overlay(image, [(b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"]) for b in own[0].as_py() or []], numbered, shade)
                    made, painted = encode_png(drawn), int((drawn != canvas(image)).any(axis=2).sum())
                yield pa.RecordBatch.from_arrays([k, pa.array([made], pa.binary()), pa.array([painted], pa.int64())], ["key", "png", "painted"])

    joined = images.select(key, "height", "width", "pixels").join(lists, key, "left")
    return joined.select(F.col(key).alias("key"), "height", "width", "pixels", "boxes").mapInArrow(run, f"key {kind}, png binary, painted long")
