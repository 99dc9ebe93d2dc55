"""Image steps on grey arrays, in numpy, behind an Arrow function (I-01 to I-19, I-20, I-21, I-23, I-27, A-17).

An image is a struct (height, width, pixels), row by row: one byte a pixel, or three (blue, green, red). Steps and their
parameters are named as presets name them. Blurs mirror the borders, thresholds by blocks and medians repeat the edge.
Cubic samples are taken in floating point, so that a value may differ by one from a library's that works in fixed point.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

Image = np.ndarray


def odd(size: int) -> int:
    """I-19: a kernel's size, the next odd number for an even one."""
    return size if size % 2 else size + 1


def _mean_weights(n: int, out: int) -> np.ndarray:
    """How much of each old row or column a new one covers, for fewer of them."""
    edges = np.arange(out + 1) * n / out
    at = np.arange(n)
    share = np.minimum(edges[1:, None], at[None] + 1) - np.maximum(edges[:-1, None], at[None])
    return np.clip(share, 0, None) * out / n


def _cubic(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a, 0.0))


def _cubic_weights(n: int, out: int) -> np.ndarray:
    """The same for more of them: each new one from four old ones, edges repeated."""
    at = (np.arange(out) + 0.5) * n / out - 0.5
    weights = np.zeros((out, n))
    for k in range(-1, 3):
        old = np.floor(at).astype(int) + k
        np.add.at(weights, (np.arange(out), np.clip(old, 0, n - 1)), _cubic(at - old))
    return weights


def _byte(values: np.ndarray) -> Image:
    """Rounded, halves to even, and kept within a byte."""
    return np.clip(np.rint(values), 0, 255).astype(np.uint8)


def resized(image: Image, height: int) -> Image:
    """The aspect kept: averages of areas where it gets smaller, cubic where it gets larger."""
    h, w = image.shape[:2]
    width = max(1, round(w * (height / h)))
    rows = _mean_weights(h, height) if height < h else _cubic_weights(h, height)
    columns = _mean_weights(w, width) if height < h else _cubic_weights(w, width)
    return _byte(np.einsum("ij,jk...,lk->il...", rows, image.astype(float), columns, optimize=True))


def resize_max_height(image: Image, max_height: int = 500) -> Image:
    return resized(image, max_height) if image.shape[0] > max_height else image


def resize_min_height(image: Image, min_height: int = 600) -> Image:
    return resized(image, min_height) if image.shape[0] < min_height else image


def grayscale(image: Image) -> Image:
    """Of three channels blue, green, red."""
    return image if image.ndim == 2 else _byte(image @ np.array([0.114, 0.587, 0.299]))


def by_channel(step: Callable[..., Image]) -> Callable[..., Image]:
    """A step on one channel as one on each of several."""

    @functools.wraps(step)
    def run(image: Image, *args, **more) -> Image:
        return step(image, *args, **more) if image.ndim == 2 else np.stack([step(image[..., c], *args, **more) for c in range(image.shape[2])], axis=2)

    return run


def _windows(image: Image, rows: int, columns: int, mode: str = "edge") -> np.ndarray:
    padded = np.pad(image, ((rows // 2, (rows - 1) // 2), (columns // 2, (columns - 1) // 2)), mode=mode)
    return np.lib.stride_tricks.sliding_window_view(padded, (rows, columns))


@by_channel
def median_blur(image: Image, kernel_size: int = 3) -> Image:
    n = odd(kernel_size)
    if n != 3:
        return np.partition(_windows(image, n, n).reshape(*image.shape, n * n), n * n // 2, axis=2)[..., n * n // 2]

    def ordered(a: Image, b: Image, c: Image) -> tuple[Image, ...]:
        low, high = np.minimum(a, b), np.maximum(a, b)
        return np.minimum(low, c), np.maximum(low, np.minimum(high, c)), np.maximum(high, c)

    # of nine, the middle of the largest least, the middle middle and the least largest one of three ordered columns
    up = np.pad(image, 1, mode="edge")
    low, middle, high = ordered(up[:-2], up[1:-1], up[2:])
    beside = lambda v: (v[:, :-2], v[:, 1:-1], v[:, 2:])
    return ordered(ordered(*beside(low))[2], ordered(*beside(middle))[1], ordered(*beside(high))[0])[1]


#: Binomial-like kernels that take the place of the bell curve up to this size.
SMALL_KERNELS = {1: (1.0,), 3: (0.25, 0.5, 0.25), 5: (0.0625, 0.25, 0.375, 0.25, 0.0625), 7: (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125)}


def _gaussian(image: Image, size: int, mode: str = "reflect") -> np.ndarray:
    if size in SMALL_KERNELS:
        k = np.array(SMALL_KERNELS[size])
    else:
        sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
        k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
        k /= k.sum()
    (h, w), pad = image.shape, (size // 2, (size - 1) // 2)
    out, part = np.empty((h, w)), np.empty((h, w))

    def weighed(at: Callable[[int], np.ndarray]) -> np.ndarray:
        np.multiply(at(0), k[0], out=out)
        for i in range(1, size):
            np.add(out, np.multiply(at(i), k[i], out=part), out=out)
        return out

    rows = np.pad(image.astype(float), (pad, (0, 0)), mode=mode)
    columns = np.pad(weighed(lambda i: rows[i : i + h]), ((0, 0), pad), mode=mode)
    return weighed(lambda i: columns[:, i : i + w])


@by_channel
def gaussian_blur(image: Image, kernel_size: int = 3) -> Image:
    return _byte(_gaussian(image, odd(kernel_size)))


def bilateral_filter(image: Image, diameter: int = 7, sigma_color: float = 50.0, sigma_space: float = 50.0) -> Image:
    """Over a round window, borders mirrored; colours are as far apart as their channels together."""
    radius, (h, w) = max(1, diameter // 2), image.shape[:2]
    channels = np.moveaxis(image, 2, 0) if image.ndim == 3 else image[None]
    padded = np.pad(channels.astype(np.int16), ((0, 0), (radius, radius), (radius, radius)), mode="reflect")
    alike = np.exp(-(np.arange(255 * len(channels) + 1.0) ** 2) / (2 * sigma_color * sigma_color))
    total, sums = np.zeros((h, w)), np.zeros(channels.shape)
    for dy in range(-radius, radius + 1):  # a place of the window after the other, for all pixels
        for dx in range(-radius, radius + 1):
            if dy * dy + dx * dx <= radius * radius:
                there = padded[:, radius + dy : radius + dy + h, radius + dx : radius + dx + w]
                apart = np.abs(there - channels)
                weight = alike[apart[0] if len(apart) == 1 else apart.sum(axis=0)] * np.exp(-(dy * dy + dx * dx) / (2 * sigma_space * sigma_space))
                total += weight
                sums += there * weight
    out = _byte(sums / total)
    return np.moveaxis(out, 0, 2) if image.ndim == 3 else out[0]


def clahe(image: Image, clip_limit: float = 2.0, tile_grid_size: tuple[int, int] = (8, 8)) -> Image:
    """Equalisation by tiles (across, down) with clipped histograms, blended between tile centers. What is clipped is dealt
    out evenly over the levels, what is left of it in equal steps; a picture that tiles don't fill is mirrored on."""
    gray = grayscale(image)
    (h, w), across, down = gray.shape, max(1, int(tile_grid_size[0])), max(1, int(tile_grid_size[1]))
    padded = gray if h % down == 0 and w % across == 0 else np.pad(gray, ((0, down - h % down), (0, across - w % across)), mode="reflect" if min(h, w) > max(across, down) else "symmetric")
    th, tw = padded.shape[0] // down, padded.shape[1] // across
    maps = np.empty((down, across, 256))
    most = max(1, int(clip_limit * th * tw / 256))
    tile = (np.arange(down * th) // th * across)[:, None] + np.arange(across * tw) // tw
    counts = np.bincount((tile * 256 + padded).ravel(), minlength=down * across * 256).reshape(down, across, 256)
    for i in range(down):
        for j in range(across):
            n = counts[i, j]
            over = int(np.maximum(n - most, 0).sum())
            n = np.minimum(n, most) + over // 256
            if left := over % 256:
                n[: left * max(1, 256 // left) : max(1, 256 // left)] += 1
            maps[i, j] = _byte(np.cumsum(n) * (255 / (th * tw)))
    y, x = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    a, b = (y - y0)[:, None], (x - x0)[None]
    y1, x1 = np.minimum(y0 + 1, down - 1), np.minimum(x0 + 1, across - 1)
    y0, x0 = np.maximum(y0, 0), np.maximum(x0, 0)
    level = maps.ravel()
    at = lambda i, j: level[(i[:, None] * across + j) * 256 + gray]
    return _byte(at(y0, x0) * (1 - a) * (1 - b) + at(y1, x0) * a * (1 - b) + at(y0, x1) * (1 - a) * b + at(y1, x1) * a * b)


def otsu_level(image: Image) -> int:
    """The level that separates best the variances of what is darker and lighter."""
    n = np.bincount(grayscale(image).ravel(), minlength=256).astype(float)
    low, total, levels = np.cumsum(n), n.sum(), np.arange(256)
    sums = np.cumsum(n * levels)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = low * (total - low) * (sums / low - (sums[-1] - sums) / (total - low)) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def otsu_threshold(image: Image) -> Image:
    return np.where(grayscale(image) > otsu_level(image), 255, 0).astype(np.uint8)


def adaptive_threshold(image: Image, block_size: int = 41, c: float = 14) -> Image:
    gray = grayscale(image)
    return np.where(gray.astype(int) > _byte(_gaussian(gray, max(3, odd(block_size)), "edge")).astype(int) - int(c), 255, 0).astype(np.uint8)


def dark_share(image: Image, below: int = 128) -> float:
    """A-17."""
    return float((image < below).mean())


def ensure_black_text_on_white(image: Image) -> Image:
    gray = grayscale(image)
    return invert(gray) if dark_share(gray) > 0.5 else gray


def invert(image: Image) -> Image:
    return 255 - image


def _morph(image: Image, rows: int, columns: int, pick: Callable) -> Image:
    """Over a flat window, along one side after the other. A stretch's least or greatest value is that of two shorter ones that cover it, so
    that a window takes as many steps as its size has bits."""
    both = {np.min: np.minimum, np.max: np.maximum}[pick]
    for axis, size in enumerate((rows, columns)):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (size // 2, (size - 1) // 2)
        v, have = np.moveaxis(np.pad(image, pad, mode="edge"), axis, 0), 1
        while have < size:
            step = min(have, size - have)
            v, have = both(v[:-step], v[step:]), have + step
        image = np.moveaxis(v, 0, axis)
    return image


@by_channel
def morph_erode(image: Image, kernel_size: int = 2, iterations: int = 1) -> Image:
    for _ in range(max(1, iterations)):
        image = _morph(image, max(1, kernel_size), max(1, kernel_size), np.min)
    return image


@by_channel
def morph_dilate(image: Image, kernel_size: int = 2, iterations: int = 1) -> Image:
    for _ in range(max(1, iterations)):
        image = _morph(image, max(1, kernel_size), max(1, kernel_size), np.max)
    return image


def morph_close(image: Image, kernel_size: int = 3, iterations: int = 1) -> Image:
    return morph_erode(morph_dilate(image, kernel_size, iterations), kernel_size, iterations)


def morph_open(image: Image, kernel_size: int = 3, iterations: int = 1) -> Image:
    return morph_dilate(morph_erode(image, kernel_size, iterations), kernel_size, iterations)


def thin_text_if_thick(image: Image, dark_ratio_threshold: float = 0.14) -> Image:
    """From this share of dark pixels on, the picture is eroded with a kernel of two."""
    gray = grayscale(image)
    return morph_erode(gray, 2) if dark_share(gray) >= dark_ratio_threshold else gray


def least_rectangle_angle(points: np.ndarray) -> float:
    """In degrees, over 0 and up to 90: how a side of the smallest rectangle around the points (x, y) lies to the x axis.
    One of its sides lies along a side of the points' convex hull."""
    points = np.unique(points.astype(float), axis=0)
    if len(points) < 3:
        d = points[-1] - points[0]
        return float(np.degrees(np.arctan2(d[1], d[0])) % 90) or 90.0

    def half(ps: np.ndarray) -> list:
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    # of a row of points only its ends can be corners
    first = np.flatnonzero(np.append(True, points[1:, 0] != points[:-1, 0]))
    last = np.append(first[1:] - 1, len(points) - 1)
    ends = points[np.unique(np.concatenate([first, last]))]
    hull = np.array(half(ends) + half(ends[::-1]))
    best = (np.inf, 0.0)
    for d in np.roll(hull, -1, axis=0) - hull:
        u = d / np.hypot(*d)
        along, across = hull @ u, hull @ np.array([-u[1], u[0]])
        best = min(best, (round(float(np.ptp(along) * np.ptp(across)), 6), float(np.degrees(np.arctan2(u[1], u[0])) % 90) or 90.0))
    return best[1]


def turned(image: Image, angle: float) -> Image:
    """Turned about its center by degrees against the clock, cubic, edges repeated."""
    h, w = image.shape
    a, b = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    yy, xx = np.mgrid[0:h, 0:w]
    dx, dy = xx - w / 2, yy - h / 2
    sx, sy = a * dx - b * dy + w / 2, b * dx + a * dy + h / 2
    x0, y0, out = np.floor(sx).astype(int), np.floor(sy).astype(int), np.zeros((h, w))
    for i in range(-1, 3):
        for j in range(-1, 3):
            out += _cubic(sy - y0 - i) * _cubic(sx - x0 - j) * image[np.clip(y0 + i, 0, h - 1), np.clip(x0 + j, 0, w - 1)]
    return _byte(out)


def deskew(image: Image, max_abs_angle: float = 10.0) -> Image:
    """Turned by the angle of the smallest rectangle around the dark pixels (row before column), if it is half a degree to
    ``max_abs_angle``; not if under 2 % are dark."""
    gray = grayscale(image)
    if dark_share(gray) < 0.02:
        return gray
    angle = -least_rectangle_angle(np.argwhere(gray < 128))
    return turned(gray, angle) if 0.5 <= abs(angle) <= max_abs_angle else gray


def unsharp_mask(image: Image, kernel_size: int = 5, amount: float = 1.0) -> Image:
    gray = grayscale(image)
    return _byte(gray * (1 + amount) - _byte(_gaussian(gray, odd(kernel_size))) * amount)


def grid_lines(image: Image, horizontal_divisor: int = 20, vertical_divisor: int = 20) -> Image:
    """I-20: what is left of the ink after opening with long flat and long upright kernels, of a share of the picture's sides."""
    ink = invert(grayscale(image))
    h, w = ink.shape
    across, down = max(3, w // max(1, horizontal_divisor)), max(3, h // max(1, vertical_divisor))
    flat = _morph(_morph(ink, 1, across, np.min), 1, across, np.max)
    tall = _morph(_morph(ink, down, 1, np.min), down, 1, np.max)
    return flat | tall


def remove_grid_lines(image: Image, horizontal_divisor: int = 20, vertical_divisor: int = 20, min_line_area_ratio: float = 0.005) -> Image:
    """I-21: lines, widened by a pixel all around, lose their ink; nothing changes if they cover less than that share."""
    gray = grayscale(image)
    lines = morph_dilate(grid_lines(gray, horizontal_divisor, vertical_divisor), 3)
    if np.count_nonzero(lines) < int(min_line_area_ratio * gray.size):
        return gray
    ink = invert(gray)
    return invert(np.where(ink > lines, ink - lines, 0).astype(np.uint8))


def grid_density(image: Image) -> float:
    """I-23: the share of pixels on lines longer than an eighth of a side."""
    return np.count_nonzero(grid_lines(image, 8, 8)) / max(1, image.shape[0] * image.shape[1])


#: The registry that presets' steps are looked up in.
STEPS: dict[str, Callable[..., Image]] = {f.__name__: f for f in (resize_max_height, resize_min_height, grayscale, median_blur, gaussian_blur, bilateral_filter, clahe, otsu_threshold, adaptive_threshold, ensure_black_text_on_white, invert, morph_erode, morph_dilate, morph_close, morph_open, thin_text_if_thick, deskew, unsharp_mask, remove_grid_lines)}


def parsed_steps(steps: str) -> list[tuple[str, dict]]:
    """Steps as presets write them, separated by semicolons: a name and key=value pairs; several numbers by commas."""
    number = lambda x: float(x) if "." in x else int(x)
    out = []
    for step in filter(None, map(str.strip, steps.split(";"))):
        name, *pairs = step.split()
        values = ((k, v.split(",")) for k, v in (p.split("=", 1) for p in pairs))
        out.append((name, {k: number(v[0]) if len(v) == 1 else tuple(map(number, v)) for k, v in values}))
    return out


def apply_steps(image: Image, steps: str) -> Image:
    """I-27: the steps in order, each with its parameters; an unknown step or parameter is an error."""
    for name, parameters in parsed_steps(steps):
        if name not in STEPS:
            raise ValueError(f"unknown image step: {name}")
        image = STEPS[name](image, **parameters)
    return image


def after_each(image: Image, several: Sequence[str]) -> Iterator[tuple[int, Image]]:
    """(place, picture) after each of several lists of steps. What lists begin with alike is done once; of the pictures between, those of one list are held."""
    paths = [[s.strip() for s in steps.split(";") if s.strip()] for steps in several]
    done: list[tuple[str, Image]] = [("", image)]
    for at in sorted(range(len(paths)), key=paths.__getitem__):
        same = next((n for n, (step, (before, _)) in enumerate(zip(paths[at], done[1:])) if step != before), min(len(paths[at]), len(done) - 1))
        del done[same + 1 :]
        for step in paths[at][same:]:
            done.append((step, apply_steps(done[-1][1], step)))
        yield at, done[-1][1]


#: Pictures that a worker remembers what it has found of, by a hash of their bytes (some 3 KB each); beyond them it begins anew.
MOST_KNOWN = 10_000
_known: dict[bytes, list[tuple]] = {}


def found_after(height: int | None, width: int | None, pixels: bytes | None, several: Sequence[str]) -> list[tuple]:
    """(height, width, dark, density) after each of several lists of steps, nulls of what isn't a picture. A worker works on equal pictures once."""
    image = picture(height, width, pixels)
    if image is None:
        return [(None,) * 4] * len(several)
    key = hashlib.blake2b(repr((height, width, list(several))).encode(), digest_size=20)
    key.update(pixels)
    found = _known.get(key.digest())
    if found is None:
        found = [()] * len(several)
        for at, out in after_each(image, several):
            gray = grayscale(out)
            found[at] = (*gray.shape, dark_share(gray), grid_density(gray))
        if len(_known) >= MOST_KNOWN:
            _known.clear()
        _known[key.digest()] = found
    return found


def picture(height: int | None, width: int | None, pixels: bytes | None) -> Image | None:
    """S-04: the picture of a struct's fields, or None if they don't make one."""
    flat = np.frombuffer(pixels or b"", np.uint8)
    if not height or not width or len(flat) not in (height * width, 3 * height * width):
        return None
    return flat.reshape(height, width) if len(flat) == height * width else flat.reshape(height, width, 3)


def by_row(batch: pa.RecordBatch, *columns: int) -> Iterator[tuple]:
    """Values of a batch's columns, a row at a time: of all its pictures only one is held beside the batch."""
    own = [batch.column(i) for i in columns]
    return (tuple(c[at].as_py() for c in own) for at in range(batch.num_rows))


def processed(images: DataFrame, key: str, steps: str) -> DataFrame:
    """(key, step, height, width, dark, density) of images (key, height, width, pixels) after the named steps in column
    ``steps``, separated by semicolons; a row for each of several, if the column is an array. An image that can't be read gives nulls (S-04)."""
    kind, several = images.schema[key].dataType, isinstance(images.schema[steps].dataType, ArrayType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for k, h, w, pixels, names in by_row(batch, *range(5)):
                names = names if several else [names]
                for name, found in zip(names, found_after(h, w, pixels, names)):
                    for column, value in zip(rows, (k, name, *found)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.column(0).type), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.float64()), pa.array(rows[5], pa.float64())], ["key", "steps", "height", "width", "dark", "density"])

    return images.select(F.col(key).alias("key"), "height", "width", "pixels", steps).mapInArrow(run, f"key {kind.simpleString()}, steps string, height int, width int, dark double, density double")


@dataclass(frozen=True)
class Regions:
    """Regions of touching free pixels, numbered from 1 by their first pixel, row by row. Corners touch too, if asked. They are found from runs of pixels
    in rows: a run is a stretch of a row, from ``first`` up to ``last`` (in a picture with an empty column on either side), of region ``number``."""

    shape: tuple[int, int]
    first: np.ndarray
    last: np.ndarray
    number: np.ndarray
    count: int

    @staticmethod
    def of(free: np.ndarray, corners: bool = True) -> Regions:
        h, w = free.shape
        flat = np.zeros((h, w + 2), np.int8)
        flat[:, 1:-1] = free
        flat = flat.ravel()
        edges = np.flatnonzero(flat[1:] != flat[:-1]) + 1
        first, last = edges[::2], edges[1::2]
        # runs of the row above that a run touches lie together
        low = np.searchsorted(last, first - (w + 2) - corners, "right")
        n = np.maximum(np.searchsorted(first, last - (w + 2) + corners, "left") - low, 0)
        below = np.repeat(np.arange(len(first)), n)
        above = np.arange(len(below)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        lead = np.arange(len(first))
        while len(below):  # the later lead of two that touch follows the earlier one, until all of a region have one
            a, b = lead[below], lead[above]
            apart = a != b
            if not apart.any():
                break
            below, above = below[apart], above[apart]
            np.minimum.at(lead, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (lead[lead] != lead).any():
                lead = lead[lead]
        leads = lead == np.arange(len(lead))
        return Regions((h, w), first, last, np.cumsum(leads)[lead], int(leads.sum()))

    def painted(self, values: np.ndarray) -> np.ndarray:
        """A picture of each region's value (whole numbers, that of region n at place n - 1), and 0 elsewhere."""
        h, w = self.shape
        step = np.zeros(h * (w + 2), np.int32)
        own = np.asarray(values, np.int32)[self.number - 1]
        step[self.first], step[self.last] = own, -own
        return np.cumsum(step, dtype=np.int32).reshape(h, w + 2)[:, 1:-1]

    @functools.cached_property
    def label(self) -> np.ndarray:
        """Each pixel's number."""
        return self.painted(np.arange(1, self.count + 1))

    @functools.cached_property
    def boxes(self) -> np.ndarray:
        """Each region's x1, y1, x2, y2; the last two stand outside."""
        out = np.empty((4, self.count), np.int64)
        if self.count:
            order = np.argsort(self.number, kind="stable")
            at = np.searchsorted(self.number[order], np.arange(1, self.count + 1))
            (y, x1), x2 = np.divmod(self.first[order], self.shape[1] + 2), self.last[order] % (self.shape[1] + 2)
            out[:] = np.minimum.reduceat(x1, at) - 1, np.minimum.reduceat(y, at), np.maximum.reduceat(x2, at) - 1, np.maximum.reduceat(y, at) + 1
        return out.T


def _outer(free: np.ndarray, regions: Regions) -> np.ndarray:
    """Numbers of the regions that no other region encloses: those that lie next to what isn't free outside of all."""
    taken = Regions.of(np.pad(~free, 1, constant_values=True), corners=False)
    outside = taken.painted(np.arange(taken.count) == 0) > 0  # the region of the first corner goes all around
    near = outside[1:-1, :-2] | outside[1:-1, 2:] | outside[:-2, 1:-1] | outside[2:, 1:-1]
    return np.setdiff1d(np.unique(regions.label[near & free]), [0])


def outer_boxes(free: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x1, y1, x2, y2; the last two stand outside) of the touching regions that no other region encloses."""
    regions = Regions.of(free)
    return [tuple(b) for b in regions.boxes[_outer(free, regions) - 1].tolist()]


def reading_order(boxes: list[tuple[int, int, int, int]], least: int) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) in rows, by how far they begin below the row's first, and by x within a row."""
    most = max(10, int(0.5 * sum(b[3] for b in boxes) / len(boxes))) if boxes else least
    rows: list[list] = []
    for box in sorted(boxes, key=lambda b: (b[1], b[0])):
        if rows and abs(box[1] - rows[-1][0][1]) <= most:
            rows[-1].append(box)
        else:
            rows.append([box])
    return [b for row in rows for b in sorted(row, key=lambda b: b[0])]


def detect_cells(image: Image, horizontal_divisor: int = 20, vertical_divisor: int = 20, min_cell_area_ratio: float = 0.001, max_cell_area_ratio: float = 0.5) -> list[tuple[int, int, int, int]]:
    """I-22, P-19: boxes (x, y, w, h) of what grid lines part, by share of the picture and least sides, in reading order.
    Regions that another one encloses don't count."""
    free = morph_dilate(grid_lines(image, horizontal_divisor, vertical_divisor), 3) != 255
    h, w = free.shape
    boxes = []
    for x1, y1, x2, y2 in outer_boxes(free):
        box = (x1, y1, x2 - x1, y2 - y1)
        if min_cell_area_ratio <= box[2] * box[3] / (h * w) <= max_cell_area_ratio and box[2] >= 20 and box[3] >= 12:
            boxes.append(box)
    return reading_order(boxes, max(10, h // 80))


def crop_cell(image: Image, box: tuple[int, int, int, int], padding: int = 2) -> Image:
    """A box without its rim, or with it if nothing else is left."""
    (h, w), (x, y, bw, bh) = image.shape[:2], box
    x1, y1, x2, y2 = max(0, x + padding), max(0, y + padding), min(w, x + bw - padding), min(h, y + bh - padding)
    return image[y1:y2, x1:x2] if x2 > x1 and y2 > y1 else image[y : y + bh, x : x + bw]


def encode_png(image: Image) -> bytes:
    """I-25: a picture as PNG; equal pictures give equal bytes, so its hash is a cache key."""
    import struct
    import zlib

    h, w = image.shape[:2]
    flat = image.reshape(h, -1) if image.ndim == 2 else image[:, :, ::-1].reshape(h, -1)
    rows = np.concatenate([np.zeros((h, 1), np.uint8), flat], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 * (image.ndim == 3), 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


#: Weights of pixels in a mark come again after so many.
MARKS = 251


def marked(images: DataFrame, key: str, steps: str) -> DataFrame:
    """(key, steps, height, width, mark) of images after the named steps in column ``steps``: mark is the sum of all bytes, each times its place (from
    1, row by row) within runs of MARKS, so that pictures that differ nearly always differ in it."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, h, w, pixels, names in by_row(batch, *range(5)):
                image = picture(h, w, pixels)
                if image is None:
                    rows.append((k, names, None, None, None))
                    continue
                flat = (out := apply_steps(image, names)).ravel().astype(np.int64)
                rows.append((k, names, *out.shape[:2], int((flat * (np.arange(len(flat)) % MARKS + 1)).sum())))
            kinds = (batch.column(0).type, pa.string(), pa.int32(), pa.int32(), pa.int64())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "steps", "height", "width", "mark"])

    return images.select(F.col(key).alias("key"), "height", "width", "pixels", steps).mapInArrow(run, f"key {kind}, steps string, height int, width int, mark long")


def keyed(images: DataFrame, key: str, steps: str = "") -> DataFrame:
    """(key, sha256, cells) of pictures after some steps: the cache key of each picture's PNG and how many cells it shows."""
    import hashlib

    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, cells = [], []
            for h, w, pixels in by_row(batch, 1, 2, 3):
                image = picture(h, w, pixels)
                image = apply_steps(image, steps) if image is not None else None
                shas.append(hashlib.sha256(encode_png(image)).hexdigest() if image is not None else None)
                cells.append(len(detect_cells(image)) if image is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.string()), pa.array(cells, pa.int32())], ["key", "sha256", "cells"])

    return images.select(F.col(key).alias("key"), "height", "width", "pixels").mapInArrow(run, f"key {kind}, sha256 string, cells int")


def cells(images: DataFrame, key: str, steps: str = "") -> DataFrame:
    """I-22: (key, cell, x, y, w, h): the cells of pictures after some steps, in reading order."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, h, w, pixels in by_row(batch, *range(4)):
                image = picture(h, w, pixels)
                found = detect_cells(apply_steps(image, steps)) if image is not None else []
                keys += [k] * len(found)
                rows += [(n, *box) for n, box in enumerate(found)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *(pa.array(c, pa.int32()) for c in columns)], ["key", "cell", "x", "y", "w", "h"])

    return images.select(F.col(key).alias("key"), "height", "width", "pixels").mapInArrow(run, f"key {kind}, cell int, x int, y int, w int, h int")
