"""I-24: where a label's table or text lies in a picture, without a trained detector: grid lines, else the largest convex outline of four
corners; or blobs of text."""

from __future__ import annotations

import numpy as np

from larder.functions.images import Image, Regions, _morph, adaptive_threshold, bilateral_filter, clahe, grayscale, invert, otsu_threshold, outer_boxes

#: Corners of a region: left, top, right, bottom; right and bottom stand outside.
Box = tuple[int, int, int, int]

#: Fixed values. A grid: least pixels, block and less of its threshold, least and greatest share of the picture, least share of
#: lines in it, how the two are weighed. Text: diameter and both sigmas of the filter, greatest share of the width, least sides.
GRID_PIXELS, GRID_BLOCK, GRID_LESS, GRID_SHARE, GRID_LINES, GRID_WEIGHT, GRID_FULL = 10_000, 31, 12, (0.06, 0.75), 0.05, 1.2, 0.2
TEXT_FILTER, TEXT_WIDTH, TEXT_SIDE = (11, 75.0, 75.0), 0.65, 50
#: Fixed values. A quadrilateral: thresholds of its edges, how far corners may be off its outline as a share of the perimeter, least and
#: greatest share of the picture.
EDGE_LOW, EDGE_HIGH, CORNERS, QUAD_SHARE = 50, 150, 0.02, (0.08, 0.85)
#: What is added around a region, as a share of the picture's sides.
GRID_PADDING, TEXT_PADDING, QUAD_PADDING = 0.04, 0.03, 0.02


def grid_region(image: Image) -> Box | None:
    """The region of long lines with the best score: its share of lines, up to a full one, and its share of the picture."""
    gray = grayscale(image)
    h, w = gray.shape
    if h * w < GRID_PIXELS:
        return None
    ink = invert(adaptive_threshold(gray, GRID_BLOCK, GRID_LESS))
    across, down = max(20, w // 6), max(20, h // 8)
    flat = _morph(_morph(ink, 1, across, np.min), 1, across, np.max)
    tall = _morph(_morph(ink, down, 1, np.min), down, 1, np.max)
    grid = _morph(flat | tall, 5, 5, np.max) > 0
    best: tuple[float, Box | None] = (-1.0, None)
    for x1, y1, x2, y2 in outer_boxes(grid):
        share = (x2 - x1) * (y2 - y1) / (h * w)
        lines = float(grid[y1:y2, x1:x2].mean())
        if GRID_SHARE[0] <= share <= GRID_SHARE[1] and lines >= GRID_LINES:
            best = max(best, (GRID_WEIGHT * min(lines / GRID_FULL, 1.0) + share, (x1, y1, x2, y2)), key=lambda b: b[0])
    return best[1]


def edges(image: Image, low: int = EDGE_LOW, high: int = EDGE_HIGH) -> np.ndarray:
    """Thin edges: pixels whose gradient (three by three, as a sum of absolute values) is the largest across the edge and over ``low``, in
    touching groups with one over ``high`` at least."""
    v = np.pad(grayscale(image).astype(np.int32), 1, mode="edge")
    beside, below = v[:, 2:] - v[:, :-2], v[2:] - v[:-2]
    gx = beside[:-2] + 2 * beside[1:-1] + beside[2:]
    gy = below[:, :-2] + 2 * below[:, 1:-1] + below[:, 2:]
    size, ax, ay = np.abs(gx) + np.abs(gy), np.abs(gx), np.abs(gy)
    around = np.pad(size, 1)
    at = lambda dy, dx: around[1 + dy : 1 + dy + size.shape[0], 1 + dx : 1 + dx + size.shape[1]]
    flat, steep = ay < ax * np.tan(np.pi / 8), ay > ax * np.tan(3 * np.pi / 8)
    falling = (gx ^ gy) >= 0
    across = np.select([flat, steep, falling], [(size > at(0, -1)) & (size >= at(0, 1)), (size > at(-1, 0)) & (size >= at(1, 0)), (size > at(-1, -1)) & (size > at(1, 1))], (size > at(-1, 1)) & (size > at(1, -1)))
    weak = across & (size > low)
    groups = Regions.of(weak)
    strong = np.zeros(groups.count + 1, bool)
    strong[groups.label[weak & (size > high)]] = True
    return groups.painted(strong[1:]) > 0


#: Steps (down, right) around a pixel, clockwise from the right.
AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def _turns() -> list[list[int]]:
    """For which places around a pixel are taken (a bit each) and where the last pixel lies: the place that is taken next, against the clock."""
    return [[next((k % 8 for k in range(back - 1, back - 9, -1) if taken >> k % 8 & 1), back) for back in range(8)] for taken in range(256)]


TURNS = _turns()


def borders(ink: np.ndarray, least: float = 0, most: float = np.inf) -> list[tuple[np.ndarray, bool]]:
    """(points x, y along a border, whether it is a hole's) of all touching regions of ink, by border following. A region's border begins at its first
    pixel, a hole's left of the hole's first. Only borders whose box has from ``least`` to ``most`` pixels are followed: a region's
    box, or a hole's with a pixel around."""
    f = np.pad(ink, 1)
    wide = f.shape[1]
    own, holes = Regions.of(f), Regions.of(~f, corners=False)
    begin = []
    for found, hole in ((own, False), (holes, True)):
        (x1, y1, x2, y2), around = found.boxes.T, 2 * hole
        size = (x2 - x1 + around) * (y2 - y1 + around)
        first = np.zeros(found.count, np.int64)
        first[found.number[::-1] - 1] = found.first[::-1]  # of equal places, the last one written counts: a region's first run
        for n in np.flatnonzero((size >= least) & (size <= most)).tolist():
            if not hole or n:  # the first region of empty pixels goes all around
                y, x = divmod(int(first[n]), wide + 2)
                begin.append((y * wide + x - 1 - hole, hole))
    if not begin:
        return []
    around = np.zeros(f.shape, np.uint8)
    for k, (dy, dx) in enumerate(AROUND):
        around[1:-1, 1:-1] |= f[1 + dy : f.shape[0] - 1 + dy, 1 + dx : wide - 1 + dx].view(np.uint8) << k
    taken, step, out = around.tobytes(), [dy * wide + dx for dy, dx in AROUND], []
    for start, hole in sorted(begin):
        first = next((k % 8 for k in range(4 - 4 * hole, 12 - 4 * hole) if taken[start] >> k % 8 & 1), None)
        points, at, back = [start], start, first
        if first is not None:
            end = start + step[first]
            while True:
                k = TURNS[taken[at]][back]
                last, at, back = at, at + step[k], (k + 4) % 8
                if last == end and at == start:
                    break
                points.append(at)
        y, x = np.divmod(np.array(points), wide)
        out.append((np.stack([x - 1, y - 1], axis=1), hole))
    return out


def corners(points: np.ndarray, most: float) -> np.ndarray:
    """A closed outline with fewer points, none of the others further than ``most`` from it: it is cut at two points far apart, and each part
    at the point furthest from its chord, as long as that is too far."""

    def far(a: np.ndarray, b: np.ndarray, ps: np.ndarray) -> np.ndarray:
        d = (b - a).astype(float)
        length = np.hypot(*d)
        return np.abs(d[0] * (ps[:, 1] - a[1]) - d[1] * (ps[:, 0] - a[0])) / length if length else np.hypot(*(ps - a).T)

    n, one = len(points), 0
    for _ in range(3):
        one, other = int(np.argmax(np.hypot(*(points - points[one]).T))), one
    kept, parts = {one, other}, [(min(one, other), max(one, other)), (max(one, other), min(one, other) + n)]
    while parts:
        a, b = parts.pop()
        if b - a < 2:
            continue
        off = far(points[a % n], points[b % n], points[np.arange(a + 1, b) % n])
        k = int(np.argmax(off))
        if off[k] > most:
            kept.add((a + 1 + k) % n)
            parts += [(a, a + 1 + k), (a + 1 + k, b)]
    left = [points[k] for k in sorted(kept)]
    k = 0
    while len(left) > 2 and k < len(left):  # a cut that turned out to lie on a side
        if far(left[k - 1], left[(k + 1) % len(left)], left[k][None])[0] <= most:
            left.pop(k)
        else:
            k += 1
    return np.array(left)


def convex(points: np.ndarray) -> bool:
    a = np.roll(points, -1, axis=0) - points
    b = np.roll(a, -1, axis=0)
    turn = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
    return bool((turn >= 0).all() or (turn <= 0).all())


def quadrilateral_region(image: Image) -> Box | None:
    """The box of the largest outline that four corners describe and that is convex: a label or a panel, also one that lies aslant."""
    gray = grayscale(image)
    h, w = gray.shape
    found = _morph(edges(clahe(gray, 2.0, (8, 8))).astype(np.uint8), 3, 3, np.max)
    best: tuple[float, Box | None] = (-1.0, None)
    # corners are points of the outline, so their box can't be much different
    for points, _ in borders(found, QUAD_SHARE[0] * 0.8 * h * w, QUAD_SHARE[1] * 1.25 * h * w):
        if len(points) < 4:
            continue
        around = float(np.hypot(*(np.roll(points, -1, axis=0) - points).T).sum())
        four = corners(points, CORNERS * around)
        if len(four) != 4 or not convex(four):
            continue
        (x1, y1), (x2, y2) = four.min(axis=0).tolist(), (four.max(axis=0) + 1).tolist()
        share = (x2 - x1) * (y2 - y1) / (h * w)
        if QUAD_SHARE[0] <= share <= QUAD_SHARE[1] and share > best[0]:
            best = (share, (x1, y1, x2, y2))
    return best[1]


def text_region(image: Image) -> Box | None:
    """The blob of dark text, smeared downwards, that is large and above all tall."""
    gray = grayscale(image)
    h, w = gray.shape
    ink = invert(otsu_threshold(bilateral_filter(gray, *TEXT_FILTER)))
    for _ in range(2):
        ink = _morph(ink, max(10, int(h * 0.04)), max(3, int(w * 0.01)), np.max)
    best: tuple[float, Box | None] = (-1.0, None)
    for x1, y1, x2, y2 in outer_boxes(ink > 0):
        bw, bh = x2 - x1, y2 - y1
        if bw <= w * TEXT_WIDTH and bw >= TEXT_SIDE and bh >= TEXT_SIDE:
            best = max(best, (float(bw * bh) * bh, (x1, y1, x2, y2)), key=lambda b: b[0])
    return best[1]


def padded(box: Box, height: int, width: int, share: float) -> Box:
    """A box with a share of the picture's sides around it, within the picture; the whole picture if nothing is left."""
    px, py = int(share * width), int(share * height)
    x1, y1, x2, y2 = max(0, box[0] - px), max(0, box[1] - py), min(width, box[2] + px), min(height, box[3] + py)
    return (x1, y1, x2, y2) if x2 > x1 and y2 > y1 else (0, 0, width, height)


def _narrowed(image: Image, box: Box) -> Box:
    """The grid in a box, with room around it, or the box."""
    x1, y1, x2, y2 = box
    part = image[y1:y2, x1:x2]
    inner = grid_region(part) if part.size else None
    if inner is None:
        return box
    a = padded(inner, y2 - y1, x2 - x1, GRID_PADDING)
    return a[0] + x1, a[1] + y1, a[2] + x1, a[3] + y1


def region_found(image: Image, category: str | None, detected: Box | None = None) -> tuple[str, Box]:
    """What shows where a picture's table or text is, and its region: around what an outside detector found (detected), if it found something;
    else around its text (text), for texts and ingredients, or its grid (grid) or an outline of four corners (quadrilateral); the
    whole picture if there is none (none)."""
    h, w = image.shape[:2]
    is_text = category in ("text", "ingredient")
    if detected is not None:
        return "detected", padded(detected, h, w, TEXT_PADDING) if is_text else _narrowed(image, detected)
    if is_text:
        found = text_region(image)
        return ("text", padded(found, h, w, TEXT_PADDING)) if found else ("none", (0, 0, w, h))
    if found := grid_region(image):
        return "grid", padded(found, h, w, GRID_PADDING)
    if found := quadrilateral_region(image):
        return "quadrilateral", _narrowed(image, padded(found, h, w, QUAD_PADDING))
    return "none", (0, 0, w, h)


def region_of(image: Image, category: str | None, detected: Box | None = None) -> Box:
    return region_found(image, category, detected)[1]
