"""What is fetched, chosen and put together from stored results: hand-derived values."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions import images, regions
from larder.operators import history, reading
from larder.sources import presets
from tests.test_images import table as grid_picture

KEY = "sha256 string, feature string, hints string"


def test_fetching(spark):
    requests = spark.createDataFrame([(i, s, "F", "pt", at) for i, s, at in ((1, "kept", 1), (2, "new", 2), (3, "new", 3), (4, "bad", 4), (5, "bad", 5), (6, "none", 6), (7, "late", 7))] + [(8, "new", "G", "pt", 8), (9, "new", "F", "pt", 9), (10, "new", "F", "en", 10), (11, "old", "F", "pt", 11), (12, "old", "G", "pt", 12), (13, "old", "F", "pt", 13), (14, "old", "F", "pt", 14)], f"id int, {KEY}, at int")
    cache = spark.createDataFrame([("kept", "F", "pt", "old"), ("old", "F", "pt", "kept F")], f"{KEY}, response string")
    outcomes = spark.createDataFrame([("new", "F", "pt", "answer", 1.0, None, None), ("new", "G", "pt", "for G", 1.0, None, None), ("old", "F", "pt", "new F", 1.0, [], None), ("old", "G", "pt", "new G", None, None, None), ("bad", "F", "pt", None, 1.0, ["timeout", "auth_error"], "x" * 600), ("late", "F", "pt", "too late", 31.0, [], "slow")], f"{KEY}, response string, seconds double, classes array<string>, message string")
    got = {r["id"]: (r["cache_hit"], r["response"], r["called"], r["error"], r["secondary"]) for r in reading.fetched(requests, cache, outcomes).collect()}
    assert got == {
        1: (True, "old", False, None, []), 2: (False, "answer", True, None, []), 3: (True, "answer", False, None, []), 4: (False, None, True, "auth_error", ["timeout"]), 5: (False, None, True, "auth_error", ["timeout"]),
        6: (False, None, True, "generic_error", []), 7: (False, None, True, "timeout", []),
        # another feature takes the slot, so the first is called again; hints differ; a kept response goes with the first other one
        8: (False, "for G", True, None, []), 9: (False, "answer", True, None, []), 10: (False, None, True, "generic_error", []),
        11: (True, "kept F", False, None, []), 12: (False, "new G", True, None, []), 13: (False, "new F", True, None, []), 14: (True, "new F", False, None, []),
    }
    results = reading.fetched(requests, cache, outcomes)
    assert {len(r["message"]) for r in results.where("id = 4").collect()} == {500}
    assert sorted(tuple(r) for r in reading.cache_puts(results).collect()) == [("new", "F", "pt", "answer"), ("old", "F", "pt", "new F")]


def test_cloud_readings(spark):
    box = lambda x, y: {"vertices": [{"x": x, "y": y}, {"x": x + 20, "y": y + 10}]}
    words = [("a", 0, 0), ("b", 100, 0), ("c", 0, 30), ("d", 100, 30)]
    body = json.dumps({"fullTextAnnotation": {"text": "plain"}, "textAnnotations": [{"description": "all"}, *({"description": t, "boundingPoly": box(x, y)} for t, x, y in words)]})
    rows = [(1, "DOCUMENT_TEXT_DETECTION", True, None, None, [], body, True), (2, "DOCUMENT_TEXT_DETECTION", False, None, None, [], body, False), (3, "nonsense", True, None, None, [], body, True), (4, "TEXT_DETECTION", False, "timeout", "late", ["generic_error"], None, False), (5, None, False, None, None, [], body, False), (6, "DOCUMENT_TEXT_DETECTION", False, None, None, [], "{}", True)]
    df = spark.createDataFrame(rows, "id int, feature string, cache_hit boolean, error string, message string, secondary array<string>, response string, rebuild boolean")
    got = {r["id"]: (r["text"], r["cache_hit"], r["error"], r["secondary"]) for r in reading.cloud_readings(df, "id", F.col("rebuild")).collect()}
    assert got == {1: ("a\tb\nc\td", True, None, []), 2: ("plain", False, None, []), 3: ("", False, "invalid_feature", []), 4: ("", False, "timeout", ["generic_error"]), 5: ("", False, "invalid_feature", []), 6: ("", False, None, [])}
    with pytest.raises(Exception, match="timeout"):
        reading.cloud_readings(df, "id", on_failure="raise").collect()
    assert reading.cloud_readings(df.where("id <> 4"), "id", on_failure="raise").count() == 5


def test_cell_readings(spark):
    cells = [(1, 0, 0, 0, 40, 20, " name ", 80.0, "x", 1.0), (1, 1, 50, 2, 40, 20, "y", 2.0, "10\n%", 90.0), (1, 2, 0, 40, 40, 20, "", 0.0, "", 0.0), (1, 3, 0, 80, 40, 20, "fat", 60.0, "x", 1.0), (2, 0, 0, 0, 40, 20, " ", 0.0, None, None), (4, 0, 5, 5, 30, 20, "only", 50.0, "other", 10.0)]
    df = spark.createDataFrame(cells, "page int, cell int, x int, y int, w int, h int, text string, confidence double, last_text string, last_confidence double")
    whole = spark.createDataFrame([(1, "w1", 5.0), (2, "w2", 6.0), (3, None, None), (4, "w4", 1.0)], "page int, text string, confidence double")
    heads = spark.createDataFrame([(1, " HEAD\n", 100.0), (2, "", 0.0)], "page int, text string, confidence double")
    got = {r["page"]: tuple(r)[1:] for r in reading.cell_readings(df, whole, "page", heads).collect()}
    assert got[1] == ("HEAD\nname\t10 %\nfat", (80 + 90 + 60 + 100) / 4, 4, 3, 2)
    assert got[2] == ("w2", 6.0, 1, 1, 1) and got[3] == ("", 0.0, 0, 0, 0)
    assert got[4] == ("only", 50.0, 1, 1, 1)  # the only column isn't read in the other way
    assert {r["page"]: r["text"] for r in reading.cell_readings(df, whole, "page").collect()}[1] == "name\t10 %\nfat\t"


def test_best_detection(spark):
    rows = [("a", 0, "Label", 0.9, 0.1, 0.1, 0.2, 0.2), ("a", 1, "label!", 0.8, 0.0, 0.0, 0.5, 0.5), ("a", 2, "label", 0.8, 0.2, 0.2, 1.5, 0.9), ("a", 3, "cat", 0.99, 0.0, 0.0, 1.0, 1.0), ("a", 4, None, 0.3, 0.0, 0.0, 1.0, 1.0), ("b", 0, "label", 0.9, 0.5, 0.5, 0.4, 0.9)]
    df = spark.createDataFrame([(*r, 100, 200) for r in rows], "k string, nth int, label string, confidence double, left double, top double, right double, bottom double, width int, height int")
    assert [tuple(r) for r in reading.best_detection(df, "k", ("LABEL",), 0.5).collect()] == [("a", 0, 0, 50, 100, 0.8)]
    assert [tuple(r)[1:5] for r in reading.best_detection(df, "k", (), 0.5).collect()] == [(0, 0, 100, 200)]


def test_regions():
    page = np.full((300, 400), 240, np.uint8)
    page[100:220, 90:290] = np.where(grid_picture(120, 200) == 230, 240, 0)
    x1, y1, x2, y2 = regions.grid_region(page)
    assert abs(x1 - 90) <= 4 and abs(y1 - 100) <= 4 and abs(x2 - 290) <= 4 and abs(y2 - 220) <= 4
    assert regions.region_of(page, "table") == (x1 - 16, y1 - 12, x2 + 16, y2 + 12)
    assert regions.grid_region(np.full((300, 400), 240, np.uint8)) is None and regions.grid_region(np.zeros((50, 50), np.uint8)) is None
    assert regions.region_of(np.full((300, 400), 240, np.uint8), "table") == (0, 0, 400, 300)
    text = np.full((300, 400), 240, np.uint8)
    for y in range(60, 240, 20):  # a column of lines of words, and a small spot
        text[y : y + 8, 60:200] = 20
    text[280:285, 350:360] = 20
    a, b, c, d = regions.text_region(text)
    assert 40 <= a <= 62 and b <= 62 and 198 <= c <= 215 and d >= 225
    assert regions.region_of(text, "ingredient") == regions.padded((a, b, c, d), 300, 400, 0.03)
    # what a detector found is narrowed to the grid in it, or for texts only widened
    assert regions.region_of(page, "text", (50, 60, 350, 260)) == (38, 51, 362, 269)
    inner = regions.region_of(page, None, (50, 60, 350, 260))
    assert 50 <= inner[0] < 95 and 60 <= inner[1] < 105 and 285 < inner[2] <= 350 and 215 < inner[3] <= 260
    assert regions.padded((5, 5, 5, 5), 10, 10, 0.0) == (0, 0, 10, 10)


def aslant(height, width, rise, run, box, thick=2, ground=235, ink=30):
    """The outline of a rectangle (left, top, right, bottom in its own sides) on sides that rise by so much on so long a way."""
    y, x = np.mgrid[0:height, 0:width]
    u, v = x + y * rise // run, y - x * rise // run
    a, b, c, d = box
    inside = (u >= a) & (u < c) & (v >= b) & (v < d)
    core = (u >= a + thick) & (u < c - thick) & (v >= b + thick) & (v < d - thick)
    return np.where(inside & ~core, ink, ground).astype(np.uint8), np.argwhere(inside)


def test_quadrilaterals_that_lie_aslant():
    for rise, run, box in ((1, 5, (60, 10, 190, 100)), (1, 4, (90, 0, 240, 110)), (-1, 5, (10, 60, 150, 170)), (1, 6, (50, 20, 210, 120))):
        image, inside = aslant(180, 260, rise, run, box)
        (y1, x1), (y2, x2) = inside.min(axis=0), inside.max(axis=0) + 1
        assert regions.grid_region(image) is None
        found = regions.quadrilateral_region(image)
        assert np.abs(np.array(found) - (x1, y1, x2, y2)).max() <= 4
        assert regions.region_found(image, "table") == ("quadrilateral", regions.padded(found, 180, 260, 0.02))
        assert regions.region_found(image, "text")[0] != "quadrilateral"
    # too small, too large, of three or of many corners, not convex
    y, x = np.mgrid[0:180, 0:260]
    for shape in ((np.abs(x - 100) + np.abs(y - 90) < 20), (x > 3) & (x < 257) & (y > 3) & (y < 177), (y > 40) & (y < 150) & (np.abs(x - 130) < (y - 40) * 0.8), (x - 130) ** 2 + (y - 90) ** 2 < 65**2, (np.abs(x - 130) + np.abs(y - 90) < 80) & ~((x > 130) & (np.abs(y - 90) < (x - 130) * 0.9))):
        assert regions.quadrilateral_region(np.where(shape, 40, 230).astype(np.uint8)) is None
    assert regions.quadrilateral_region(np.full((180, 260), 200, np.uint8)) is None
    # a ruled table in a panel that takes the eye: the region is narrowed to the table
    image = np.full((400, 500), 150, np.uint8)
    image[60:340, 60:440] = 235
    image[140:260, 140:340] = np.where(grid_picture(120, 200) == 230, 235, 30)
    assert regions._narrowed(image, (52, 52, 448, 348)) == regions.region_of(image, "table", (52, 52, 448, 348))


def test_edges_are_thin():
    image = np.full((40, 60), 50, np.uint8)
    image[:, 30:] = 200
    found = np.argwhere(regions.edges(image))
    assert found.tolist() == [[y, 29] for y in range(40)] or found.tolist() == [[y, 30] for y in range(40)]
    image[:, 30:] = 62  # 48 at most: under the lower threshold
    assert not regions.edges(image).any()
    image[:, 30:] = 80  # 120: between the two, and nothing stronger touches it
    assert not regions.edges(image).any()
    image[20, 30:] = 250  # now it is tied to a strong one
    assert regions.edges(image)[:, 29:31].any(axis=1).sum() > 30
    y, x = np.mgrid[0:60, 0:60]
    slope = regions.edges(np.where(x > y, 200, 50).astype(np.uint8))
    assert slope.sum() <= 2 * 60 and slope.any(axis=1).sum() >= 56


def test_borders_are_followed_once():
    import random

    r = random.Random(6)
    for _ in range(60):
        ink = np.array([[r.random() < 0.55 for _ in range(r.choice([9]))] for _ in range(8)])
        found = regions.borders(ink)
        outer = [p for p, hole in found if not hole]
        assert len(outer) == images.Regions.of(ink).count
        padded = np.pad(~ink, 1, constant_values=True)
        # holes: regions of empty pixels, corners don't touch, that don't reach the rim
        label, n = -np.ones(padded.shape, int), 0
        for start in map(tuple, np.argwhere(padded)):
            if label[start] < 0:
                todo = [start]
                label[start] = n
                while todo:
                    y, x = todo.pop()
                    for at in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                        if 0 <= at[0] < padded.shape[0] and 0 <= at[1] < padded.shape[1] and padded[at] and label[at] < 0:
                            label[at] = n
                            todo.append(at)
                n += 1
        assert len(found) - len(outer) == n - 1
        for points, _ in found:
            assert ink[points[:, 1], points[:, 0]].all()
            step = np.abs(np.roll(points, -1, axis=0) - points).max(axis=1)
            assert len(points) == 1 or (step == 1).all()
        # all pixels with an empty one beside them are on a border
        beside = ink & (padded[1:-1, :-2] | padded[1:-1, 2:] | padded[:-2, 1:-1] | padded[2:, 1:-1])
        on = {tuple(p) for points, _ in found for p in points.tolist()}
        assert {(x, y) for y, x in np.argwhere(beside).tolist()} <= on
    square = np.zeros((10, 12), bool)
    square[2:8, 3:9] = True
    (points, hole), = regions.borders(square)
    assert not hole and sorted(map(tuple, regions.corners(points, 1.0).tolist())) == [(3, 2), (3, 7), (8, 2), (8, 7)]
    assert regions.convex(np.array([(0, 0), (4, 0), (4, 4), (0, 4)])) and not regions.convex(np.array([(0, 0), (4, 0), (1, 1), (0, 4)]))


def test_steps_change_some_pictures_and_leave_some(spark, tiny):
    """On the pictures that queries use: every step does something, and conditional ones leave others as they are."""
    from larder.plans import extras

    kinds = {r["shown"]: images.picture(r["height"], r["width"], r["pixels"]) for r in extras.pictures(spark, tiny).collect()}
    assert {"framed", "table", "dark", "colour", "tall", "panel", "text", "aslant", "blank"} == set(kinds)
    changed = {name: {k for k, i in kinds.items() if not np.array_equal(step(i), i)} for name, step in images.STEPS.items()}
    assert changed["resize_max_height"] == {"tall"} and "tall" not in changed["resize_min_height"] and changed["grayscale"] == {"colour"}
    assert changed["ensure_black_text_on_white"] == {"dark", "colour"} and "aslant" in changed["deskew"] and "text" not in changed["deskew"]
    white = {k: images.apply_steps(i, extras.BINARY) for k, i in kinds.items()}
    assert {k for k, i in white.items() if not np.array_equal(images.remove_grid_lines(i), i)} == {"framed", "table", "dark", "colour", "tall", "panel"}
    assert changed["invert"] == set(kinds) and [name for name, some in changed.items() if not some] == ["bilateral_filter"]  # there are no shades to smooth
    found = {k: regions.region_found(i, "text" if k in ("text", "aslant") else "table")[0] for k, i in kinds.items()}
    assert set(found.values()) == {"grid", "quadrilateral", "text", "none"}


def test_pictures_to_read(spark):
    image = grid_picture()
    df = spark.createDataFrame([(1, 120, 180, bytearray(image.tobytes())), (2, 5, 5, bytearray(b"x"))], "k int, height int, width int, pixels binary")
    got = reading.cells_of(df, "k", "grayscale; otsu_threshold").collect()
    assert [(r["key"], r["part"], r["cell"], r["x"], r["y"], r["w"], r["h"]) for r in got] == [(1, "cell", n, *b) for n, b in enumerate([(2, 2, 86, 56), (92, 2, 86, 56), (2, 62, 86, 56), (92, 62, 86, 56)])] + [(1, "whole", None, 0, 0, 180, 120)]
    assert [r["part"] for r in reading.cells_of(df, "k", "grayscale", 0.9).collect()][0] == "header"
    cell = images.crop_cell(np.where(image == 230, 255, 0).astype(np.uint8), (2, 2, 86, 56))
    assert bytes(got[0]["png"]) == images.encode_png(np.pad(cell, 4, constant_values=255))
    assert [tuple(r) for r in reading.regions_of(df.withColumn("c", F.lit("table")), "k", "c").where("key = 2").collect()] == [(2, None, None, None, None, None)]
    # presets read cells in one mode, and every preset's steps run over a picture of three channels too
    assert {p[4] for p in presets.PRESETS if p[2] == "cell_based"} == {7}
    for p in presets.PRESETS:
        assert images.apply_steps(np.stack([image] * 3, axis=2), p[-1]).dtype == np.uint8


def test_admissions_by_key_equal_those_of_lists(spark):
    import random

    r = random.Random(1)
    events = [(k, float(r.randrange(0, 400))) for k in range(6) for _ in range(60)]
    got: dict = {}
    for row in history.admitted(spark.createDataFrame(events, "k int, at double"), "k", "at", 3, 20.0).collect():
        got.setdefault(row["k"], []).append((row["requested"], row["admitted"]))
    for k in range(6):
        times = sorted(t for key, t in events if key == k)
        assert sorted(got[k]) == sorted(zip(times, history.admissions(times, 3, 20.0)))
        let = history.admissions(times, 3, 20.0)
        assert all(b >= a for a, b in zip(let, let[1:])) and all(sum(x - 20 < y <= x for y in let) <= 3 for x in let)


def test_borders_of_some_sizes():
    r = np.random.default_rng(4)
    for _ in range(40):
        ink = r.random((14, 19)) < 0.6
        size = lambda p: np.prod(np.ptp(p, axis=0) + 1)
        want = [p.tolist() for p, _ in regions.borders(ink) if 6 <= size(p) <= 60]
        assert [p.tolist() for p, _ in regions.borders(ink, 6, 60)] == want


def test_regions_of_a_busy_picture_take_few_steps():
    """Runs of pixels are joined in arrays, and only borders that may be a quadrilateral's are followed: the number of calls doesn't go with what a picture shows."""
    import sys

    image = np.full((400, 400), 235, np.uint8)
    image[::10], image[:, ::10] = 25, 25  # 1,600 cells
    calls = [0]
    sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + (event in ("call", "c_call"))))
    try:
        assert regions.region_found(image, "table")[0] == "none"
    finally:
        sys.setprofile(None)
    assert calls[0] < 20_000  # 600,000 and more when each run and border was gone through
