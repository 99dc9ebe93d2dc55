"""Image steps against values worked out by hand or by a plain definition."""

import inspect
import zlib

import numpy as np
import pytest

from larder.functions import images as I
from larder.sources import presets


def gray(*rows):
    return np.array(rows, np.uint8)


def test_resizing_averages_areas_and_rounds_the_width():
    image = gray([0, 100, 200, 50], [100, 0, 200, 50], [10, 10, 30, 30], [10, 10, 30, 30])
    assert (I.resize_max_height(image, 2) == gray([50, 125], [10, 30])).all()
    # three rows to two: a new row is two thirds of one old row and a third of the next
    assert (I.resized(gray([0, 0, 0], [90, 90, 90], [30, 30, 30]), 2) == gray([30, 30], [50, 50])).all()
    assert I.resize_max_height(np.zeros((100, 67), np.uint8), 50).shape == (50, 34)  # 33.5, to the even number
    assert I.resize_max_height(np.zeros((100, 69), np.uint8), 10).shape == (10, 7)
    assert I.resize_min_height(np.full((10, 10), 7, np.uint8), 20).shape == (20, 20)
    assert (I.resize_min_height(np.full((10, 10), 7, np.uint8), 20) == 7).all()
    assert I.resize_max_height(image, 4) is image and I.resize_min_height(image, 4) is image
    # a cubic step overshoots on both sides
    step = I.resized(np.repeat(gray([50] * 4 + [150] * 4), 8, axis=0), 16)[0].astype(int)
    assert step[:4].tolist() == [50] * 4 and step.min() < 50 and step.max() > 150 and step[7] + step[8] == 200


def test_gray_of_colours():
    blue_green_red = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [10, 20, 30]]], np.uint8)
    assert I.grayscale(blue_green_red).tolist() == [[29, 150, 76, 22]]
    assert I.otsu_threshold(blue_green_red).shape == (1, 4)
    assert I.resized(np.zeros((4, 4, 3), np.uint8), 2).shape == (2, 2, 3)


def test_steps_on_colours():
    r = np.random.default_rng(3)
    image = r.integers(0, 256, (20, 24, 3)).astype(np.uint8)
    for step in (I.median_blur, I.gaussian_blur, I.morph_erode, I.morph_dilate, I.morph_open, I.morph_close, I.invert):
        assert (step(image) == np.stack([step(image[..., c]) for c in range(3)], axis=2)).all()
    for name, step in I.STEPS.items():
        out = step(image)
        assert out.dtype == np.uint8 and (out.shape[:2] == (20, 24) or name.startswith("resize"))
    # colours that differ in one channel only are kept apart in all of them
    two = np.full((9, 9, 3), 100, np.uint8)
    two[:, 5:, 2] = 220
    out = I.bilateral_filter(two, 5, 20.0, 50.0)
    assert (out[:, :, :2] == 100).all() and (out[:, :4, 2] <= 101).all() and (out[:, 6:, 2] >= 219).all()


def test_blurs_mirror_borders():
    row = np.repeat(gray([0, 100, 0, 0, 0]), 5, axis=0)
    assert I.gaussian_blur(row, 3)[2].tolist() == [50, 50, 25, 0, 0]
    assert I.gaussian_blur(row, 5)[2].tolist() == [50, 44, 25, 6, 0]
    assert I.median_blur(row, 3)[2].tolist() == [0, 0, 0, 0, 0]
    assert I.unsharp_mask(row, 3, 1.0)[2].tolist() == [0, 150, 0, 0, 0]
    spot = np.zeros((7, 7), np.uint8)
    spot[3, 3] = 200
    out = I.bilateral_filter(spot, 5, 1e6, 1e6)  # even weights over a round window of 13 pixels
    assert out[3, 3] == round(200 / 13) and out[1, 3] == out[3, 5] == 15 and out[1, 2] == out[1, 1] == 0


def test_thresholds():
    image = gray([10, 10, 12, 200, 210, 205])
    assert I.otsu_level(image) == 12 and I.otsu_threshold(image).tolist() == [[0, 0, 0, 255, 255, 255]]
    dark = np.full((9, 9), 100, np.uint8)
    dark[4, 4] = 60
    out = I.adaptive_threshold(dark, 3, 14)
    assert out[4, 4] == 0 and (out == 0).sum() == 1  # the mean there is 90, and 60 isn't over 76
    assert I.adaptive_threshold(dark, 3, 30)[4, 4] == 0 and I.adaptive_threshold(dark, 3, 31)[4, 4] == 255
    assert I.ensure_black_text_on_white(gray([0, 0, 255])).tolist() == [[255, 255, 0]]
    assert I.ensure_black_text_on_white(gray([0, 255])).tolist() == [[0, 255]]


def test_clahe_deals_out_what_is_clipped():
    image = np.repeat(np.arange(0, 256, 16, dtype=np.uint8), 16).reshape(16, 16)
    one = I.clahe(image, 1.0, (1, 1))
    # one pixel a level may stay; 240 are dealt out: none a level evenly, then one to each of the first 240 levels
    n = np.where(np.arange(256) % 16 == 0, 1, 0) + np.where(np.arange(256) < 240, 1, 0)
    assert (one == np.rint(np.cumsum(n) * (255 / 256)).astype(np.uint8)[image]).all()
    assert (I.clahe(image, 1000.0, (1, 1)) == np.rint(np.cumsum(np.bincount(image.ravel(), minlength=256)) * (255 / 256)).astype(np.uint8)[image]).all()
    assert I.clahe(np.full((50, 70), 9, np.uint8), 2.0, (8, 8)).shape == (50, 70)


def test_morphology():
    image = np.full((5, 6), 255, np.uint8)
    image[2, 3] = 0
    assert np.argwhere(I.morph_erode(image, 2) == 0).tolist() == [[2, 3], [2, 4], [3, 3], [3, 4]]
    assert (I.morph_dilate(image, 2) == 255).all() and (I.morph_close(image, 3) == 255).all()
    assert np.argwhere(I.morph_erode(image, 3) == 0).shape == (9, 2) and (I.morph_open(image, 2) == 0).sum() == 1
    text = np.full((10, 10), 255, np.uint8)
    text[4, 3:7] = 0  # 4 %
    assert I.thin_text_if_thick(text, 0.05) is text
    assert (I.thin_text_if_thick(text, 0.04) == I.morph_erode(text, 2)).all()  # the share itself counts


def test_deskew_turns_by_the_smallest_rectangle():
    y, x = np.mgrid[0:120, 0:200]
    t = np.radians(4)
    along, across = (x - 100) * np.cos(t) + (y - 60) * np.sin(t), -(x - 100) * np.sin(t) + (y - 60) * np.cos(t)
    box = np.where((abs(along) < 70) & (abs(across) < 12), 0, 255).astype(np.uint8)
    # of (row, column) points: the long side lies 4 degrees off the second axis, the short one off the first
    angle = I.least_rectangle_angle(np.argwhere(box < 128))
    assert min(abs(angle - 86), abs(angle - 4)) < 0.7
    upright = np.where((abs(x - 100) < 70) & (abs(y - 60) < 12), 0, 255).astype(np.uint8)
    assert I.least_rectangle_angle(np.argwhere(upright < 128)) == 90.0
    assert (I.deskew(upright) == upright).all() and (I.deskew(np.full((9, 9), 255, np.uint8)) == 255).all()
    square = I.turned(upright, 0.0)
    assert (square == upright).all() and abs(int((I.turned(upright, 5) < 128).sum()) - int((upright < 128).sum())) < 120
    assert I.least_rectangle_angle(np.array([[0, 0], [3, 3]])) == 45.0 and I.least_rectangle_angle(np.array([[1, 1]])) == 90.0
    # points of a slim strip that leans a little: turned back, its rows are straight
    lean = np.where(abs(across) < 3, 0, 255).astype(np.uint8)
    back = I.deskew(lean)
    spread = lambda im: float(np.ptp(np.argwhere(im < 128)[:, 0]))
    angle = I.least_rectangle_angle(np.argwhere(lean < 128))
    assert (spread(back) < spread(lean)) == (0.5 <= angle <= 10) or angle > 10


def table(h=120, w=180):
    """A frame that touches the edges, with one line across and one down."""
    image = np.full((h, w), 230, np.uint8)
    for y in (0, 59, 60, h - 1):
        image[y] = 0
    for x in (0, 89, 90, w - 1):
        image[:, x] = 0
    return image


def test_grid_lines_have_a_share_of_the_sides():
    image = np.full((60, 220), 255, np.uint8)
    image[30, 20:30] = 0  # ten pixels: shorter than a twentieth of 220
    image[40, 20:32] = 0
    assert np.argwhere(I.grid_lines(image)).tolist() == [[40, x] for x in range(20, 32)]
    assert not I.grid_lines(image, 8, 8).any() and I.grid_density(image) == 0.0
    image[10, 50:90] = 55
    assert set(I.grid_lines(image)[10, 50:90]) == {200} and I.grid_density(image) == 40 / 13200
    assert (I.remove_grid_lines(image, min_line_area_ratio=0.5) == image).all()
    clean = I.remove_grid_lines(image)
    assert (clean[40] == 255).all() and (clean[10] == 255).all() and (clean[30, 20:30] == 0).all()
    # ink next to a line goes with it
    image[11, 60] = 100
    assert I.remove_grid_lines(image)[11, 60] == 255


def test_cells():
    image = np.where(table() == 230, 255, 0).astype(np.uint8)
    assert I.detect_cells(image) == [(2, 2, 86, 56), (92, 2, 86, 56), (2, 62, 86, 56), (92, 62, 86, 56)]
    assert I.detect_cells(np.full((30, 30), 255, np.uint8)) == []
    # inside a margin the frame's cells are enclosed by another region and don't count
    margin = np.pad(image, 10, constant_values=255)
    assert I.detect_cells(margin) == []
    # a row's cells may begin a little lower; they are sorted by x all the same
    assert I.reading_order([(50, 12, 30, 20), (5, 15, 30, 20), (5, 40, 30, 20)], 10) == [(5, 15, 30, 20), (50, 12, 30, 20), (5, 40, 30, 20)]
    assert I.crop_cell(image, (2, 2, 86, 56)).shape == (52, 82) and I.crop_cell(image, (2, 2, 4, 4)).shape == (4, 4)


def test_regions_equal_flooding():
    r = np.random.default_rng(3)
    for _ in range(30):
        free = r.random((12, 17)) < 0.5
        found, seen, n = I.Regions.of(free), np.zeros(free.shape, int), 0
        for start in map(tuple, np.argwhere(free)):
            if not seen[start]:
                n += 1
                todo = [start]
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < 12 and 0 <= x < 17 and free[y, x] and not seen[y, x]:
                        seen[y, x] = n
                        todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert found.count == n and len({(a, b) for a, b in zip(found.label[free], seen[free])}) == n
        outside, todo = np.zeros((14, 19), bool), [(0, 0)]
        taken = np.pad(~free, 1, constant_values=True)
        while todo:
            y, x = todo.pop()
            if 0 <= y < 14 and 0 <= x < 19 and taken[y, x] and not outside[y, x]:
                outside[y, x] = True
                todo += [(y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)]
        near = {int(found.label[y, x]) for y, x in np.argwhere(free) if outside[y, x + 1] or outside[y + 2, x + 1] or outside[y + 1, x] or outside[y + 1, x + 2]}
        assert set(I._outer(free, found).tolist()) == near


def test_png():
    image = table()
    png = I.encode_png(image)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and png == I.encode_png(image.copy())
    at = png.index(b"IDAT")
    rows = zlib.decompress(png[at + 4 : at + 4 + int.from_bytes(png[at - 4 : at], "big")])
    assert (np.frombuffer(rows, np.uint8).reshape(120, 181)[:, 1:] == image).all()
    assert I.encode_png(np.zeros((2, 3, 3), np.uint8))[25] == 2


def test_steps_of_presets_carry_their_parameters():
    assert I.parsed_steps("clahe clip_limit=2.5 tile_grid_size=8,6; invert") == [("clahe", {"clip_limit": 2.5, "tile_grid_size": (8, 6)}), ("invert", {})]
    seen = {}
    for row in presets.PRESETS:
        for name, parameters in I.parsed_steps(row[-1]):
            assert set(parameters) <= set(inspect.signature(I.STEPS[name]).parameters), (row[1], name)
            for k, v in parameters.items():
                seen.setdefault(f"{name}.{k}", set()).add(v)
    assert seen["resize_max_height.max_height"] == {500, 600, 700, 800, 900} and seen["resize_min_height.min_height"] == {400, 500}
    assert seen["clahe.clip_limit"] == {2.0, 2.5, 3.0, 3.5, 4.0} and seen["clahe.tile_grid_size"] == {(8, 8), (6, 6)}
    assert seen["adaptive_threshold.block_size"] == {25, 31, 35, 41, 51} and seen["adaptive_threshold.c"] == {10, 12, 14, 15}
    assert seen["remove_grid_lines.horizontal_divisor"] == {18, 20} and seen["remove_grid_lines.min_line_area_ratio"] == {0.004}
    assert seen["unsharp_mask.amount"] == {1.2, 1.5, 2.0} and seen["bilateral_filter.diameter"] == {7, 9} and seen["thin_text_if_thick.dark_ratio_threshold"] == {0.05}
    image = np.random.default_rng(1).integers(0, 256, (60, 90)).astype(np.uint8)
    for row in presets.PRESETS:
        out = image
        for name, parameters in I.parsed_steps(row[-1]):
            out = I.STEPS[name](out, **parameters)
        assert (I.apply_steps(image, row[-1]) == out).all() and out.dtype == np.uint8
    for bad in ("blur", "invert size=3"):
        with pytest.raises((ValueError, TypeError)):
            I.apply_steps(image, bad)


def test_steps_hold_little_beside_the_picture():
    import tracemalloc

    image = np.random.default_rng(1).integers(0, 256, (300, 400)).astype(np.uint8)
    for step in ("bilateral_filter diameter=11", "median_blur", "morph_dilate kernel_size=60"):
        tracemalloc.start()
        I.apply_steps(image, step)
        assert tracemalloc.get_traced_memory()[1] < 10_000_000  # 0.12 MB in; windows of all pixels took 100 MB and more
        tracemalloc.stop()


def test_windows_as_pixel_by_pixel():
    image = np.random.default_rng(2).integers(0, 256, (13, 17)).astype(np.uint8)
    for rows, columns in ((1, 1), (2, 2), (1, 5), (7, 3), (12, 30)):
        padded = np.pad(image, ((rows // 2, (rows - 1) // 2), (columns // 2, (columns - 1) // 2)), mode="edge")
        for pick in (np.min, np.max):
            assert (I._morph(image, rows, columns, pick) == [[pick(padded[y : y + rows, x : x + columns]) for x in range(17)] for y in range(13)]).all()
    for n in (3, 5):
        padded = np.pad(image, n // 2, mode="edge")
        assert (I.median_blur(image, n) == [[np.median(padded[y : y + n, x : x + n]) for x in range(17)] for y in range(13)]).all()


def test_pictures_are_made_a_few_at_a_time():
    import pyarrow as pa

    from larder.plans import extras

    row = {"p_partkey": 1, "shown": "table", "lines": 3, "cols": 3, "lanes": 5, "cw": 70, "ch": 42, "margin": 0, "width": 212, "height": 212}
    out = list(extras.with_pixels([pa.RecordBatch.from_pylist([row | {"p_partkey": n} for n in range(50)])]))
    assert [b.num_rows for b in out] == [16, 16, 16, 2] and [k for b in out for k in b.column("p_partkey").to_pylist()] == list(range(50))


def test_pictures_are_made_in_many_tasks(spark, tiny):
    from larder.plans import extras

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert extras.pictures(spark, tiny).select("p_partkey").rdd.getNumPartitions() == n > 1


def test_pictures_are_taken_from_a_batch_one_at_a_time(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import functions as F

    from larder.functions import codecs
    from larder.operators import reading

    empty = spark.createDataFrame([], "k long, height int, width int, pixels binary")
    tasks = []
    monkeypatch.setattr(type(empty), "mapInArrow", lambda df, run, schema: tasks.append((run, df.columns)))
    blank = empty.withColumn("steps", F.lit("invert"))
    I.processed(blank, "k", "steps"), I.marked(blank, "k", "steps"), I.cells(empty, "k"), codecs.encoded(empty, "k"), reading.regions_of(blank, "k", "steps")
    n, side = 200, 400
    given = {"key": pa.array(range(n)), "height": pa.array([side] * n, pa.int32()), "width": pa.array([side] * n, pa.int32()), "pixels": pa.array([bytes(side * side)] * n), "steps": pa.array(["invert"] * n)}
    assert len(tasks) == 5
    for run, columns in tasks:
        names = ["key", *columns[1:]]
        batch = pa.RecordBatch.from_arrays([given[c] for c in names], names)
        tracemalloc.start()
        assert sum(b.num_rows for b in run([batch])) in (0, n)
        assert tracemalloc.get_traced_memory()[1] < 20_000_000  # all pixels of the batch are 32 MB
        tracemalloc.stop()


def test_lists_of_steps_share_what_they_begin_with(monkeypatch):
    image = np.random.default_rng(4).integers(0, 256, (40, 50)).astype(np.uint8)
    several = ["grayscale; median_blur kernel_size=3; invert", "", "grayscale; median_blur kernel_size=3", "grayscale; median_blur kernel_size=3; otsu_threshold", "invert", "grayscale; median_blur kernel_size=5", "invert"]
    plain, made, apply = {steps: I.apply_steps(image, steps) for steps in several}, [], I.apply_steps
    monkeypatch.setattr(I, "apply_steps", lambda image, steps: made.append(steps) or apply(image, steps))
    found = dict(I.after_each(image, several))
    assert sorted(found) == list(range(7)) and all((found[at] == plain[steps]).all() for at, steps in enumerate(several))
    assert sorted(made) == ["grayscale", "invert", "invert", "median_blur kernel_size=3", "median_blur kernel_size=5", "otsu_threshold"]
    with pytest.raises(ValueError):
        list(I.after_each(image, ["invert", "blur"]))


def test_equal_pictures_are_worked_on_once(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], "k long, height int, width int, pixels binary").withColumn("steps", F.array(F.lit("invert"), F.lit("")))
    tasks, made, apply = [], [], I.apply_steps
    monkeypatch.setattr(type(empty), "mapInArrow", lambda df, run, schema: tasks.append(run))
    monkeypatch.setattr(I, "apply_steps", lambda image, steps: made.append(steps) or apply(image, steps))
    monkeypatch.setattr(I, "MOST_KNOWN", 2)
    I._known.clear()
    I.processed(empty, "k", "steps")
    dark, light, cut = bytes(12), bytes([200] * 12), bytes(5)
    given = [(1, 3, 4, dark), (2, 3, 4, light), (3, 3, 4, dark), (4, 4, 3, dark), (5, 3, 4, cut), (6, 3, 4, None), (7, 3, 4, light)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("key", "height", "width", "pixels"), row)) | {"steps": ["invert", ""]} for row in given])
    out = [tuple(r.values())[:5] for b in tasks[0]([batch, batch.slice(0, 0)]) for r in b.to_pylist()]
    assert out[:6] == [(1, "invert", 3, 4, 0.0), (1, "", 3, 4, 1.0), (2, "invert", 3, 4, 1.0), (2, "", 3, 4, 0.0), (3, "invert", 3, 4, 0.0), (3, "", 3, 4, 1.0)]
    assert out[6:8] == [(4, "invert", 4, 3, 0.0), (4, "", 4, 3, 1.0)] and out[8:12] == [(5, "invert", None, None, None), (5, "", None, None, None), (6, "invert", None, None, None), (6, "", None, None, None)]
    assert out[12:] == [(7, "invert", 3, 4, 1.0), (7, "", 3, 4, 0.0)]
    assert made == ["invert"] * 4 and len(I._known) <= 2  # three pictures, and one that was forgotten


def test_pixels_are_sent_once_for_all_steps(spark, tiny):
    from larder.plans import extras

    for query in (extras.i01, extras.i27):
        assert "Generate" not in query(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
