"""Reading labels from stored results of outside engines (S-13, I-24, I-28, I-29): what is fetched, chosen and put together.

No engine is called here: what it gave, or would give, is a table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import images, regions
from larder.functions.text import truncated
from larder.operators import annotations, layout
from larder.sources.options import FEATURES, TIMEOUT, error_of

#: What a response is kept under.
CACHE_KEY = ["sha256", "feature", "hints"]
#: Least share of the picture that a detected box has; what is read in another way, white rim around a cell.
LEAST_BOX, HEADER_MOST, RIM = 0.04, 0.5, 4


def fetched(requests: DataFrame, cache: DataFrame, outcomes: DataFrame, timeout: float = TIMEOUT) -> DataFrame:
    """S-13: (the requests' columns, cache_hit, response, called, error, message, secondary).

    ``requests`` have CACHE_KEY and ``at``, ``cache`` has CACHE_KEY and response, one row a sha256, ``outcomes`` say what the engine would
    answer to a key: response, seconds, classes of error, message. A sha256 has one slot: a request is a hit, and isn't called, if
    the slot holds its feature and hints, in order; a call that is answered takes the slot. Too long an answer counts as a
    timeout, and an error has its most telling class, the others behind it. What has no outcome is a generic error.
    """
    own = F.struct("feature", "hints")
    kept = cache.select("sha256", own.alias("kept_key"), F.col("response").alias("kept"))
    late = F.when(F.coalesce(F.col("seconds"), F.lit(0.0)) > timeout, F.array(F.lit("timeout"))).otherwise(F.array().cast("array<string>"))
    classes = F.array_union(F.coalesce("classes", F.array().cast("array<string>")), late)
    given = outcomes.select(*CACHE_KEY, F.col("response").alias("answer"), classes.alias("classes"), F.coalesce("message", F.lit("")).alias("said"))
    joined = requests.join(kept, "sha256", "left").join(given, CACHE_KEY, "left").withColumn("own", own)
    joined = joined.withColumn("fails", F.col("answer").isNull() | (F.size("classes") > 0))
    earlier = Window.partitionBy("sha256").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # a key that is answered holds the slot after its request, be it by a call or by a hit; the kept response goes with the first other one
    slot = F.last(F.when(~F.col("fails"), F.col("own")), ignorenulls=True).over(earlier)
    taken = F.coalesce(F.max(F.when(~F.col("fails") & ~F.col("own").eqNullSafe(F.col("kept_key")), 1)).over(earlier), F.lit(0))
    still = F.col("kept").isNotNull() & (taken == 0) & F.col("own").eqNullSafe(F.col("kept_key"))
    marked = joined.withColumn("still", still).withColumn("hit", still | F.coalesce(slot == F.col("own"), F.lit(False)))
    marked = marked.withColumn("e", F.when(~F.col("hit") & F.col("fails"), error_of(F.col("classes"))))
    return marked.select(
        *requests.columns,
        F.col("hit").alias("cache_hit"),
        F.when(F.col("still"), F.col("kept")).when(~F.col("fails"), F.col("answer")).alias("response"),
        (~F.col("hit")).alias("called"),
        F.col("e.error").alias("error"),
        F.when(F.col("e").isNotNull(), truncated(F.coalesce("said", F.lit("")))).alias("message"),
        F.coalesce("e.secondary", F.array().cast("array<string>")).alias("secondary"),
    )


def cache_puts(results: DataFrame) -> DataFrame:
    """S-11, S-13: what the calls leave in the cache: of each sha256 the last response of a call that was answered."""
    last = F.max_by(F.struct("feature", "hints", "response"), "at").alias("p")
    return results.where("called and error is null").groupBy("sha256").agg(last).select("sha256", "p.*")


def cloud_readings(results: DataFrame, id_col: str, reconstruct: Column | None = None, on_failure: str = "skip") -> DataFrame:
    """I-29: (id, text, mean_confidence, blocks, paragraphs, words, cache_hit, warning, error, message, secondary) of what ``fetched`` gave.

    A feature that isn't known is an error before anything is looked at. An error reads as an empty text of confidence 0, unless
    ``on_failure`` is raise. Where ``reconstruct`` holds and there are words with boxes, the text is put together from them.
    """
    known = F.col("feature").isin(*FEATURES)
    invalid = F.coalesce(~known, F.lit(True))
    error = F.when(invalid, F.lit("invalid_feature")).otherwise(F.col("error"))
    message = F.when(invalid, F.concat(F.lit("unknown feature: "), F.coalesce("feature", F.lit("none")))).otherwise(F.col("message"))
    base = results.select(id_col, "feature", F.when(~invalid, F.col("cache_hit")).otherwise(False).alias("cache_hit"), error.alias("error"), message.alias("message"), F.when(invalid, F.array().cast("array<string>")).otherwise(F.col("secondary")).alias("secondary"), F.when(error.isNull(), F.col("response")).alias("response"), (reconstruct if reconstruct is not None else F.lit(False)).alias("rebuild"))
    if on_failure == "raise":
        base = base.withColumn("response", F.when(F.col("error").isNotNull() & (F.col("error") != "invalid_feature"), F.raise_error(F.concat_ws(": ", "error", "message"))).otherwise(F.col("response")))
    answered = base.where("response is not null")
    counted = annotations.statistics(answered, id_col, "response")
    tables = layout.table_text(annotations.word_tokens(answered.where("rebuild"), id_col, "response"), id_col).withColumnRenamed("text", "table_text")
    plain = base.withColumn("plain", annotations.text_of(annotations.parsed(F.col("response")), F.col("feature")))
    joined = plain.join(counted, id_col, "left").join(tables, id_col, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    text = F.when(F.col("response").isNull(), "").otherwise(F.coalesce("table_text", "plain"))
    return joined.select(id_col, text.alias("text"), F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"), zero("blocks"), zero("paragraphs"), zero("words"), "cache_hit", "warning", "error", "message", "secondary")


def best_detection(found: DataFrame, key: str, targets: tuple[str, ...], least: float) -> DataFrame:
    """I-24: (key, x1, y1, x2, y2, confidence) of each picture's surest box, the first among equals, from rows (key, nth, label,
    confidence, left, top, right, bottom as shares, width, height). Unknown labels pass; too small boxes don't."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    wanted = F.lit(True) if not targets else F.coalesce(plain(F.col("label")), F.lit("")).isin("", *["".join(c for c in t.lower() if c.isascii() and c.isalnum()) for t in targets])
    low, high = (lambda share, side: F.greatest(F.lit(0), (F.col(share) * F.col(side)).cast("int"))), (lambda share, side: F.least(F.col(side), (F.col(share) * F.col(side)).cast("int")))
    boxes = found.where((F.col("confidence") >= least) & wanted).select(key, "nth", "confidence", "width", "height", low("left", "width").alias("x1"), low("top", "height").alias("y1"), high("right", "width").alias("x2"), high("bottom", "height").alias("y2"))
    fit = boxes.where("x2 > x1 and y2 > y1").where((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= LEAST_BOX * F.col("width") * F.col("height"))
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "nth", "x1", "y1", "x2", "y2"))
    return fit.groupBy(key).agg(best.alias("b")).select(key, "b.x1", "b.y1", "b.x2", "b.y2", (-F.col("b.c")).alias("confidence"))


def regions_of(pictures: DataFrame, key: str, category: str) -> DataFrame:
    """I-24: (key, found, x1, y1, x2, y2): the region of each picture (key, height, width, pixels) of a category, and what shows it; nulls if it
    can't be read."""
    kind = pictures.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h, w, pixels, hint in images.by_row(batch, *range(1, 5)):
                image = images.picture(h, w, pixels)
                found.append(regions.region_found(image, hint) if image is not None else (None, (None,) * 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in found], pa.string()), *(pa.array([b[i] for _, b in found], pa.int32()) for i in range(4))], ["key", "found", "x1", "y1", "x2", "y2"])

    return pictures.select(F.col(key).alias("key"), "height", "width", "pixels", F.col(category)).mapInArrow(run, f"key {kind}, found string, x1 int, y1 int, x2 int, y2 int")


def cells_of(pictures: DataFrame, key: str, steps: str, header: float = 0.0) -> DataFrame:
    """I-28: (key, part, cell, x, y, w, h, png) of pictures (key, height, width, pixels) after a preset's steps: what an engine is to read.
    Part is header (the share of the height at the top, if there is one), cell (each detected cell below it, without its rim, in white), and
    whole (all below the header, for where no cell gives text). A picture that can't be read gives no rows."""
    kind = pictures.schema[key].dataType.simpleString()
    share = max(0.0, min(header, HEADER_MOST))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [], [], [])

            def add(*values):
                for column, value in zip(rows, values):
                    column.append(value)

            for k, h, w, pixels in images.by_row(batch, *range(4)):
                image = images.picture(h, w, pixels)
                if image is None:
                    continue
                image = images.apply_steps(image, steps)
                top = int(image.shape[0] * share)
                if top:
                    add(k, "header", None, 0, 0, image.shape[1], top, images.encode_png(image[:top]))
                image = image[top:]
                for n, box in enumerate(images.detect_cells(image)):
                    crop = images.crop_cell(image, box)
                    add(k, "cell", n, *box, images.encode_png(np.pad(crop, RIM, constant_values=255)))
                add(k, "whole", None, 0, 0, image.shape[1], image.shape[0], images.encode_png(image))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.column(0).type), pa.array(rows[1], pa.string()), *(pa.array(c, pa.int32()) for c in rows[2:7]), pa.array(rows[7], pa.binary())], ["key", "part", "cell", "x", "y", "w", "h", "png"])

    return pictures.select(F.col(key).alias("key"), "height", "width", "pixels").mapInArrow(run, f"key {kind}, part string, cell int, x int, y int, w int, h int, png binary")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def cell_readings(cells: DataFrame, whole: DataFrame, key: str, headers: DataFrame | None = None) -> DataFrame:
    """I-28: (key, text, mean_confidence, cells, rows, columns) of pages.

    ``cells`` (key, cell, x, y, w, h, text, confidence, last_text, last_confidence) hold what an engine read in each cell, in
    its usual way and in the way that the last of several columns is read; ``headers`` and ``whole`` (key, text, confidence) what it read
    above the grid and on the whole page. Cells fall in rows and columns; a row's texts are joined by tabs, an absent cell's is empty,
    and rows without any text are left out. A page without text is what was read on the whole. Confidences over 0 count.
    """
    placed = layout.rows_by_anchor(cells, key, "y", "x", "h")
    columns = layout.columns_by_gap(cells, key, "x", "w")
    width = columns.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("columns"))
    near = layout.nearest_columns(placed.join(cells.select(key, "cell", "w"), [key, "cell"]), columns, key, "x", "w")
    taken = layout.slots(near, key, "x").join(width, key).join(cells.select(key, "cell", "text", "confidence", "last_text", "last_confidence"), [key, "cell"])
    last = (F.col("columns") > 1) & (F.col("column") == F.col("columns") - 1)
    read = lambda usual, other: F.when(last, F.col(other)).otherwise(F.col(usual))
    pieces = taken.select(key, "row", "column", "columns", _stripped(F.regexp_replace(F.coalesce(read("text", "last_text"), F.lit("")), "\n", " ")).alias("t"), read("confidence", "last_confidence").alias("c"))
    by_column = F.map_from_entries(F.collect_list(F.struct("column", "t")))
    listed = pieces.groupBy(key, "row", "columns").agg(by_column.alias("m"), F.max(F.col("t") != "").alias("some"), F.sum(F.when(F.col("c") > 0, F.col("c"))).alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("n"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))), "\t")
    lines = listed.select(key, "row", "columns", F.when(F.col("some"), line).alias("line"), "c", "n")
    pages = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("row", "line")))), lambda x: x["line"]), "\n").alias("grid"), F.coalesce(F.sum("c"), F.lit(0.0)).alias("c"), F.sum("n").alias("n"), F.count(F.lit(1)).cast("int").alias("rows"), F.max("columns").alias("columns"))
    counts = cells.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("cells"))
    every = whole.select(key, F.col("text").alias("all_text"), F.col("confidence").alias("all_c")).join(counts, key, "left").join(pages, key, "left")
    if headers is None:
        every = every.withColumn("head", F.lit("")).withColumn("head_c", F.lit(None).cast("double"))
    else:
        every = every.join(headers.select(key, _stripped(F.col("text")).alias("head"), F.col("confidence").alias("head_c")), key, "left")
    grid, head = F.coalesce("grid", F.lit("")), F.coalesce("head", F.lit(""))
    built = F.when(head != "", _stripped(F.concat(head, F.lit("\n"), grid))).otherwise(grid)
    empty = _stripped(built) == ""
    counted = F.when(F.col("head_c") > 0, 1).otherwise(0)
    total = F.coalesce("c", F.lit(0.0)) + F.when(F.col("head_c") > 0, F.col("head_c")).otherwise(0.0) + F.when(empty, F.coalesce("all_c", F.lit(0.0))).otherwise(0.0)
    n = F.coalesce("n", F.lit(0)) + counted + F.when(empty, 1).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.select(key, F.when(empty, F.coalesce("all_text", F.lit(""))).otherwise(built).alias("text"), F.when(n > 0, total / n).otherwise(0.0).alias("mean_confidence"), zero("cells"), zero("rows"), zero("columns"))
