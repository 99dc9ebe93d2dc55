"""Word boxes and cells to rows and columns (W-02 to W-04, W-06, A-11 to A-13, F-35, J-15, O-09)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.sources.options import SIDE

#: Least tolerances and their factors; least gap in pixels, least rows that share it.
CELL_ROWS, DETECTED_ROWS, WORD_ROWS, CELL_COLUMNS = (8, 0.5), (10, 0.5), (6, 0.55), (10, 0.4)
LEAST_GAP, LEAST_ROWS = 10, 2
#: Bounds of a cell's share of the picture, and its least sides.
CELL_SHARE, LEAST_CELL = (0.001, 0.5), (20, 12)


def tolerance(size: Column, rule: tuple[int, float]) -> Column:
    """A-12: a share of a size, cut to a whole number, but at least the rule's least."""
    return F.greatest(F.lit(rule[0]), (size * F.lit(rule[1])).cast("int"))


def clamped(start: Column, stop: Column, pad: Column, size: Column) -> tuple[Column, Column]:
    """F-41: a stretch with padding on both sides, kept within 0 and a side's size."""
    return F.greatest(start - pad, F.lit(0)), F.least(stop + pad, size)


def fitted(width: Column, height: Column, most: int = SIDE) -> tuple[Column, Column]:
    """F-42: a picture's sides, cut to whole numbers, scaled so that the longer one is at most this long; 0 is no limit."""
    if not most:
        return width, height
    longer = F.greatest(width, height)
    fit = lambda side: F.when(longer > most, (side * F.lit(float(most)) / longer).cast("int")).otherwise(side)
    return fit(width), fit(height)


def cells_that_count(boxes: DataFrame, w: str, h: str, area: Column, share: tuple[float, float] = CELL_SHARE, least: tuple[int, int] = LEAST_CELL) -> DataFrame:
    """P-19: boxes of at least these sides that cover a share of the picture within bounds, both included."""
    return boxes.where((F.col(w) >= least[0]) & (F.col(h) >= least[1]) & (F.col(w) * F.col(h) / area).between(*share))


def best_box(boxes: DataFrame, key: str, box: str, score: Column) -> DataFrame:
    """O-08: each page's box with the highest score, the first by number among equals."""
    best = F.max(F.struct(score.alias("s"), (-F.col(box)).alias("b")))
    return boxes.groupBy(key).agg((-best["b"]).alias(box))


def reading_places(cells: DataFrame, key: str, *order: str) -> DataFrame:
    """O-09: cells with their place in reading order."""
    return cells.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def upper_median(values: Column) -> Column:
    """A-11: of an even number of values the larger middle one."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def anchored(positions: Column, most: Column) -> Column:
    """W-03: row numbers of sorted positions; a new row begins where a position is too far from its row's first."""
    start = F.struct(F.lit(-1).alias("row"), F.lit(0).cast("int").alias("anchor"), F.array().cast("array<int>").alias("rows"))

    def step(s: Column, y: Column) -> Column:
        fresh = (s["row"] < 0) | (F.abs(y - s["anchor"]) > most)
        row = F.when(fresh, s["row"] + 1).otherwise(s["row"])
        return F.struct(row.alias("row"), F.when(fresh, y).otherwise(s["anchor"]).alias("anchor"), F.concat(s["rows"], F.array(row)).alias("rows"))

    return F.aggregate(positions, start, step, lambda s: s["rows"])


def rows_by_anchor(cells: DataFrame, key: str, y: str, x: str, h: str, rule: tuple[int, float] = CELL_ROWS) -> DataFrame:
    """W-03, O-09: cells of each page with a row number, in reading order. A page's cells are one list."""
    listed = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(y).cast("int").alias("y"), F.col(x).cast("int").alias("x"), F.col(h).cast("int").alias("h"), "cell"))).alias("c"), F.avg(h).alias("mean"))
    ys = F.transform("c", lambda c: c["y"])
    numbered = listed.select(key, F.explode(F.arrays_zip(F.col("c"), anchored(ys, tolerance(F.col("mean"), rule)).alias("row"))).alias("z"))
    return numbered.select(key, F.col("z.c.cell").alias("cell"), F.col("z.c.y").alias("y"), F.col("z.c.x").alias("x"), F.col("z.row").alias("row"))


def columns_by_gap(cells: DataFrame, key: str, x: str, w: str) -> DataFrame:
    """W-02: (key, column, center): a new column begins where a center is too far from the one before it; a column's
    center is the whole mean of its members'. Equal centers are counted together, in whatever order they come."""
    mean = Window.partitionBy(key)
    centers = cells.select(key, (F.col(x) + F.expr(f"{w} div 2")).cast("int").alias("c"), F.avg(w).over(mean).alias("mean"))
    order = Window.partitionBy(key).orderBy("c")
    jump = F.when(F.col("c") - F.lag("c").over(order) > tolerance(F.col("mean"), CELL_COLUMNS), 1).otherwise(0)
    numbered = centers.withColumn("jump", jump).withColumn("column", F.sum("jump").over(order.rangeBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.groupBy(key, "column").agg((F.floor(F.sum("c") / F.count(F.lit(1)))).cast("int").alias("center"))


def nearest_columns(cells: DataFrame, columns: DataFrame, key: str, x: str, w: str) -> DataFrame:
    """J-15: each cell's nearest column, the first among equals."""
    listed = columns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("column", "center"))).alias("cs"))
    near = F.array_min(F.transform("cs", lambda c: F.struct(F.abs(c["center"] - (F.col(x) + F.expr(f"{w} div 2"))).alias("d"), c["column"].alias("column"))))
    return cells.join(listed, key).withColumn("column", near["column"]).drop("cs")


def slots(cells: DataFrame, key: str, x: str) -> DataFrame:
    """J-15: of cells that fall in the same row and column the last one, by x, stays."""
    return cells.groupBy(key, "row", "column").agg(F.max(F.struct(F.col(x).alias("x"), "cell"))["cell"].alias("cell"))


class _Page:
    """Words of whole pages, sorted by page, row, x1, center, x2 and text, as arrays that run over all pages of a batch at once."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        """Of words (key, text, x1, x2, y1, y2), those of a key one after another."""
        ids = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        page = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(ids))))
        x1, x2, y1, y2 = (batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5))  # null: NaN
        words = batch.column(1).dictionary_encode(null_encoding="encode")
        rank = np.empty(len(words.dictionary), np.int64)
        rank[pc.sort_indices(words.dictionary.cast(pa.binary()), null_placement="at_start")] = np.arange(len(rank))
        text, first = rank[words.indices.to_numpy()], lambda v: np.where(np.isnan(v), -np.inf, v)  # nulls sort first
        c = np.trunc((y1 + y2) / 2)
        order = np.lexsort((text, first(y2), first(y1), first(x2), first(x1), first(c), page))
        row = self._walk(c[order], begin, page, self._tolerances(y2 - y1, page, len(begin)))
        again = np.lexsort((text[order], first(x2[order]), first(c[order]), first(x1[order]), row, page))
        order = order[again]
        self.words, self.row, self.page, self.begin = batch.take(pa.array(order)), row[again], page, begin
        self.x1, self.x2, self.c = x1[order], x2[order], c[order]
        fresh = np.concatenate([[True], (self.page[1:] != self.page[:-1]) | (self.row[1:] != self.row[:-1])])
        at = np.arange(len(fresh))
        self.fresh, self.place = fresh, at - np.maximum.accumulate(np.where(fresh, at, 0)) + 1
        self.start = np.where(fresh, np.nan, np.concatenate([[np.nan], self.x2[:-1]]))

    @staticmethod
    def _tolerances(heights: np.ndarray, page: np.ndarray, pages: int) -> np.ndarray:
        """A-11, A-12: by each page's upper median of heights above 0."""
        above = heights > 0
        h, p = heights[above], page[above]
        h, n = h[np.lexsort((h, p))], np.bincount(p, minlength=pages)
        most = np.full(pages, float(WORD_ROWS[0]))
        some = n > 0
        most[some] = np.maximum(WORD_ROWS[0], np.trunc(h[(np.cumsum(n) - n + n // 2)[some]] * WORD_ROWS[1]))
        return most

    @staticmethod
    def _walk(c: np.ndarray, begin: np.ndarray, page: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The row of each word: the n-th words of all pages find theirs at once, longest pages first."""
        size = np.diff(np.append(begin, len(c)))
        pages = np.argsort(-size, kind="stable")
        size, begin, most = size[pages], begin[pages], most[pages, None]
        out, used = np.empty(len(c), np.int32), np.zeros(len(pages), np.int32)
        sums, counts = np.full((len(pages), 4), np.inf), np.ones((len(pages), 4))
        for n in range(size[0] if len(size) else 0):
            some = int(np.searchsorted(-size, -n, "left"))  # pages with more than n words
            if n and used[:some].max() == sums.shape[1]:
                wider = ((0, 0), (0, sums.shape[1]))
                sums, counts = np.pad(sums[:some], wider, constant_values=np.inf), np.pad(counts[:some], wider, constant_values=1)
            y, each = c[begin[:some] + n], np.arange(some)
            near = np.abs(y[:, None] - sums[:some] / counts[:some]) <= most[:some]
            found = near.any(axis=1)
            row = np.where(found, near.argmax(axis=1), used[:some])
            sums[each, row] = np.where(found, sums[each, row], 0) + y
            counts[each, row] += found
            used[:some] += ~found
            out[begin[:some] + n] = row
        return out

    def wide(self) -> np.ndarray:
        """Where the gap before a word is wide enough to part columns."""
        return self.x1 - self.start >= LEAST_GAP

    def shared(self) -> tuple[np.ndarray, ...]:
        """A-13: (page, start, stop, n) of the stretches that wide gaps of n rows, LEAST_ROWS or more, have in common, from left to right; they touch where n changes."""
        at = np.flatnonzero(self.wide())
        page, row, start, stop = self.page[at], self.row[at], self.start[at].astype(np.int64), self.x1[at].astype(np.int64)
        order = np.lexsort((start, row, page))
        page, row, start, stop = page[order], row[order], start[order], stop[order]
        if not len(page):
            return page, start, stop, start
        # gaps of a row that overlap count once: what ends before a gap of its row begins is left behind
        group = np.cumsum(np.concatenate([[True], (page[1:] != page[:-1]) | (row[1:] != row[:-1])]))
        width = int(stop.max() - start.min()) + 1
        reach = np.maximum.accumulate(stop - start.min() + group * width) - group * width + start.min()
        start = np.concatenate([start[:1], np.where(group[1:] == group[:-1], np.maximum(start[1:], np.minimum(reach[:-1], stop[1:])), start[1:])])
        x, edge = np.concatenate([start, stop]), np.repeat([1, -1], len(start))
        page = np.concatenate([page, page])
        order = np.lexsort((x, page))
        page, x, n = page[order], x[order], np.cumsum(edge[order])
        last = np.append((page[1:] != page[:-1]) | (x[1:] != x[:-1]), True)  # the sum after all edges of a place
        page, x, n = page[last], x[last], n[last]
        stop = np.append(x[1:], 0)
        kept = (n >= LEAST_ROWS) & (np.append(page[1:], -1) == page)
        return page[kept], x[kept], stop[kept], n[kept]

    def tabs(self) -> np.ndarray:
        """F-35: where the gap before a word is wider than the least and crosses a separator."""
        page, start, stop, _ = self.shared()
        at = np.flatnonzero(self.x1 - self.start > LEAST_GAP)
        if not len(page) or not len(at):
            return np.zeros(len(self.page), bool)
        low = min(start.min(), self.start[at].min())
        width = max(stop.max(), self.x1[at].max()) - low + 1
        place = lambda p, v: p * width + (v - low)
        before = np.searchsorted(place(page, start), place(self.page[at], self.x1[at]), "left") - 1  # the last stretch that begins before the gap's end
        ends = place(page, stop)[np.maximum(before, 0)]
        out = np.zeros(len(self.page), bool)
        out[at] = (before >= 0) & (ends > place(self.page[at], self.start[at]))
        return out


def _whole(column: np.ndarray) -> pa.Array:
    return pa.array(np.where(np.isnan(column), 0, column).astype(np.int32), pa.int32(), mask=np.isnan(column))


def _by_page(words: DataFrame, key: str, schema: str, made: Callable[[_Page], dict[str, pa.Array]]) -> DataFrame:
    """What ``made`` finds in pages of words (key, text, x1, x2, y1, y2): one shuffle, by page; a task takes pages in turn, each whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the page that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            other = bool(held) and held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py()
            cut = int(cuts[-1]) if len(cuts) else 0
            if cut or other:
                yield pa.RecordBatch.from_pydict(made(_Page(pa.concat_batches([*held, batch.slice(0, cut)]))))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield pa.RecordBatch.from_pydict(made(_Page(pa.concat_batches(held))))

    paged = words.select(F.col(key).alias("key"), "text", *(F.col(c).cast("int").alias(c) for c in ("x1", "x2", "y1", "y2")))
    kind = paged.schema["key"].dataType.simpleString()
    return paged.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def rows_by_mean(words: DataFrame, key: str) -> DataFrame:
    """W-04, A-11: (key, text, x1, x2, c, row, place) of words (key, text, x1, y1, x2, y2): a word, by center and x, goes to
    the first row whose running mean is near enough, else begins a row."""

    def made(p: _Page) -> dict[str, pa.Array]:
        own = {n: p.words.column(i) for i, n in enumerate(("key", "text", "x1", "x2"))}
        return own | {"c": _whole(p.c), "row": pa.array(p.row, pa.int32()), "place": pa.array(p.place, pa.int32())}

    return _by_page(words, key, "text string, x1 int, x2 int, c int, row int, place int", made)


def gaps(words: DataFrame, key: str) -> DataFrame:
    """W-06: (key, row, place, start, stop): from the word before to each word of a row of words (key, text, x1, y1, x2, y2)."""

    def made(p: _Page) -> dict[str, pa.Array]:
        at = np.flatnonzero(~np.isnan(p.start))
        return {"key": p.words.column(0).take(pa.array(at)), "row": pa.array(p.row[at], pa.int32()), "place": pa.array(p.place[at], pa.int32()), "start": _whole(p.start[at]), "stop": _whole(p.x1[at])}

    return _by_page(words, key, "row int, place int, start int, stop int", made)


def separators(words: DataFrame, key: str) -> DataFrame:
    """A-13: (key, x, n): pixels that wide gaps of at least LEAST_ROWS rows of words (key, text, x1, y1, x2, y2) have in common. Pages give
    stretches of pixels with the same n, which become pixels afterwards."""

    def made(p: _Page) -> dict[str, pa.Array]:
        page, start, stop, n = p.shared()
        return {"key": p.words.column(0).take(pa.array(p.begin[page])), "start": pa.array(start, pa.int32()), "stop": pa.array(stop, pa.int32()), "n": pa.array(n, pa.int64())}

    return _by_page(words, key, "start int, stop int, n long", made).select(key, F.explode(F.sequence("start", F.col("stop") - 1)).alias("x"), "n")


def table_text(words: DataFrame, key: str) -> DataFrame:
    """F-35: (key, text): rows of words (key, text, x1, y1, x2, y2), with a tab where a gap crosses a separator, else a space."""

    def made(p: _Page) -> dict[str, pa.Array]:
        between = np.where(p.fresh, 1, np.where(p.tabs(), 2, 3))
        between[p.begin] = 0
        text = p.words.column(1)
        pieces = pc.fill_null(pc.binary_join_element_wise(pa.array(["", "\n", "\t", " "]).take(pa.array(between)), text, ""), "")
        lists = pa.ListArray.from_arrays(pa.array(np.append(p.begin, len(between)), pa.int32()), pieces)
        return {"key": p.words.column(0).take(pa.array(p.begin)), "text": pc.binary_join(lists, "")}

    return _by_page(words, key, "text string", made)
