"""Rows, columns and text of boxes; cascade winners; annotations; error rates; images; plans."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import annotations, cascade, layout, lookup, metrics, search
from larder.sources import presets


def test_an_anchor_moves_only_with_a_new_row(spark):
    ys = [0, 6, 12, 13, 20, 26, 27]
    df = spark.createDataFrame([(1, i, y, 0, 10) for i, y in enumerate(ys)], "page int, cell int, y int, x int, h int")
    got = {r["cell"]: r["row"] for r in layout.rows_by_anchor(df, "page", "y", "x", "h").collect()}
    assert [got[i] for i in range(7)] == [0, 0, 1, 1, 1, 2, 2]  # tolerance 8: 20 is near 12, 26 is not


def test_first_fitting_row_and_tabs(spark):
    words = [("a", 0, 0, 30, 10), ("b", 80, 1, 110, 11), ("c", 0, 20, 35, 30), ("d", 82, 21, 110, 31), ("e", 40, 22, 70, 32)]
    df = spark.createDataFrame([(1, *w) for w in words], "page int, text string, x1 int, y1 int, x2 int, y2 int")
    assert layout.table_text(df, "page").first()["text"] == "a\tb\nc e\td"
    gap10 = spark.createDataFrame([(1, "a", 0, 0, 30, 10), (1, "b", 40, 0, 60, 10), (1, "c", 0, 20, 30, 30), (1, "d", 40, 20, 60, 30)], df.schema)
    assert layout.table_text(gap10, "page").first()["text"] == "a b\nc d"  # ten pixels separate, but a tab needs more


def test_columns_and_last_cell_of_a_slot(spark):
    df = spark.createDataFrame([(1, 1, 0, 20), (1, 2, 8, 20), (1, 3, 16, 20), (1, 4, 60, 20)], "page int, cell int, x int, w int")
    columns = layout.columns_by_gap(df, "page", "x", "w")
    assert sorted((r["column"], r["center"]) for r in columns.collect()) == [(0, 18), (1, 70)]
    near = layout.nearest_columns(df, columns, "page", "x", "w").withColumn("row", F.lit(0))
    assert sorted(tuple(r) for r in layout.slots(near, "page", "x").collect()) == [(1, 0, 0, 3), (1, 0, 1, 4)]


@pytest.mark.parametrize("stop, want", [(True, {1: 1, 2: 0, 3: 2}), (False, {1: 2, 2: 0, 3: 2})])
def test_winners(spark, stop, want):
    data = [(1, 0, False, 0.9), (1, 1, True, 0.5), (1, 2, False, 0.95), (2, 0, False, 0.4), (2, 1, False, 0.4), (3, 0, False, 0.1), (3, 2, True, 0.2)]
    df = spark.createDataFrame(data, "k int, i int, passed boolean, score double")
    got = cascade.winners(df, "k", "i", stop)
    assert {r["k"]: r["winner"] for r in got.collect()} == want
    if stop:
        assert {r["k"]: r["ran"] for r in got.collect()}[1] == 2


def test_scores(spark):
    text = "Valor energético 10 carboidratos proteinas gorduras totais"
    df = spark.createDataFrame([(text, 80.0), ("", 100.0), ("sodio", 10.0)], "t string, c double")
    r = cascade.scored(df, "t", "c").collect()
    assert (r[0]["keyword_hits"], r[0]["passed"]) == (4, True) and abs(r[0]["score"] - (0.4 + 4 / 6 * 0.4 + len(text) / 500 * 0.1)) < 1e-12
    assert (r[1]["keyword_hits"], r[1]["passed"], r[1]["score"]) == (0, False, 0.5) and r[2]["keyword_hits"] == 1


def test_annotations(spark):
    box = {"vertices": [{"x": 5, "y": 2}, {"y": 9}]}
    word = lambda c: {"confidence": c, "boundingBox": box}
    a = {"fullTextAnnotation": {"text": "T", "pages": [{"blocks": [{"paragraphs": [{"words": [word(0.5), word("high"), word(None)]}, {}]}, {}]}]}, "textAnnotations": [{"description": "all"}, {"description": "w", "boundingPoly": box}, {"description": ""}, {"description": "no box"}]}
    b = {"full_text_annotation": {"pages": [{"blocks": [{"paragraphs": [{"words": [word(True)]}]}]}]}}
    df = spark.createDataFrame([(1, json.dumps(a)), (2, json.dumps(b)), (3, "{}")], "id int, p string")
    got = {r["id"]: tuple(r)[1:] for r in annotations.statistics(df, "id", "p").collect()}
    assert got == {1: (2, 2, 3, 50.0, None), 2: (1, 1, 1, 0.0, "no_numeric_confidences"), 3: (0, 0, 0, 0.0, None)}
    assert [tuple(r) for r in annotations.word_tokens(df, "id", "p").collect()] == [(1, 1, "w", 0, 2, 5, 9)]
    texts = df.select(annotations.text_of(annotations.parsed(F.col("p")), F.lit("TEXT_DETECTION")), annotations.text_of(annotations.parsed(F.col("p")), F.lit("?"))).collect()
    assert [tuple(t) for t in texts] == [("all", "T"), ("", ""), ("", "")]


def test_error_rates(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), ("", ""), ("", "a"), ("10 mg sal", "10mg sal"), ("a", "b c d")], "r string, f string")
    got = [(tuple(r["edits"]), r["wer"], round(r["cer"], 4)) for r in metrics.error_rates(df, "r", "f").collect()]
    assert got == [((1, 0, 1), 2 / 3, 0.6), ((0, 0, 0), 0.0, 0.0), ((0, 0, 1), 1.0, 1.0), ((0, 0, 0), 0.0, 0.0), ((1, 0, 2), 3.0, 5.0)]


def test_presets(spark, tmp_path):
    assert presets.presets(spark).groupBy("category").count().count() == 3 and presets.presets(spark).count() == 23
    for category, name, priority in (("table", "b", 7), ("text", "a", None)):
        (tmp_path / category).mkdir()
        body = {"name": name, "kind": "linear_table", "steps": [{"op": "invert", "name": "x"}, {"op": "clahe", "clip_limit": 2.5, "tile_grid_size": [6, 8]}], "ocr": {"psm": "6"}} | ({"priority": priority} if priority else {})
        (tmp_path / category / f"{name}.json").write_text(json.dumps(body))
    assert sorted((r["category"], r["name"], r["priority"]) for r in presets.read_presets(spark, str(tmp_path)).collect()) == [("table", "b", 7), ("text", "a", 100)]
    assert {r["steps"] for r in presets.read_presets(spark, str(tmp_path)).collect()} == {"invert; clahe clip_limit=2.5 tile_grid_size=6,8"}
    (tmp_path / "w.txt").write_text("# words\nSal\t5\n\ntrigo\nsal\t7\n")
    assert {r["word"]: r["n"] for r in presets.read_vocabulary(spark, str(tmp_path / "w.txt")).collect()} == {"sal": 7, "trigo": 100}


def test_plans(spark, tiny):
    part = spark.read.parquet(f"{tiny}/part.parquet").select(F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("barcode"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(search.search(part, "blue bolt"))
    assert [search.kind_of(q) for q in ("", "a", "ab", "12345678", "coca")] == ["empty", "empty", "contains", "exact", "fuzzy"]
    assert search.search(part, " ").count() == 0
    assert search.search(part, "0000000000003").count() == 1
    with pytest.raises(ValueError):
        search.page(part, [F.asc("barcode")], 0, 10)
    upload = spark.createDataFrame([(11, "image/png"), (0, "image/png"), (5, "text/plain"), (5, None)], "n int, t string")
    assert [r[0] for r in upload.select(lookup.upload_verdict(F.col("n"), F.col("t"), 10)).collect()] == [413, 400, 400, 200]


def plain_rows(words):
    """(rows, gaps, separators, text) of one page's words (text, x1, y1, x2, y2), word by word."""
    heights = sorted(y2 - y1 for _, _, y1, _, y2 in words if y2 > y1)
    most, rows = max(6, int(heights[len(heights) // 2] * 0.55)) if heights else 6, []
    for c, x1, x2, _, _, text in sorted(((y1 + y2) // 2, x1, x2, y1, y2, t) for t, x1, y1, x2, y2 in words):
        row = next((r for r in rows if abs(c - sum(w[1] for w in r) / len(r)) <= most), None)
        rows.append(row := []) if row is None else None
        row.append((x1, c, x2, text))
    rows = [sorted(r) for r in rows]
    gaps = [(n, i + 1, r[i - 1][2], r[i][0]) for n, r in enumerate(rows) for i in range(1, len(r))]
    taken = {}
    for n, _, start, stop in gaps:
        for x in range(start, stop) if stop - start >= 10 else ():
            taken.setdefault(x, set()).add(n)
    shared = {x: len(r) for x, r in taken.items() if len(r) >= 2}
    tabs = {(n, place) for n, place, start, stop in gaps if stop - start > 10 and any(x in shared for x in range(start, stop))}
    text = "\n".join("".join(("" if i == 0 else "\t" if (n, i + 1) in tabs else " ") + w[3] for i, w in enumerate(r)) for n, r in enumerate(rows))
    return rows, gaps, shared, text


def test_pages_at_once_as_word_by_word(spark):
    import random

    rng = random.Random(5)
    pages = {k: [] for k in range(60)}
    for k, words in pages.items():
        for i in range(rng.choice((1, 2, 12, 90))):
            x, y = rng.randrange(300), rng.randrange(120)
            words.append((rng.choice("abç") * rng.randrange(1, 3), x, y, x + rng.randrange(-20, 60), y + rng.randrange(-2, 25)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # pages go on in other batches
    try:
        df = spark.createDataFrame([(k, *w) for k, words in pages.items() for w in words], "page int, text string, x1 int, y1 int, x2 int, y2 int")
        want = {k: plain_rows(words) for k, words in pages.items()}
        assert {r["page"]: r["text"] for r in layout.table_text(df, "page").collect()} == {k: w[3] for k, w in want.items()}
        assert sorted(map(tuple, layout.rows_by_mean(df, "page").select("page", "row", "place", "x1", "c", "x2", "text").collect())) == [(k, n, i, *w) for k, v in want.items() for n, r in enumerate(v[0]) for i, w in enumerate(r, 1)]
        assert sorted(map(tuple, layout.gaps(df, "page").collect())) == sorted((k, *g) for k, v in want.items() for g in v[1])
        assert sorted(map(tuple, layout.separators(df, "page").collect())) == sorted((k, x, n) for k, v in want.items() for x, n in v[2].items())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for found in (layout.table_text, layout.rows_by_mean, layout.gaps, layout.separators):  # a page is shuffled once, and pixels not at all
        assert found(df, "page")._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
        assert found(df, "page")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_words_without_boxes_keep_their_page(spark):
    df = spark.createDataFrame([(None, "a", None, 0, 5, 10), (None, None, 40, 0, 60, 10), (1, "b", 0, None, 5, 10)], "page int, text string, x1 int, y1 int, x2 int, y2 int")
    assert sorted((r["page"] or 0, r["text"]) for r in layout.table_text(df, "page").collect()) == [(0, "a"), (1, "b")]
