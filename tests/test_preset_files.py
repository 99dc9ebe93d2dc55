"""Preset files through the data source: what is read, and what is wrong with the others."""

import json

from pyspark.sql import functions as F

from larder.sources import preset_files as P
from larder.sources import presets


def test_files_of_presets(spark, tmp_path):
    good = {"name": "b", "kind": "linear_table", "steps": [{"op": "clahe", "clip_limit": 2.5, "tile_grid_size": [6, 8]}, {"name": "invert"}], "ocr": {"psm": 6, "lang": "por"}, "quality_thresholds": {"min_hits": 3}, "priority": 7, "description": "d"}
    files = {
        "table/b.json": good,
        "table/deep/c.json": good | {"name": "c", "kind": "cloud_vision", "priority": "12"},
        "category=text/x=1/d.json": good | {"name": "d", "kind": "cloud_vision"},
        "ingredients/e.json": {k: v for k, v in good.items() if k != "priority"} | {"name": "e", "kind": "linear_text"},
        "elsewhere/f.json": good,
        "g.json": good,
        "table/_h.json": good,
        "text/i.json": {k: v for k, v in good.items() if k not in ("name", "ocr")},
        "text/j.json": good | {"kind": "oil"},
        "text/k.json": good | {"steps": 5},
        "text/l.json": [good],
    }
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "text/m.json").write_text(json.dumps(good)[:-1])
    (tmp_path / "text/n.json").write_bytes(b"\xff\xfe")
    rows = P.load(spark, str(tmp_path)).collect()
    assert sorted((r["category"], r["name"], r["kind"], r["priority"]) for r in rows if r["error"] is None) == [("table", "b", "linear_table", 7), ("table", "c", "cloud_vision", 12), ("text", "d", "cloud_vision", 7), ("text", "e", "linear_text", 100)]
    b = next(r for r in rows if r["name"] == "b")
    assert (b["steps"], b["ocr"], b["thresholds"], b["description"], b["file"]) == ("clahe clip_limit=2.5 tile_grid_size=6,8; invert", {"psm": "6", "lang": "por"}, {"min_hits": "3"}, "d", "b.json")
    assert {r["file"]: r["error"] for r in rows if r["error"]} == {"i.json": "missing: name, ocr", "j.json": "unknown kind: oil", "k.json": "a value of the wrong type", "l.json": "not an object", "m.json": "not JSON", "n.json": "not JSON"}
    assert P.load(spark, str(tmp_path)).rdd.getNumPartitions() == 10  # a file each
    assert P.load(spark, str(tmp_path / "none")).collect() == []
    order = [r["name"] for r in presets.ordered(P.load(spark, str(tmp_path)).where("error is null and category = 'table'")).collect()]
    assert order == ["b", "c"]


def test_many_files_are_read_in_few_tasks(spark, tmp_path):
    body = json.dumps({"name": "n", "kind": "linear_text", "steps": [], "ocr": {}})
    files = spark.range(500).selectExpr("'text' as category", "id as file", "id").withColumn("body", F.when(F.col("id") % 9 == 0, "{").otherwise(F.lit(body)))
    P.write(files, str(tmp_path))
    P.write(files, str(tmp_path))  # a second attempt
    found = P.load(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == P.MOST_PARTITIONS
    assert sorted((int(r["file"]), r["name"], r["error"]) for r in found.collect()) == [(n, None, "not JSON") if n % 9 == 0 else (n, "n", None) for n in range(500)]


def test_presets_of_suppliers_that_share_a_name(spark, tiny, tmp_path):
    from larder.plans.attempts import s08

    supplier = spark.read.parquet(f"{tiny}/supplier.parquet")
    supplier.withColumn("s_name", F.lit("same")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(r["s_suppkey"] for r in s08(spark, str(tmp_path)).collect())
    assert got and got == sorted(r["s_suppkey"] for r in s08(spark, tiny).collect())
