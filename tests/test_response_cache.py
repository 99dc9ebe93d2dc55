"""The cache as a store: putting, overwriting, getting, damage, pruning."""

import pathlib

from pyspark.sql import functions as F

from larder.sources.response_cache import ResponseCache

SHAS = [f"{i * 37 % 256:02x}{i:062d}" for i in range(60)]
DOC, TEXT = "DOCUMENT_TEXT_DETECTION", "TEXT_DETECTION"


def put(cache, rows):
    cache.put(cache.spark.createDataFrame(rows, "sha256 string, feature string, hints array<string>, response string, size int, put_at long"))


def got(cache, rows):
    asked = cache.spark.createDataFrame(rows, "sha256 string, feature string, hints array<string>")
    return [r[0] for r in cache.get(asked.withColumn("n", F.monotonically_increasing_id())).orderBy("n").select("response").collect()]


def test_put_get_and_overwrite(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path / "cache"))
    assert got(cache, [(SHAS[0], DOC, ["pt"])]) == [None]
    put(cache, [(s, DOC, ["pt", "en"], f'{{"n": {i}, "á": "ç"}}', 10, 1) for i, s in enumerate(SHAS)])
    assert got(cache, [(s, DOC, ["pt", "en"]) for s in SHAS]) == [f'{{"n": {i}, "á": "ç"}}' for i in range(60)]
    # just the same feature and hints in their order
    assert got(cache, [(SHAS[1], TEXT, ["pt", "en"]), (SHAS[1], DOC, ["en", "pt"]), (SHAS[1], DOC, ["pt"]), (SHAS[1], DOC, None), (None, DOC, ["pt", "en"]), ("00", DOC, ["pt", "en"])]) == [None] * 6
    # putting again overwrites, also with another feature; earlier entries stay out of the way
    put(cache, [(SHAS[2], DOC, ["pt", "en"], '{"again": 1}', 10, 2), (SHAS[3], TEXT, [], '{"other": 1}', 10, 3), (None, DOC, [], "{}", 1, 4), (SHAS[4], DOC, [], None, 1, 4)])
    asks = [(SHAS[2], DOC, ["pt", "en"]), (SHAS[3], DOC, ["pt", "en"]), (SHAS[3], TEXT, []), (SHAS[4], DOC, ["pt", "en"])]
    want = ['{"again": 1}', None, '{"other": 1}', '{"n": 4, "á": "ç"}']
    assert got(cache, asks) == want
    before = cache.entries.count()
    cache.compact(SHAS[2][:2])
    assert cache.entries.count() == before - 1 and got(cache, asks) == want
    cache.compact()
    assert cache.entries.count() == 60 and got(cache, asks) == want and not (tmp_path / "cache-aside").exists()


def test_what_cannot_be_read_is_a_miss(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path / "cache"))
    put(cache, [(s, DOC, [], "{}", 1, 1) for s in SHAS[:10]] + [(SHAS[10], DOC, [], "{cut", 1, 1)])
    hurt = SHAS[0][:2]
    for file in pathlib.Path(tmp_path, "cache", f"prefix={hurt}").glob("*.parquet"):
        file.write_bytes(file.read_bytes()[:40])
    lost = [s[:2] == hurt for s in SHAS[:10]]
    assert got(cache, [(s, DOC, []) for s in SHAS[:11]]) == [None if x else "{}" for x in lost] + [None]
    put(cache, [(SHAS[0], DOC, [], '{"new": 1}', 1, 2), (SHAS[10], DOC, [], '{"new": 2}', 1, 2)])
    assert got(cache, [(SHAS[0], DOC, []), (SHAS[1], DOC, []), (SHAS[10], DOC, [])]) == ['{"new": 1}', "{}", '{"new": 2}']


def test_lookups_read_their_partitions_only(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path / "cache"))
    put(cache, [(s, DOC, [], "{}", 1, 1) for s in SHAS])
    asked = spark.createDataFrame([(SHAS[5], DOC, []), (SHAS[6], DOC, [])], "sha256 string, feature string, hints array<string>")
    scan = next(x for x in cache.get(asked)._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert f"PartitionFilters: [isnotnull(prefix" in scan or "PartitionFilters: [prefix" in scan
    files = cache.lookup(asked).select("sha256", F.input_file_name().alias("f")).collect()
    assert {r["f"].split("prefix=")[1][:2] for r in files} == {SHAS[5][:2], SHAS[6][:2]}
