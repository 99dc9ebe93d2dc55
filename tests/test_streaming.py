"""Streams in several batches: the same rows as their batch forms, and state that goes with the watermark."""

import random

from pyspark.sql import functions as F

from larder.operators.history import admissions
from larder.streaming import operators as S

SCHEMA = "key long, id long, at double"
START = 1_700_000_000.0


def batches(spark, folder, parts):
    """A file for each batch, in order, as a stream of one file a batch."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).coalesce(1).write.parquet(f"{folder}/{n}")
    stream = spark.readStream.schema(SCHEMA + ", ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return stream.parquet(str(folder))


def run(stream, folder):
    seen = []
    with S.rocksdb(stream.sparkSession):
        q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start()
        q.awaitTermination()
    for p in q.recentProgress:
        seen += [s["numRowsTotal"] for s in p["stateOperators"]]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows"), seen


def test_limiter_in_batches_and_its_state(spark, tmp_path):
    r = random.Random(3)
    parts, n = [], 0
    for b in range(4):  # each batch begins long after the last one ended, so that all earlier state is over
        rows = []
        for _ in range(60):
            n += 1
            rows.append((r.randrange(5 * b, 5 * b + 6), n, START + 10_000 * b + round(r.random() * 300, 3)))
        parts.append(sorted(rows, key=lambda x: x[2]))
    out, state = run(S.limited(batches(spark, tmp_path / "in", parts), "key", "ts", 3, 20.0), tmp_path)
    got: dict = {}
    for x in out.collect():
        got.setdefault(x["key"], []).append((round(x["requested"], 3), round(x["admitted"], 3)))
    for k in {x[0] for p in parts for x in p}:
        times = sorted(x[2] for p in parts for x in p if x[0] == k)
        assert sorted(got[k]) == sorted((round(t, 3), round(a, 3)) for t, a in zip(times, admissions(times, 3, 20.0)))
    # five or six keys a batch have a list and a timer or so each; without timers there would be four times as many
    assert len(state) >= 4 and max(state) < 2.5 * max(state[:2])


def test_purge_gives_each_token_once(spark, tmp_path):
    r = random.Random(4)
    parts = [[(r.randrange(6), 100 * b + i, START + 50 * b + round(r.random() * 50, 3)) for i in range(40)] for b in range(5)]
    out, state = run(S.purged(batches(spark, tmp_path / "in", parts), "key", "id", "ts", 60.0), tmp_path)
    last = max(int(x[2] * 1000) for p in parts for x in p)
    want = sorted(x[1] for p in parts for x in p if int(x[2] * 1000 + 1e-6) + 60_000 <= last)
    got = sorted(x["token"] for x in out.collect())
    assert got == want and 60 < len(got) < 180
    # what was given is forgotten: the state is no larger than what is still valid, not all there ever was
    assert state[-1] < state[0] * 3
