"""Snapshots, windows, limits and their streaming forms."""

from pyspark.sql import functions as F

from larder.operators import history as H
from larder.streaming import operators as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_patch_tells_absent_from_null(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "z")], "k int, name string, brand string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    changes = spark.createDataFrame([(1, None, True, "n", False), (2, None, False, "y", True), (3, "c", True, None, None)], "k int, name string, set_name boolean, brand string, set_brand boolean")
    got = {r["k"]: (r["name"], r["brand"], str(r["at"])[:10]) for r in H.patch(old, changes, "k", ["name", "brand"], "at", "2024-02-02").collect()}
    assert got == {1: (None, "x", "2024-02-02"), 2: ("b", "y", "2024-02-02"), 3: ("c", "z", "2024-01-01")}


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert rows(H.upsert(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(H.insert_new(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(H.conflicts(old, new, ["k"])) == [(2, "B")]
    assert rows(H.delete(old, new, ["k"])) == [(1, "a")]
    at = spark.sql("select timestamp '2024-01-01 00:00:00' t union all select timestamp '2024-01-02 00:00:00'")
    assert len(rows(H.purge(at, "t", "2024-01-02"))) == 1  # what expires at the cutoff stays


def test_exactly_a_window_old_still_counts():
    assert H.admissions([0, 1, 2], 2, 60) == [0, 1, 60]
    assert H.admissions([0, 60], 1, 60) == [0, 60] and H.admissions([0, 30, 100], 1, 60) == [0, 60, 120]
    assert H.admissions([], 3) == []


def test_latest_limits_groups_before_the_shuffle(spark, tiny):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    plan = H.latest(events, ["user_id"], [F.desc("ts"), F.desc("event_id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_streams_equal_batches(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in/events.parquet")
    first = S.collected(S.first_of_key(stream, ["user_id", "event_type"], "ts", "400 days"), "first", f"{tmp_path}/c1", f"{tmp_path}/o1")
    assert first.count() == events.select("user_id", "event_type").distinct().count()
    limited = S.collected(S.limited(stream, "user_id", "ts", 2, 86400.0), "limited", f"{tmp_path}/c2", f"{tmp_path}/o2")
    want = {}
    for user, t in sorted((r[0], r[1]) for r in events.select("user_id", F.unix_micros("ts") / 1e6).collect()):
        want.setdefault(user, []).append(t)
    got = {}
    for r in limited.orderBy("requested").collect():
        got.setdefault(r["user_id"], []).append(r["admitted"])
    assert got == {u: H.admissions(t, 2, 86400.0) for u, t in want.items()}
    windows = S.collected(S.window_counts(stream, "user_id", "ts", "1 day", "0 seconds", 2), "windows", f"{tmp_path}/c3", f"{tmp_path}/o3")
    batch = {(r[0], str(r[1])): (r[2], r[3]) for r in H.over_limit(events, "user_id", "ts", 2, "1 day").collect()}
    streamed = {(r[0], str(r[1])): (r[2], r[3]) for r in windows.collect()}
    assert streamed and all(batch[k] == v for k, v in streamed.items())
