"""Snapshots and their changes: latest per key, upserts, patches, deletes, purges (M-01 to M-13, W-01, W-07, T-01 to T-06).

DataFrames are immutable: each change takes a snapshot and a change set and gives the next snapshot.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """W-01: the first row of each key; the planner limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """M-01, M-07: rows whose key isn't there yet are added; the others are ignored."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def conflicts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """J-07: new rows whose key exists."""
    return new.join(old.select(*keys), keys, "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """M-05, M-11: rows of ``new`` take the place of rows with their key, or are added."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def patch(old: DataFrame, changes: DataFrame, key: str, fields: list[str], stamp: str, at: str) -> DataFrame:
    """M-03: a change row has each field and ``set_<field>``: absent fields keep, null clears, values replace.
    The time stamp moves only if something changes."""
    joined = old.alias("o").join(changes.alias("c"), key, "left")
    is_set = lambda f: F.coalesce(F.col(f"c.set_{f}"), F.lit(False))
    changed = F.lit(False)
    for f in fields:
        changed = changed | (is_set(f) & ~F.col(f"o.{f}").eqNullSafe(F.col(f"c.{f}")))
    kept = [F.col(f"o.{c}") for c in old.columns if c not in (key, stamp, *fields)]
    new = [F.when(is_set(f), F.col(f"c.{f}")).otherwise(F.col(f"o.{f}")).alias(f) for f in fields]
    return joined.select(key, *kept, *new, F.when(changed, F.lit(at).cast("timestamp")).otherwise(F.col(f"o.{stamp}")).alias(stamp))


def patch_keeping_nulls(old: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """M-04: null means keep."""
    joined = old.alias("o").join(changes.alias("c"), key, "left")
    kept = [F.col(f"o.{c}") for c in old.columns if c not in (key, *fields)]
    return joined.select(key, *kept, *[F.coalesce(f"c.{f}", f"o.{f}").alias(f) for f in fields])


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """M-08: all rows but those with a key of ``gone``."""
    return old.join(gone.select(*keys), keys, "left_anti")


def delete_owner(owners: DataFrame, owned: DataFrame, linked: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M-09: an owner and what they own go; what only refers to them stays with a null reference."""
    marked = linked.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    nulled = marked.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone").select(*linked.columns)
    return delete(owners, gone, [key]), delete(owned, gone, [key]), nulled


def purge(df: DataFrame, column: str, cutoff: str) -> DataFrame:
    """M-10, T-01: rows that expire before the cutoff go; one that expires at it stays. The cutoff is a parameter."""
    return df.where(~(F.col(column) < F.lit(cutoff).cast("timestamp")))


def demand(events: DataFrame, key: str, at: str, seconds: int = 60) -> DataFrame:
    """W-07: how many events of a key lie in the last seconds, those exactly as old included."""
    moment = F.unix_micros(F.col(at).cast("timestamp"))
    frame = Window.partitionBy(key).orderBy(moment).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("demand", F.count(F.lit(1)).over(frame))


def over_limit(events: DataFrame, key: str, at: str, most: int = 10, width: str = "1 minute") -> DataFrame:
    """T-03: requests of a key in fixed windows, and whether they exceed the limit."""
    counted = events.groupBy(key, F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(key, F.col("w.start").alias("window_start"), "requests", (F.col("requests") > most).alias("limited"))


class Limiter:
    """T-02: lets a request through if at most ``most`` are within the window; a time exactly the window old still counts, and then
    no wait makes it go, so the request goes once time has moved on. Holds at most ``most`` times."""

    def __init__(self, most: int, window: float) -> None:
        self.most, self.window, self.clock = most, window, float("-inf")
        self.held: deque[float] = deque()

    def admit(self, t: float) -> float:
        self.clock = max(self.clock, t)
        while self.held and self.held[0] < self.clock - self.window:
            self.held.popleft()
        if len(self.held) >= self.most:
            self.clock = max(self.clock, self.held[-self.most] + self.window)
            while self.held and self.held[0] <= self.clock - self.window:
                self.held.popleft()
        self.held.append(self.clock)
        return self.clock


def admissions(times: list[float], most: int, window: float = 60.0) -> list[float]:
    """T-02: when each request of a list in order is let through."""
    limiter = Limiter(most, window)
    return [limiter.admit(t) for t in times]


def admitted(events: DataFrame, key: str, at: str, most: int, window: float = 60.0) -> DataFrame:
    """T-02: (key, requested, admitted): ``admissions`` of each key's times (doubles), which pass in order; a task holds no more than
    what is within one key's window, at most ``most`` requests, however many a key has."""
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, limiter = None, None
        for batch in batches:
            keys, times, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, t in zip(keys, times):
                if limiter is None or k != last:
                    last, limiter = k, Limiter(most, window)
                out.append(limiter.admit(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["key", "requested", "admitted"])

    ordered = events.select(F.col(key).alias("key"), F.col(at).cast("double").alias("requested")).where("requested is not null").repartition("key").sortWithinPartitions("key", "requested")
    return ordered.mapInArrow(run, f"key {kind}, requested double, admitted double").withColumnRenamed("key", key)


def first_seen(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """T-04, T-06: each row, with a flag that an earlier row of its key was there."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("cache_hit", rank > 1)
