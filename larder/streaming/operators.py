"""Streaming forms of T-01 to T-04: dedup, expiry by timers, fixed windows, and an exact sliding-window limiter.

The limiter and the purge keep state of their own in RocksDB, with event-time timers: what can't matter any more goes once the watermark has passed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from larder.operators.history import admissions


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream, with the schema that the files have now."""
    path = f"{folder}/{name}.parquet"
    # as a pattern, since a plain path would have to be a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share; a temporary one only where it is unset and all is local. It goes
    when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/larder-{uuid.uuid4().hex}")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    store.deleteOnExit(folder)
    return folder.toString()


def first_of_key(events: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """T-04: the first event of a key; its state is kept while the watermark hasn't passed it."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def window_counts(events: DataFrame, key: str, at: str, width: str, delay: str, most: int) -> DataFrame:
    """T-03: requests of a key in fixed windows; a window is given once the watermark has passed its end."""
    counted = events.withWatermark(at, delay).groupBy(key, F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(key, F.col("w.start").alias("window_start"), "requests", (F.col("requests") > most).alias("limited"))


class Limiter(StatefulProcessor):
    """A key's state is the admissions that may still count, ``most`` of them at most; a timer drops it when the last has left the window."""

    def __init__(self, key: str, most: int, window: float) -> None:
        self.key, self.most, self.window = key, most, window

    def init(self, handle) -> None:
        self.handle, self.held = handle, handle.getListState("held", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [x for (x,) in self.held.get()] if self.held.exists() else []
        times = sorted(t for batch in rows for t in batch["requested"])
        out = admissions([*held, *times], self.most, self.window)[len(held) :]
        self.held.put([(x,) for x in [*held, *out][-self.most :]])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((out[-1] + self.window) * 1000) + 1)
        yield pd.DataFrame({self.key: [key[0]] * len(times), "requested": times, "admitted": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class Purge(StatefulProcessor):
    """A key's tokens wait for their time; each is given when the watermark has reached it, and forgotten."""

    def init(self, handle) -> None:
        self.handle, self.tokens = handle, handle.getListState("tokens", "token long, expires long")

    def _wait(self, expires: list[int]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if expires:
            self.handle.registerTimer(min(expires))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(e)) for batch in rows for t, e in zip(batch["token"], batch["expires"])]
        held = [(x[0], x[1]) for x in self.tokens.get()] if self.tokens.exists() else []
        self.tokens.appendList(new)
        self._wait([e for _, e in [*held, *new]])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [(x[0], x[1]) for x in self.tokens.get()] if self.tokens.exists() else []
        left = [x for x in held if x[1] > now]
        if left:
            self.tokens.put(left)
        else:
            self.tokens.clear()
        self._wait([e for _, e in left])
        yield pd.DataFrame({"token": [t for t, e in held if e <= now], "expires": [e for _, e in held if e <= now]})

    def close(self) -> None:
        pass


def limited(events: DataFrame, key: str, at: str, most: int, window: float = 60.0, delay: str = "0 seconds") -> DataFrame:
    """T-02: when each request of a key is let through. Requests of one batch are taken in order of time; later ones that are older than the
    watermark are dropped. A key's requests are taken one after another, in one task, as each admission depends on those before."""
    kind = events.schema[key].dataType.simpleString()
    stamp = F.col(at).cast("timestamp")
    timed = events.select(key, stamp.alias("_at"), (F.unix_micros(stamp) / 1e6).alias("requested")).withWatermark("_at", delay)
    return timed.groupBy(key).transformWithStateInPandas(Limiter(key, most, window), f"{key} {kind}, requested double, admitted double", "append", "eventTime")


def purged(tokens: DataFrame, owner: str, token: str, at: str, lifetime: float, delay: str = "0 seconds") -> DataFrame:
    """T-01: (token, expires in milliseconds) of tokens whose time is up: ``lifetime`` seconds after ``at``, by the watermark."""
    stamp = F.col(at).cast("timestamp")
    expires = F.unix_millis(stamp) + int(lifetime * 1000)
    rows = tokens.select(owner, stamp.alias("_at"), F.col(token).cast("long").alias("token"), expires.alias("expires")).withWatermark("_at", delay)
    return rows.groupBy(owner).transformWithStateInPandas(Purge(), "token long, expires long", "append", "eventTime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that begin inside keep their state in RocksDB, which states of own processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def collected(stream: DataFrame, name: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Run a stream over what is there now, into files, and read them: to compare it with its batch form."""
    folder = shared_folder(stream.sparkSession)
    checkpoint, path, name = checkpoint or f"{folder}/state", path or f"{folder}/rows", f"{name}-{folder[-8:]}"
    with rocksdb(stream.sparkSession):
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).queryName(name).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
