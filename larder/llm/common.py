"""What several operators share: reading a table, writing an intermediate result, deleting it."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary folder only where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="larder-"))
    return context.getCheckpointDir().rstrip("/")


def release() -> None:
    """Give memory that a finished task has freed back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def releasing(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run`` over a task's batches; what it held is given back when they end."""

    @functools.wraps(run)
    def task(batches: Iterable) -> Iterator:
        yield from run(batches)
        release()

    return task


_scopes: list[list[Written]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """What is written inside is deleted when the block ends, but for what is taken out with ``keep``."""
    _scopes.append([])
    try:
        yield
    finally:
        for x in _scopes.pop():
            x.drop()


class Written:
    """A result written as Parquet in the shared folder: it cuts the lineage and outlives executors.

    ``frame`` reads it back, ``rows`` and ``mark`` (a sum of row hashes) are gathered while writing.
    """

    def __init__(self, df: DataFrame, tag: str) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        seen = Observation(f"{tag}-{uuid.uuid4().hex}")
        mark = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("mark")
        df.observe(seen, F.count(F.lit(1)).alias("rows"), mark).write.parquet(self.path)
        self.rows, self.mark = seen.get["rows"], seen.get["mark"]
        self.frame = self.spark.read.schema(df.schema).parquet(self.path)
        folder, path = self._folder()
        folder.deleteOnExit(path)  # a lazy result may read it as long as the application runs
        if _scopes:
            _scopes[-1].append(self)

    def keep(self) -> Written:
        """Take it out of the innermost scratch block."""
        _scopes[-1].remove(self)
        return self

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def drop(self) -> None:
        """Delete it now, when nothing will read it any more."""
        folder, path = self._folder()
        folder.delete(path, True)
