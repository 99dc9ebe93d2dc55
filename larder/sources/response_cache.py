"""S-11: responses of an outside engine, kept by the hash of the picture that was sent.

A table of Parquet files, partitioned by the first digits of the hash. ``put`` appends; of a hash's entries the one put last counts,
whatever it was asked for, so that putting again overwrites. ``compact`` writes each partition anew with one entry a hash, by
dynamic overwrite. ``get`` finds an entry for a request if what it was asked for, the feature and the list of hints in its order,
is just the same; it reads only the partitions that requests fall in. Nothing expires by itself.

What can't be read is a miss: files that are cut short or damaged are passed over, and so are responses that aren't JSON; a later
put of the same hash takes their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 2
SCHEMA = "sha256 string, feature string, hints array<string>, response string, size long, put_at long, prefix string"
KEY = ["sha256", "feature", "hints"]


def prefix(sha256: Column) -> Column:
    return F.lower(F.substring(sha256, 1, DIGITS))


class ResponseCache:
    """A cache in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    @property
    def entries(self) -> DataFrame:
        """All that was put and can be read."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(self.folder)

    def latest(self, entries: DataFrame) -> DataFrame:
        """One entry a hash: the one put last; of those put at the same time, the greatest."""
        whole = F.struct("put_at", "feature", "hints", "response", "size")
        last = entries.groupBy("prefix", "sha256").agg(F.max(whole).alias("e"))
        return last.select("sha256", "e.feature", "e.hints", "e.response", "e.size", "e.put_at", "prefix")

    def put(self, rows: DataFrame) -> None:
        """Entries (sha256, feature, hints, response, size, put_at); put_at is a number that grows from put to put. Rows without a hash or a
        response are left out."""
        good = rows.where("sha256 is not null and response is not null").withColumn("prefix", prefix(F.col("sha256")))
        shown = [F.col(f.split()[0]).cast(f.split()[1]) for f in SCHEMA.split(", ")]
        self.latest(good.select(*shown)).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(self.folder)

    def compact(self, *prefixes: str) -> None:
        """Partitions (all, if none are named) with one entry a hash. They are written aside first, since what is read can't be overwritten."""
        kept = self.entries if not prefixes else self.entries.where(F.col("prefix").isin(*prefixes))
        aside = f"{self.folder}-aside"
        self.latest(kept).repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(aside)
        rows = self.spark.read.schema(SCHEMA).parquet(aside)
        rows.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(self.folder)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(aside)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def lookup(self, requests: DataFrame) -> DataFrame:
        """Entries of the partitions that requests fall in: there are as many as there are prefixes, at most."""
        wanted = [r[0] for r in requests.where("sha256 is not null").select(prefix(F.col("sha256"))).distinct().collect()]
        return self.entries.where(F.col("prefix").isin(*sorted(wanted))) if wanted else self.entries.where("false")

    def get(self, requests: DataFrame) -> DataFrame:
        """``requests`` (sha256, feature, hints, ...) with the response that is kept for each; null for a miss."""
        readable = F.try_parse_json("response").isNotNull()
        found = self.latest(self.lookup(requests).where(readable)).select("prefix", *[F.col(c).alias(f"_{c}") for c in KEY], F.col("response"))
        asked = requests.withColumn("_at", prefix(F.col("sha256")))
        same = (F.col("_at") == F.col("prefix")) & (F.col("sha256") == F.col("_sha256")) & (F.col("feature") == F.col("_feature")) & (F.col("hints") == F.col("_hints"))
        return asked.join(found, same, "left").select(*[F.col(c) for c in requests.columns], "response")
