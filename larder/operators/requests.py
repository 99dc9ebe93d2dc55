"""F-44: what is logged of a request, and how requests went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How finely quantiles are told apart: exact for groups of up to so many requests, and off by one in so many beyond.
ACCURACY = 100_000


def duration_ms(began: Column, ended: Column) -> Column:
    """Milliseconds to a tenth; none less than zero."""
    return F.round(F.greatest(F.lit(0.0), (F.unix_micros(ended) - F.unix_micros(began)) / 1000), 1)


def logged(requests: DataFrame) -> DataFrame:
    """Requests (request_id, method, path, status, began, ended) with how long each took and its line in the log. One without an id gets a new one."""
    told = requests.withColumn("request_id", F.coalesce("request_id", F.replace(F.uuid(), F.lit("-")))).withColumn("duration_ms", duration_ms(F.col("began"), F.col("ended")))
    return told.withColumn("line", F.format_string("method=%s path=%s status=%d duration_ms=%.1f request_id=%s", "method", "path", "status", "duration_ms", "request_id"))


def summary(log: DataFrame, slow: float) -> DataFrame:
    """(method, class, requests, slowest, median, p95, slow) by method and class of status, in one pass with partial sums."""
    quantile = lambda q: F.percentile_approx("duration_ms", q, ACCURACY)
    return log.groupBy("method", F.expr("status div 100").cast("long").alias("class")).agg(F.count(F.lit(1)).alias("requests"), F.max("duration_ms").alias("slowest"), quantile(0.5).alias("median"), quantile(0.95).alias("p95"), F.count(F.when(F.col("duration_ms") >= slow, 1)).alias("slow"))
