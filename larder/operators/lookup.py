"""Lookups, predicates and projections over entity tables (P-01 to P-18, J-01 to J-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of barcodes, and the upload types that are accepted.
BARCODE_LENGTHS = (8, 12, 13)
IMAGE_TYPES = ("image/jpeg", "image/jpg", "image/png", "image/webp", "image/heic", "image/heif")
MOST_UPLOAD = 10 * 1024 * 1024


def by_key(df: DataFrame, **keys: object) -> DataFrame:
    """P-01, P-03: rows equal on all keys; with an owner key too, another owner's row looks absent."""
    for column, value in keys.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def by_lowered(df: DataFrame, column: str, value: str) -> DataFrame:
    """P-02: a key that is stored and asked for in lower case."""
    return df.where(F.lower(column) == F.lower(F.lit(value)))


def by_nullable(df: DataFrame, **keys: object) -> DataFrame:
    """P-04: rows equal on all keys, where null equals null."""
    for column, value in keys.items():
        df = df.where(F.col(column).eqNullSafe(F.lit(value)))
    return df


def cache_state(summary_at: Column, product_at: Column, version: Column, wanted: int, has_key: bool) -> Column:
    """P-05: fresh if the cached row is as new as its product and of the wanted version; else stale, served only
    where no new one can be made."""
    fresh = summary_at.isNotNull() & (summary_at >= product_at) & (version == wanted)
    stale = "regenerate" if has_key else "stale"
    return F.when(fresh, "fresh").when(summary_at.isNull(), "missing").otherwise(stale)


def upload_verdict(size: Column, content_type: Column, most: int = MOST_UPLOAD) -> Column:
    """S-03: checks in order: too large, empty, a type that isn't allowed (no type is)."""
    return F.when(size > most, 413).when(size == 0, 400).when(content_type.isNotNull() & ~content_type.isin(*IMAGE_TYPES), 400).otherwise(200)


def valid_tokens(tokens: DataFrame, revoked: DataFrame, kind: str) -> DataFrame:
    """P-12, J-06: of the right kind, with a subject, not revoked."""
    return tokens.where((F.col("kind") == kind) & F.col("subject").isNotNull()).join(revoked.select("jti"), "jti", "left_anti")


def category(override: Column, forced: Column, density: Column, threshold: float = 0.015) -> Column:
    """P-17: an override, else what is forced, else a table if grid lines are dense enough, else text."""
    return F.coalesce(override, forced, F.when(density >= threshold, "table").otherwise("text"))


def personal_or_default(people: DataFrame, summaries: DataFrame) -> DataFrame:
    """J-04, J-05: each person's own summary, or the one of the empty profile; null keys equal null."""
    own, default = summaries.alias("o"), summaries.where("kind is null and level is null").alias("d")
    joined = people.alias("p").join(own, (F.col("p.barcode") == F.col("o.barcode")) & F.col("p.kind").eqNullSafe(F.col("o.kind")) & F.col("p.level").eqNullSafe(F.col("o.level")), "left")
    joined = joined.join(default, F.col("p.barcode") == F.col("d.barcode"), "left")
    own_found = F.col("o.summary").isNotNull()
    return joined.select("p.person", "p.barcode", F.coalesce("o.summary", "d.summary").alias("summary"), F.when(own_found, F.col("p.kind")).alias("kind"), F.when(own_found, F.col("p.level")).alias("level"))


def with_children(parent: DataFrame, child: DataFrame, key: str, *columns: str) -> DataFrame:
    """J-01, J-02: a parent with its at most one child."""
    return parent.join(child.select(key, *columns), key, "left")


def nested(parent: DataFrame, child: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """J-03: a parent with its children as a sorted list; the list is as long as one parent's children."""
    listed = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("children"))
    return parent.join(listed, key, "left").withColumn("children", F.coalesce("children", F.array().cast(listed.schema["children"].dataType)))


def as_json(*columns: str | Column) -> Column:
    """P-11, S-16: an object of these columns as text, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str) -> None:
    """S-16: files of one object a line, nulls kept."""
    df.select(as_json(*df.columns).alias("value")).write.text(path)
