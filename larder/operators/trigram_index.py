"""P-08, O-03, A-01: product search through an index of trigrams.

The index is a table of postings, (bucket, trigram, barcode, h, n): a row for each distinct trigram of a product's text, with the
hash of the row it came from and how many distinct trigrams its text has. Files are partitioned by a hash bucket of the trigram and sorted by it, so
that a query reads the buckets of its own trigrams only.

A text can be similar only if enough of its n trigrams are the query's: a similarity is at most (shared trigrams) / n. So
candidates are the texts with ceil(threshold * n) shared ones or more, by a count over the postings, and only they are
scored. Lists of trigrams that are in a large share of all texts (``COMMON``) aren't read for longer texts: with d such lists left out, a text
still has ceil(threshold * n) - d shared trigrams in the others, which is at least one if n is over d / threshold; postings of shorter texts are read from all lists.

Scoring joins the candidates with the products as they are now, by barcode and row hash: postings of rows that were changed or
deleted since find nothing, and rows that were added are found once ``add`` has been called with them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import trigrams, unaccent_search, word_similarity

BUCKETS = 64
#: A list is common if so large a share of the texts is in it; so many common lists at most are left out.
COMMON, MOST_LEFT_OUT = 0.25, 3


def search_text(name: str = "name", brand: str = "brand") -> Column:
    """Name and brand with a space between, nulls as empty (concat_ws would drop the space)."""
    return F.concat(F.coalesce(F.col(name), F.lit("")), F.lit(" "), F.coalesce(F.col(brand), F.lit("")))


def folded(text: Column) -> Column:
    return F.lower(unaccent_search(text))


def bucket(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BUCKETS)).cast("int")


def postings(products: DataFrame) -> DataFrame:
    """A row for each distinct trigram of each product (barcode, name, brand)."""
    rows = products.select("barcode", F.xxhash64("barcode", "name", "brand").alias("h"), F.array_distinct(trigrams(folded(search_text()))).alias("t"))
    each = rows.select(F.explode("t").alias("trigram"), "barcode", "h", F.size("t").alias("n"))
    return each.select(bucket(F.col("trigram")).alias("bucket"), "*")


@dataclass(frozen=True)
class Asked:
    """A query's trigrams, those of common lists that are left out, and the number of trigrams up to which a text needs them."""

    query: str
    trigrams: tuple[str, ...]
    left_out: tuple[str, ...]
    short: int


class TrigramIndex:
    """An index in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, products: DataFrame, folder: str) -> TrigramIndex:
        index = cls(products.sparkSession, folder)
        index._write(products, "overwrite")
        count = index.postings.groupBy("bucket", "trigram").agg(F.count(F.lit(1)).alias("texts"))
        count.withColumn("of", F.lit(products.count())).write.mode("overwrite").parquet(f"{folder}/frequencies")
        return index

    def add(self, products: DataFrame) -> None:
        """Postings of new or changed rows. How common lists are is left as it was: that decides what is read, not what is found."""
        self._write(products, "append")

    def _write(self, products: DataFrame, mode: str) -> None:
        rows = postings(products).repartitionByRange("bucket", "trigram", "h").sortWithinPartitions("bucket", "trigram")
        rows.write.mode(mode).partitionBy("bucket").parquet(f"{self.folder}/postings")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema("trigram string, barcode string, h long, n int, bucket int").parquet(f"{self.folder}/postings")

    def _lists(self, rows: DataFrame, wanted: list[str]) -> DataFrame:
        """Rows of some trigrams, read from their buckets only."""
        buckets = self.spark.range(1).select(F.array(*[bucket(F.lit(t)) for t in wanted])).first()[0] if wanted else []
        return rows.where(F.col("bucket").isin(*sorted(set(buckets))) & F.col("trigram").isin(*wanted)) if wanted else rows.where("false")

    def asked(self, query: str, threshold: float) -> Asked:
        wanted = sorted(self.spark.range(1).select(F.array_distinct(trigrams(folded(F.lit(query))))).first()[0])
        counts = self._lists(self.spark.read.schema("bucket int, trigram string, texts long, of long").parquet(f"{self.folder}/frequencies"), wanted)
        # as many rows as the query has trigrams at most
        common = sorted((-r["texts"], r["trigram"]) for r in counts.collect() if r["texts"] >= COMMON * r["of"])
        left_out = [t for _, t in common[: min(MOST_LEFT_OUT, len(wanted) - 1)]]
        return Asked(query, tuple(wanted), tuple(left_out), math.floor(len(left_out) / threshold + 1e-9))

    def candidates(self, query: str, threshold: float) -> DataFrame:
        """(barcode, h, shared) of the texts that may be similar enough."""
        a = self.asked(query, threshold)
        lists = self._lists(self.postings, list(a.trigrams))
        if a.left_out:
            lists = lists.where((F.col("n") <= a.short) | ~F.col("trigram").isin(*a.left_out))
        counted = lists.groupBy("barcode", "h").agg(F.count(F.lit(1)).alias("shared"), F.max("n").alias("n"))
        least = F.ceil(F.col("n") * threshold - 1e-9) - F.when(F.col("n") > a.short, len(a.left_out)).otherwise(0)
        return counted.where(F.col("shared") >= F.greatest(least, F.lit(1))).select("barcode", "h", "shared")

    def matches(self, products: DataFrame, query: str, threshold: float) -> DataFrame:
        """Products (barcode, name, brand) that are similar enough, with the similarity that they are ordered by."""
        found = self.candidates(query, threshold).select(F.col("barcode").alias("_barcode"), F.col("h").alias("_h"), "shared")
        rows = products.withColumn("_row", F.xxhash64("barcode", "name", "brand"))
        joined = rows.join(found, (F.col("_row") == F.col("_h")) & F.col("barcode").eqNullSafe(F.col("_barcode")))
        text, asked = folded(search_text()), folded(F.lit(query))
        # of candidates only: the condition needs both sides of the join, so it can't be moved in front of it
        near = joined.where(F.when(F.col("shared") > 0, word_similarity(text, asked)) >= threshold)
        return near.select(*[F.col(c) for c in products.columns], word_similarity(asked, text).alias("similarity"))
