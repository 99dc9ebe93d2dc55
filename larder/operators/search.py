"""Product search with paging (P-06 to P-08, A-01, O-01 to O-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import contains_folded, word_similarity
from larder.operators.lookup import BARCODE_LENGTHS
from larder.operators.trigram_index import TrigramIndex, folded, search_text

THRESHOLD = 0.15


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """O-01: one page of an order that must end in a unique column; plans as a top-k."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages begin at 1 and hold 1 to 100 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def kind_of(query: str) -> str:
    """P-06: what a query's shape asks for."""
    q = query.strip()
    if len(q) < 2:
        return "empty"
    if q.isdigit() and len(q) in BARCODE_LENGTHS:
        return "exact"
    return "contains" if len(q) < 3 else "fuzzy"


def kind(query: Column) -> Column:
    """P-06: the same of a column of queries; null is empty."""
    q = F.regexp_replace(F.coalesce(query, F.lit("")), r"(?U)^\s+|\s+$", "")
    exact = q.rlike(r"^(?U:\d)+$") & F.length(q).isin(*BARCODE_LENGTHS)
    return F.when(F.length(q) < 2, "empty").when(exact, "exact").when(F.length(q) < 3, "contains").otherwise("fuzzy")


def matches(products: DataFrame, query: str, index: TrigramIndex | None = None) -> DataFrame:
    """Products (barcode, name, brand) that a query finds, with the similarity they are ordered by (null: by name). Without an
    index, similar ones are found by scoring all."""
    q, kind = query.strip(), kind_of(query)
    none = F.lit(None).cast("double").alias("similarity")
    if kind == "empty":
        return products.limit(0).select("*", none)
    if kind == "exact":
        return products.where(F.col("barcode") == q).select("*", none)
    text = search_text("name", "brand")
    if kind == "contains":
        return products.where(contains_folded(text, q)).select("*", none)
    if index is not None:
        return index.matches(products, q, THRESHOLD)
    # the filter takes the text first, the order the query
    text, asked = folded(text), folded(F.lit(q))
    found = products.where(word_similarity(text, asked) >= THRESHOLD)
    return found.select("*", word_similarity(asked, text).alias("similarity"))


def search(products: DataFrame, query: str, number: int = 1, size: int = 20, index: TrigramIndex | None = None) -> DataFrame:
    """A page of found products: most similar first, or by name; the barcode breaks ties."""
    order = [F.desc("similarity"), F.asc("barcode")] if kind_of(query) == "fuzzy" else [F.asc_nulls_last("name"), F.asc("barcode")]
    return page(matches(products, query, index), order, number, size)


def total(products: DataFrame, query: str, index: TrigramIndex | None = None) -> DataFrame:
    """A-01: how many products a query finds, a second action over the same filter."""
    return matches(products, query, index).agg(F.count(F.lit(1)).alias("total"))
