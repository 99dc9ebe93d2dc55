"""Scored attempts and their winner (F-26, F-27, J-14, J-16, A-18, O-06, O-07, P-17, P-18, W-05)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import fold

#: Defaults of the quality thresholds.
KEYWORDS = ("valor energetico", "carboidratos", "proteinas", "gorduras totais", "gorduras saturadas", "sodio")
LEAST_CONFIDENCE, LEAST_LENGTH, LEAST_HITS, MOST_DISTANCE = 65.0, 40, 3, 3
WEIGHTS, FULL_LENGTH = (0.5, 0.4, 0.1), 500.0


def keyword_hits(text: Column, keywords: tuple[str, ...] = KEYWORDS, most: int = MOST_DISTANCE) -> Column:
    """J-14, A-18: how many keywords have a window of as many words within the edit distance. A text of fewer words
    than a keyword is one shorter window. Windows of one width are made once, each distinct one compared once."""
    widths: dict[int, list[str]] = {}
    for k in keywords:
        widths.setdefault(len(k.split()), []).append(k)

    def windows(words: Column, n: int) -> Column:
        own = [len(k) for k in widths[n]]
        last = F.greatest(F.lit(1), F.size(words) - n + 1)
        every = words if n == 1 else F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " "))
        # lengths tell most windows apart
        return F.array_distinct(F.filter(every, lambda w: F.length(w).between(min(own) - most, max(own) + most)))

    def hits(n: int, found: Column) -> Column:
        # the bounded distance is -1 beyond its bound
        return sum((F.when(F.exists(found, lambda w: F.levenshtein(w, F.lit(k), most) != -1), 1).otherwise(0) for k in widths[n]), F.lit(0))

    def count(folded: Column) -> Column:
        words = F.split(folded, " ", -1)
        return F.when(folded == "", 0).otherwise(sum((F.transform(F.array(windows(words, n)), functools.partial(hits, n))[0] for n in widths), F.lit(0)))

    return F.transform(F.array(fold(text)), count)[0]


def scored(attempts: DataFrame, text: str, confidence: str, keywords: tuple[str, ...] = KEYWORDS, least: tuple[float, int, int] = (LEAST_CONFIDENCE, LEAST_LENGTH, LEAST_HITS)) -> DataFrame:
    """F-26, P-18: attempts with text_length, keyword_hits, passed and score."""
    length = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)^\s+|\s+$", ""))
    out = attempts.withColumn("text_length", length).withColumn("keyword_hits", keyword_hits(F.coalesce(F.col(text), F.lit("")), keywords))
    passed = (F.col(confidence) >= least[0]) & (F.col("text_length") >= least[1]) & (F.col("keyword_hits") >= least[2])
    a, b, c = WEIGHTS
    score = (F.col(confidence) / 100.0) * a + F.least(F.col("keyword_hits") / F.lit(max(1, len(keywords))), F.lit(1.0)) * b + F.least(F.col("text_length") / F.lit(FULL_LENGTH), F.lit(1.0)) * c
    return out.withColumn("passed", passed).withColumn("score", score)


def winners(attempts: DataFrame, key: str, index: str, stop: bool = True) -> DataFrame:
    """O-06, W-05: a row for each key. With ``stop`` the first attempt that passed wins and later ones never ran; without
    it, or if none passed, the highest score wins, the earliest among equals."""
    i, score = F.col(index), F.col("score")
    order = F.struct(F.when(F.col("passed"), 0).otherwise(1).alias("a"), F.when(F.col("passed"), i.cast("double")).otherwise(-score).alias("b"), i.alias("i")) if stop else F.struct(F.lit(0).alias("a"), (-score).alias("b"), i.alias("i"))
    best = attempts.groupBy(key).agg(F.min(F.struct(order.alias("o"), F.col("passed").alias("passed"), score.alias("score"))).alias("w"), F.min(F.when(F.col("passed"), i)).alias("first"), F.count(F.lit(1)).alias("n"))
    ran = F.when(F.col("first").isNotNull(), F.col("first") + 1).otherwise(F.col("n")) if stop else F.col("n")
    return best.select(key, F.col("w.o.i").alias("winner"), F.col("w.passed").alias("passed"), F.col("w.score").alias("score"), ran.cast("long").alias("ran"))


def polarity(normal: Column, inverted: Column) -> Column:
    """O-07: the inverted reading only if its confidence is strictly greater."""
    return F.when(inverted > normal, "inverted").otherwise("normal")


def with_presets(attempts: DataFrame, presets: DataFrame) -> DataFrame:
    """J-16: attempts with the presets of their category; the ingredient category's presets are called ingredients."""
    category = F.when(F.col("category") == "ingredient", "ingredients").otherwise(F.col("category"))
    return attempts.withColumn("category", category).join(presets, "category")
