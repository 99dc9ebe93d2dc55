"""Nested annotation responses to flat statistics (A-06 to A-10, F-32 to F-34, S-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A response's shape; either spelling of a key is accepted.
VERTICES = "array<struct<x:double,y:double>>"
WORD = f"struct<confidence:string,boundingBox:struct<vertices:{VERTICES}>,bounding_box:struct<vertices:{VERTICES}>>"
FULL = f"struct<text:string,pages:array<struct<blocks:array<struct<paragraphs:array<struct<words:array<{WORD}>>>>>>>>"
FLAT = f"array<struct<description:string,boundingPoly:struct<vertices:{VERTICES}>,bounding_poly:struct<vertices:{VERTICES}>>>"
SCHEMA = f"fullTextAnnotation {FULL}, full_text_annotation {FULL}, textAnnotations {FLAT}, text_annotations {FLAT}"
NO_CONFIDENCE = "no_numeric_confidences"


def first_present(payload: Column, *keys: str) -> Column:
    """F-33: the value, as JSON text, of the first key that is there; a present null wins over a later key."""
    entries = F.from_json(payload, "map<string,string>")
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.map_contains_key(entries, k), entries[k]).otherwise(out)
    return out


def parsed(payload: Column) -> Column:
    """S-14: a response's JSON text as a struct with one spelling: (full, flat)."""
    raw = F.from_json(payload, SCHEMA)
    return F.struct(F.coalesce(raw["fullTextAnnotation"], raw["full_text_annotation"]).alias("full"), F.coalesce(raw["textAnnotations"], raw["text_annotations"]).alias("flat"))


def text_of(response: Column, feature: Column) -> Column:
    """F-32: the first annotation's text for plain detection, the full text for all else; empty if absent."""
    first = F.get(response["flat"], F.lit(0))["description"]
    return F.coalesce(F.when(feature == "TEXT_DETECTION", first).otherwise(response["full"]["text"]), F.lit(""))


def box(vertices: Column) -> Column:
    """A-09: least and greatest coordinates, a missing one as 0; null without vertices."""
    xs = F.transform(vertices, lambda v: F.coalesce(v["x"], F.lit(0)).cast("int"))
    ys = F.transform(vertices, lambda v: F.coalesce(v["y"], F.lit(0)).cast("int"))
    made = F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
    return F.when(F.size(vertices) > 0, made)


def _all(pages: Column) -> tuple[Column, Column, Column]:
    blocks = F.flatten(F.transform(F.filter(pages, lambda p: p["blocks"].isNotNull()), lambda p: p["blocks"]))
    paragraphs = F.flatten(F.transform(F.filter(blocks, lambda b: b["paragraphs"].isNotNull()), lambda b: b["paragraphs"]))
    words = F.flatten(F.transform(F.filter(paragraphs, lambda p: p["words"].isNotNull()), lambda p: p["words"]))
    return blocks, paragraphs, words


def statistics(responses: DataFrame, id_col: str, payload: str) -> DataFrame:
    """A-07, A-08: (id, blocks, paragraphs, words, mean_confidence, warning). Only numbers count as confidence; the mean
    times 100, at most 100."""
    blocks, paragraphs, words = _all(F.col("r.full.pages"))
    count = lambda a: F.greatest(F.coalesce(F.size(a), F.lit(0)), F.lit(0))
    numbers = F.filter(F.transform(words, lambda w: F.when(w["confidence"].rlike(r"^-?[0-9.]+([eE][-+]?[0-9]+)?$"), w["confidence"].try_cast("double"))), lambda c: c.isNotNull())
    total = F.aggregate(numbers, F.lit(0.0), lambda a, c: a + c)
    mean = F.when(F.size(numbers) > 0, F.least(total / F.size(numbers) * 100.0, F.lit(100.0))).otherwise(0.0)
    warning = F.when((count(words) > 0) & (F.size(numbers) == 0), NO_CONFIDENCE)
    return responses.select(F.col(id_col), parsed(F.col(payload)).alias("r")).select(id_col, count(blocks).alias("blocks"), count(paragraphs).alias("paragraphs"), count(words).alias("words"), F.coalesce(mean, F.lit(0.0)).alias("mean_confidence"), warning.alias("warning"))


def word_tokens(responses: DataFrame, id_col: str, payload: str) -> DataFrame:
    """F-34: (id, pos, text, x1, y1, x2, y2) of the annotations after the first that have a text and a box."""
    flat = responses.select(F.col(id_col), parsed(F.col(payload)).alias("r")).select(id_col, F.posexplode("r.flat").alias("pos", "a")).where("pos > 0")
    boxed = flat.select(id_col, "pos", F.col("a.description").alias("text"), box(F.coalesce("a.boundingPoly.vertices", "a.bounding_poly.vertices")).alias("b"))
    return boxed.where("text <> '' and b is not null").select(id_col, "pos", "text", "b.*")


def mean_confidence(value: Column) -> Column:
    """A-06, A-10: an aggregate: the mean of the numbers that aren't negative; 0 if there are none."""
    number = value.try_cast("double")
    return F.coalesce(F.avg(F.when(number >= 0, number)), F.lit(0.0))
