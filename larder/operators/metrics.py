"""Word and character error rates (A-14, A-15)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import fold_metric


def rate(errors: Column, length: Column) -> Column:
    """A-15: errors over the reference's length, may exceed 1; without a reference 0 if there are no errors, else 1."""
    return F.when(length > 0, errors / length).otherwise(F.when(errors > 0, 1.0).otherwise(0.0))


def edits(reference: list, found: list) -> tuple[int, int, int]:
    """A-14: substitutions, deletions and insertions of a cheapest edit; of equal ones substitution, then deletion."""
    row = [(j, 0, 0, j) for j in range(len(found) + 1)]  # total, substitutions, deletions, insertions
    for i, r in enumerate(reference, 1):
        new = [(i, 0, i, 0)]
        for j, f in enumerate(found, 1):
            if r == f:
                new.append(row[j - 1])
                continue
            (a, s, d, n), (b, s1, d1, n1), (c, s2, d2, n2) = row[j - 1], row[j], new[j - 1]
            least = min(a, b, c)
            new.append((a + 1, s + 1, d, n) if a == least else (b + 1, s1, d1 + 1, n1) if b == least else (c + 1, s2, d2, n2 + 1))
        row = new
    return row[-1][1:]


def word_edits(reference: Column, found: Column) -> Column:
    """A-14 for arrays of words: struct (s, d, i) of the same cheapest edit; nulls for a null array, and a null word is unlike any other. A fold
    in SQL would copy the row so far with each of its cells, so its time would go with the square of the found words."""

    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = lambda words: [object() if w is None else w for w in words]
        for a, b in pairs:
            out = [(None,) * 3 if x is None or y is None else edits(own(x), own(y)) for x, y in ((v.as_py(), w.as_py()) for v, w in zip(a, b))]
            yield pa.array([{"s": s, "d": d, "i": i} for s, d, i in out], pa.struct([("s", pa.int32()), ("d", pa.int32()), ("i", pa.int32())]))

    return F.arrow_udf(run, "s int, d int, i int")(reference, found)


def _counted(words: bool):
    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in pairs:
            cut = (lambda t: (t or "").split()) if words else (lambda t: list(t or ""))
            out = [edits(cut(x), cut(y)) for x, y in zip(a.to_pylist(), b.to_pylist())]
            yield pa.array([{"s": s, "d": d, "i": i} for s, d, i in out], pa.struct([("s", pa.int32()), ("d", pa.int32()), ("i", pa.int32())]))

    return F.arrow_udf(run, "s int, d int, i int")


def error_rates(pairs: DataFrame, reference: str, found: str) -> DataFrame:
    """Pairs with counts of word edits, word errors, and wer, cer over folded texts."""
    a, b = fold_metric(F.col(reference)), fold_metric(F.col(found))
    out = pairs.withColumn("_a", a).withColumn("_b", b).withColumn("edits", _counted(True)("_a", "_b"))
    words = F.size(F.filter(F.split("_a", " ", -1), lambda w: w != ""))
    errors = F.col("edits.s") + F.col("edits.d") + F.col("edits.i")
    chars = F.levenshtein("_a", "_b")
    return out.withColumn("errors", errors).withColumn("wer", rate(F.col("errors"), words)).withColumn("cer", rate(chars, F.length("_a"))).drop("_a", "_b")


def character_rate(reference: Column, found: Column) -> Column:
    """A-15 for characters, without Python."""
    a, b = fold_metric(reference), fold_metric(found)
    return rate(F.levenshtein(a, b), F.length(a))


def corpus_rate(rated: DataFrame, errors: str, length: str) -> DataFrame:
    """A-16, an addition: errors over lengths of all pairs."""
    return rated.agg(rate(F.sum(errors), F.sum(length)).alias("rate"))
