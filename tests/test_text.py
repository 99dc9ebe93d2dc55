"""Text functions against Python's own Unicode data and hand-derived values."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from larder.functions import text as T


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("t"))).collect()]


def bare(t):
    return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower()


VALUES = ["Ação de Pão", "Crème-Brûlée 10%", "éclair", "ß ø æ", "  a   b ", "", "ŽLUŤOUČKÝ kůň", "Ⅷ x²"]


def test_folds_equal_python(spark):
    squeeze = lambda t, to: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", to, bare(t))).strip()
    assert apply(spark, T.fold, VALUES) == [squeeze(v, " ") for v in VALUES]
    assert apply(spark, T.fold_deleting, VALUES) == [squeeze(v, "") for v in VALUES]
    assert apply(spark, T.fold_letters, VALUES) == [re.sub("[^a-z]", "", bare(v)) for v in VALUES]
    assert apply(spark, T.fold, [None]) == [None]
    assert apply(spark, T.fold_metric, ["10  Mg, 5 kcal/7 UI", "3 grams"]) == ["10mg 5kcal 7ui", "3 grams"]
    assert apply(spark, T.fold_label, ["Á-b C1"]) == ["bc1"]
    assert apply(spark, T.unaccent, ["Ça ß"]) == ["Ca ß"]


def test_word_similarity_of_documented_pairs(spark):
    pairs = [("word", "two words", 0.8), ("coca", "refrigerante coca-cola", 1.0), ("abc", "", 0.0), ("", "abc", 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, w double")
    assert all(abs(r[0] - r[1]) < 1e-9 for r in df.select(T.word_similarity(F.col("a"), F.col("b")), "w").collect())
    back = df.limit(2).select(T.word_similarity(F.col("b"), F.col("a"))).collect()
    assert round(back[1][0], 4) == 0.2381


@pytest.mark.parametrize("text, key, want", [("old ring", "ring", True), ("older ring old", "old", False), ("ring", "ring", True), ("springs", "ring", False), ("a", "b", False)])
def test_only_the_first_occurrence_counts(spark, text, key, want):
    df = spark.createDataFrame([(text, key)], "t string, k string")
    assert df.select(T.bounded_first(F.col("t"), F.col("k"))).first()[0] is want


def test_items(spark):
    values = ["sal, açúcar; -água.-, 12, x", "a b\nc d\r\n7", None, "", "só"]
    assert apply(spark, T.split_items, values) == [["sal", "açúcar", "água"], ["a b", "c d"], [], [], ["só"]]
    assert apply(spark, T.canonical_list, [" a , ,b"]) == [["a", "b"]]


def test_functions_of_sql_equal_those_of_columns(spark):
    from pyspark.sql import functions as F

    from larder.functions import sql
    from larder.functions import text as T

    sql.register(spark)
    texts = ["Açúcar (30 MG) d'été", "Straße øre Ærø Łódź", "  A\u0301 \tb\\n ", "", None, "über-cool 5 kcal", "İstanbul ĳ ŉ"]
    df = spark.createDataFrame([(t, u) for t in texts for u in ("acucar ete", "strasse", "", None)], "t string, u string")
    pairs = {"unaccent": T.unaccent, "unaccent_search": T.unaccent_search, "fold": T.fold, "fold_deleting": T.fold_deleting, "fold_letters": T.fold_letters, "fold_metric": T.fold_metric, "trigrams": T.trigrams}
    for name, column in pairs.items():
        got = df.select(F.expr(f"larder_{name}(t)").alias("a"), column(F.col("t")).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got], name
    got = df.select(F.expr("larder_word_similarity(t, u)").alias("a"), T.word_similarity(F.col("t"), F.col("u")).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]
    assert [r[0] for r in df.select(F.lower(T.unaccent_search(F.col("t")))).distinct().collect() if r[0] and "stras" in r[0]] == ["strasse ore aero lodz"]


def test_word_edits_of_long_texts_and_nulls(spark):
    import time

    from pyspark.sql import functions as F

    from larder.operators import metrics

    rows = [(["a", "b", None], ["a", None, "c"]), (None, ["a"]), (["a"], None), ([], ["a", "b"]), ([f"w{i}" for i in range(800)], [f"w{i}" for i in range(1, 801)])]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, a array<string>, b array<string>")
    began = time.monotonic()
    got = {r["n"]: tuple(r["e"]) for r in df.select("n", metrics.word_edits(F.col("a"), F.col("b")).alias("e")).collect()}
    assert got == {0: (2, 0, 0), 1: (None,) * 3, 2: (None,) * 3, 3: (0, 0, 2), 4: (0, 1, 1)}
    assert time.monotonic() - began < 30


def test_edits_by_kind_are_counted_in_many_tasks(spark, tiny):
    from larder.plans import attempts

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert attempts.a14_kinds(spark, tiny).rdd.getNumPartitions() == n > 1
