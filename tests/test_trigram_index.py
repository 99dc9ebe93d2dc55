"""Search through the index against scoring every product."""

import random

import pytest
from larder.operators import search as find
from larder.operators import trigram_index as T
from larder.plans import lookups

QUERIES = ["blue bolt", "brand#11", "ál bólt", "blue bolt brand#1 large green", "zzz", "???", "x" * 200]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("text", QUERIES)
def test_equals_the_scan(spark, tiny, text):
    products = lookups.products(spark, tiny)
    index = lookups.product_index(spark, tiny)
    assert found(find.matches(products, text, index)) == found(find.matches(products, text))


def odd_products(spark):
    r = random.Random(2)
    words = "arroz feijão açúcar leite pão bolo de da com sem integral café x ab zé #1".split()
    rows = [(f"{i:013d}", " ".join(r.choice(words) for _ in range(r.randrange(0, 9))), r.choice(["Zé & Cia", "", None, "marca"])) for i in range(400)]
    rows += [(None, "arroz com leite", "marca"), ("7", None, None), ("8", "arroz integral", None), ("8", "arroz integral", None), ("8", "leite integral", None), ("9", "   ", "-")]
    return spark.createDataFrame(rows, "barcode string, name string, brand string")


@pytest.mark.parametrize("most", [0, 1, 3, 50])
def test_any_number_of_common_lists_may_be_left_out(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(T, "COMMON", 0.02)
    monkeypatch.setattr(T, "MOST_LEFT_OUT", most)
    products = odd_products(spark)
    index = T.TrigramIndex.build(products, str(tmp_path / "i"))
    for text in ("arroz com leite", "acucar", "pao de cafe com leite integral", "marca"):
        for threshold in (0.15, 0.4):
            monkeypatch.setattr(find, "THRESHOLD", threshold)
            assert len(index.asked(text, threshold).left_out) <= most
            assert found(find.matches(products, text, index)) == found(find.matches(products, text))


def test_rows_come_and_go(spark, tmp_path):
    products = odd_products(spark)
    index = T.TrigramIndex.build(products, str(tmp_path / "i"))
    fewer = products.where("barcode > '0000000000100'")
    assert found(find.matches(fewer, "arroz com leite", index)) == found(find.matches(fewer, "arroz com leite"))
    new = spark.createDataFrame([("new", "arroz com leite fresco", None), ("0000000000200", "leite de arroz", "marca")], products.schema)
    now = fewer.where("barcode <> '0000000000200'").unionByName(new)
    assert not {r[0] for r in found(find.matches(now, "arroz com leite", index))} & {"new"}
    index.add(new)
    assert found(find.matches(now, "arroz com leite", index)) == found(find.matches(now, "arroz com leite"))
    none = T.TrigramIndex.build(products.limit(0), str(tmp_path / "none"))
    assert found(find.matches(products.limit(0), "arroz", none)) == []


def test_few_candidates_and_pruned_buckets(spark):
    sf = "/root/testdata/sf0.01"
    products, index = lookups.products(spark, sf), lookups.product_index(spark, sf)
    candidates = index.candidates("blue bolt", find.THRESHOLD)
    assert candidates.count() < 0.4 * products.count()
    scan = next(x for x in candidates._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "PartitionFilters: [bucket" in scan and "PushedFilters: [In(trigram" in scan
    read = candidates.select("barcode").inputFiles()
    assert 0 < len({x.split("bucket=")[1].split("/")[0] for x in read}) <= T.BUCKETS
    # nothing is scored below the join of candidates and products
    lines = find.matches(products, "blue bolt", index)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(lines) if "Join Inner" in x)
    assert "transform" in lines[join] and not any("transform" in x for x in lines[join + 1 :])


def test_an_index_is_built_once(spark, tiny):
    assert lookups.product_index(spark, tiny) is lookups.product_index(spark, tiny)
