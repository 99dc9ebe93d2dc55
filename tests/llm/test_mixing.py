"""Mixing keeps to the weights of every source, over many periods and with many sources."""

import math
import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from larder.llm import mixing
from tests.llm.cases import no_documents, odd_documents


def most_off(order, weights):
    """By how many blocks any source is off its share of the slots so far, at any slot of the order."""
    total, done, worst = sum(weights.values()), Counter(), 0.0
    for n, source in enumerate(order, 1):
        # what a source is off grows between its blocks, so it is looked at just before and after each
        w = weights[source] / total
        worst = max(worst, abs(done[source] - (n - 1) * w), abs(done[source] + 1 - n * w))
        done[source] += 1
    return max([worst, *(abs(done[s] - len(order) * w / total) for s, w in weights.items())])


def plain_edf(weights, slots):
    """Source by source, earliest deadline first; ties: larger weight, then the hash of the source."""
    from hashlib import md5

    d, done, out = sum(weights.values()), Counter(), []
    order = sorted(weights, key=lambda s: (-weights[s], md5(("=" + s).encode()).hexdigest()))
    for t in range(slots):
        ready = [(-(-(done[s] + 1) * d // weights[s]), i) for i, s in enumerate(order) if done[s] * d // weights[s] <= t]
        s = order[min(ready)[1]]
        out.append(s)
        done[s] += 1
    return out


@pytest.mark.parametrize("weights", [{"x": 100, **{f"s{i}": 1 for i in range(99)}}, {"a": 5, "b": 3, "c": 1, "d": 1}, {"a": 333, "b": 333, "c": 334}, {"a": 7}, {"a": 900, "b": 50, "c": 30, "d": 20, "e": 20}])
def test_slots_are_those_of_earliest_deadline_first(spark, weights):
    sources = spark.createDataFrame(list(weights.items()), "k string, a long")
    d = sum(weights.values())
    got = sorted(mixing.one_period(sources).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in got] == list(range(d))
    want = plain_edf(weights, d)
    assert [r["a"] for r in got] == [weights[s] for s in want] and most_off(want, weights) < 1


def in_order(df):
    return [r[1] for r in sorted(map(tuple, df.where("slot is not null").collect()), key=lambda r: (r[3], r[4]))]


@pytest.mark.parametrize("integers", [True, False])
def test_every_source_is_less_than_a_block_off_its_target(spark, integers):
    """Weights 100 and 99 times 1, and as fractions 0.9 and 12 small ones, over many periods."""
    if integers:
        weights, n = {"hot": 100, **{f"s{i}": 1 for i in range(99)}}, {"hot": 5000, **{f"s{i}": 50 for i in range(99)}}
    else:
        weights, n = {"hot": 0.9, **{f"s{i}": 0.1 / 12 for i in range(12)}}, {"hot": 9000, **{f"s{i}": 83 for i in range(12)}}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, k in n.items() for _ in range(k))], "doc_id long, source string")
    given = spark.createDataFrame(list(weights.items()), f"source string, weight {'long' if integers else 'double'}")
    rows = mixing.schedule(docs, given, block=1).collect()
    order = [r["source"] for r in sorted(rows, key=lambda r: r["slot"])]
    assert sorted(r["slot"] for r in rows)[:9000] == list(range(9000))
    assert most_off(order[:9000], weights) < 1
    for r in rows:
        assert r["release"] <= r["slot"] < r["deadline"]


def test_a_thousand_sources_over_a_hundred_thousand_slots(spark):
    r = random.Random(4)
    weights = {f"s{i}": r.randint(1, 200) for i in range(1000)}
    sources = spark.createDataFrame(list(weights.items()), "k string, a long")
    got = sorted(mixing.one_period(sources).collect(), key=lambda x: x["slot"])
    d = sum(weights.values())
    assert d > 90_000 and len(got) == d
    done = Counter()
    for x in got:  # the nth block of a weight is the (n div m)th of each of its m sources
        a, m, n, t = x["a"], x["m"], x["nth"], x["slot"]
        assert n == done[a] and (n // m) * d // a <= t < -(-(n // m + 1) * d // a)
        done[a] += 1
    # released at floor and done by ceil: less than a block off, for every source at every slot


def test_unequal_sources_equal_the_sql(spark, tmp_path):
    data = [(i, f"s{i % 45}") for i in range(2000)] + [(5000 + i, "hot") for i in range(900)] + [(9000 + i, None) for i in range(40)] + [(9900 + i, f"t{i}") for i in range(20)]
    docs = spark.createDataFrame(data, "doc_id long, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents/*.parquet')")
    want = con.execute(mixing.oracle()).fetchall()
    got = sorted(map(tuple, mixing.schedule(docs, mixing.tempered(docs)).collect()))
    assert got == sorted(want) and len({r[1] for r in got}) == 67
    assert {r["weight"] for r in mixing.tempered(docs).collect()} == {64, 14, 13, 2}
    assert max(abs(64 * math.sqrt(n / 900) - w) for n, w in ((44, 14), (45, 14), (40, 13), (1, 2))) < 0.5


def test_odd_weights_and_tables(spark):
    docs = spark.createDataFrame([(i, f"s{i % 600}") for i in range(3000)] + [(9000 + i, "hot") for i in range(1500)], "doc_id long, source string")
    some = spark.createDataFrame([("hot", 2), ("hot", 3), ("s1", 1), ("s2", None), ("s3", 0), ("s4", -5), ("absent", 4)], "source string, weight long")
    out = mixing.schedule(docs, some, block=4).collect()
    assert {r["source"] for r in out if r["slot"] is not None} == {"hot", "s1"} and len(out) == 4500
    assert len({(r["slot"], r["place"]) for r in out if r["slot"] is not None}) == 1505
    none = spark.createDataFrame([], "source string, weight long")
    assert all(r["slot"] is None for r in mixing.schedule(docs, none).collect())
    empty = no_documents(spark)
    assert mixing.schedule(empty, mixing.tempered(empty)).collect() == []


def test_order_of_the_mix_reaches_the_pipelines_result(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    order = [r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    got = corpus_pipeline.encode(spark, docs, "").orderBy("slot", "place").collect()
    assert [r["doc_id"] for r in got] == order and got[0]["slot"] == 0
    odd = corpus_pipeline.encode(spark, odd_documents(spark), "").collect()
    assert len({(r["slot"], r["place"]) for r in odd}) == len(odd) == odd_documents(spark).count()
