"""Operator 11 against all pairs in exact Python integers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from larder.llm import negatives


def plain(rows, asks, k=5, n=3, low=50, high=95):
    clamp = lambda x: max(-(2**63) + 1, min(2**63 - 1, x))
    whole = [(i, label, [math.floor(256 * x) if abs(x) < 2.0**46 else int(x) * 256 for x in v]) for i, label, v in rows]
    width = max(len(v) for _, _, v in whole)
    whole = [(i, label, v + [0] * (width - len(v))) for i, label, v in whole]
    anchors = {}
    for i, label, v in sorted(whole):
        if asks(i):
            anchors.setdefault(i, (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-clamp(sum(x * y for x, y in zip(v, w))), i, other == label) for i, other, w in whole if i != a)
        for p, i, _ in [x for x in scored if x[2]][:k]:
            fits = [(s, j) for s, j, same in scored if not same and low * -p <= 100 * -s <= high * -p][:n]
            out += [(a, i, r + 1, j, -p, -s) for r, (s, j) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, kind="double", **more):
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], f"vec_id long, label int, embedding array<{kind}>, rank int, score double")
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("id") % 10 == 0, **more).collect()))


@pytest.mark.parametrize("scale", [0.3, 40.0, 3e6, 1e12])
def test_equals_all_pairs(spark, scale):
    r = random.Random(int(scale * 10))
    data = [(i, r.choice([0, 0, 0, 1, 2, 9]), [r.gauss(0.4, 1) * scale * (1 + i % 4) for _ in range(5)]) for i in range(260)]
    data += [(260 + i, i % 3, data[10][2]) for i in range(40)]  # a common vector: ties over labels
    data += [data[20], (20, 5, [1.0, 2.0]), (301, 1, [0.0] * 5), (310, 2, [0.0] * 5), (-10, 0, [scale])]  # repeats, short ones, zeros, negative ids
    bad = [(900, 1, None), (910, 1, [1.0, None]), (920, 0, [float("nan")] * 5), (930, 0, [float("-inf")] * 5), (None, 0, [1.0] * 5), (940, None, [1.0] * 5)]
    got = mined(spark, data + bad)
    assert got == plain(data, lambda i: i % 10 == 0) and len(got) > (100 if scale < 1e7 else 9)  # of the largest, most scores are beyond 64 bits


def test_other_parameters(spark):
    r = random.Random(3)
    data = [(i, i % 4, [r.gauss(0, 1) for _ in range(3)]) for i in range(150)]
    got = mined(spark, data, positives=2, negatives=7, low=10, high=120)
    assert got == plain(data, lambda i: i % 10 == 0, 2, 7, 10, 120) and got


def test_many_groups_and_pruned_buckets(spark, monkeypatch):
    """Groups and buckets of a few rows, blocks of a few anchors: the same result, from fewer scores."""
    for name, value in (("GROUP_BYTES", 4096 * 4 * 2), ("CHUNK", 16), ("ANCHORS", 4), ("HEAD", 30)):
        monkeypatch.setattr(negatives, name, value)
    r = random.Random(5)
    data = [(i, r.choice([0, 0, 1, 2]), [r.gauss(0.5, 1) * (8.0 if i % 17 == 0 else 1.0 / (1 + i % 50)) for _ in range(4)]) for i in range(900)]
    assert mined(spark, data) == plain(data, lambda i: i % 10 == 0)


def test_few_buckets_are_scored():
    """Of candidates by falling length, only those that may reach a window's limit are multiplied."""
    import numpy as np

    r = np.random.default_rng(1)
    kind = negatives.Kind(8, 100.0)
    m = (r.normal(size=(20_000, 8)) * np.linspace(20, 0.01, 20_000)[:, None])
    rows = negatives.Rows(kind, np.arange(20_000), r.integers(0, 3, 20_000), kind.unpack(kind.pack(np.floor(m * 256) / 256)))
    seen, group, a = [], negatives.Group(rows), rows.taken(np.arange(0, 64))
    place, _, scores = group.positives(a, np.full(64, negatives.NONE + 1), 5)
    low, high = np.full((64, 5), negatives.LONG), np.full((64, 5), negatives.NONE)
    for i in range(64):
        own = np.sort(scores[place == i])[::-1]
        low[i, : len(own)], high[i, : len(own)] = negatives.limits(own, 50, 95)
    count = kind.scores
    kind.scores = lambda x, y: (seen.append(len(x) * len(y)), count(x, y))[1]
    group.negatives(a, low, high, 3)
    assert 0 < sum(seen) < 0.6 * 64 * 20_000


def test_limits_are_exact():
    import numpy as np

    for p in (0, 1, 7, 99, 100, 101, 12345, 2**53 + 1, 2**63 - 1, -1, -100):
        low, high = (int(x[0]) for x in negatives.limits(np.array([p]), 50, 95))
        if p < 0:
            assert low > high
        else:
            assert 100 * low >= 50 * p > 100 * (low - 1) and 100 * high <= 95 * p < 100 * (high + 1) or low > high and -(-50 * p // 100) > 95 * p // 100


def test_small_tables(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, 1, [1.0])]) == [] and mined(spark, [(0, 1, []), (1, 1, []), (2, 0, [])]) == plain([(0, 1, []), (1, 1, []), (2, 0, [])], lambda i: i % 10 == 0)
    vast = [(i, i % 2, [3e38, -3e38 * (i % 3)]) for i in range(30)]  # beyond 64 bits
    assert mined(spark, vast) == plain(vast, lambda i: i % 10 == 0)
    only = [(i, 4, [1.0 + i]) for i in range(20)]  # no other label
    assert mined(spark, only, "float") == []
