"""Disguised words of any length are decoded, under the model that the query really trains."""

import itertools
import math
import random

import numpy as np
import pytest

from larder.llm import toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def restorer(spark):
    found = toxicity.gram_counts(spark.read.parquet(f"{FOLDER}/documents.parquet")).toArrow()
    counts = np.zeros(toxicity.SIZE**toxicity.ORDER, np.int64)
    counts[found["gram"].to_numpy()] = found["n"].to_numpy()
    return toxicity.Restorer(toxicity.Channel.of(counts))


def test_counts_equal_plain_ones(spark):
    texts = ["Well, IDIOT  ", "é a!!b", None, "", "x"]
    got = {r["gram"]: r["n"] for r in toxicity.gram_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    want: dict = {}
    for t in ("well idiot ", "~ a b", "x"):
        line = [0] * 3 + [0 if x == " " else 27 if x == "~" else ord(x) - 96 for x in t] + [0] * 3
        for i in range(len(line) - 3):
            if line[i] or line[i + 1]:
                g = ((line[i] * 28 + line[i + 1]) * 28 + line[i + 2]) * 28 + line[i + 3]
                want[g] = want.get(g, 0) + 1
    assert got == want


@pytest.mark.parametrize(
    ("shown", "meant"),
    [
        ("1d10t", "idiot"), ("id1ot", "idiot"), ("1d1o7", "idiot"), ("!d!ot", "idiot"), ("iidiioot", "idiot"), ("i d i o t", "idiot"), ("w0rthle55", "worthless"), ("cl()wn", "clown"), ("cl0wn", "clown"), ("m0r0n", "moron"),
        ("l.o.s.e.r", "loser"), ("$tupid", "stupid"), ("stuuuupid", "stupid"), ("st" + "u" * 40 + "pid", "stupid"), ("i" + " d" * 30 + " i o t", None), ("y o u i d i o t", "you idiot"), ("id*ot", "idiot"), ("sc*m", "scum"),
        ("іdіоt", "idiot"), ("ｉｄｉｏｔ", "idiot"), ("idiot###", "idiot"), ("a n i d i o t a n d a l o s e r", "idiot and a loser"),
    ],
)
def test_disguises_are_read_under_the_trained_model(restorer, shown, meant):
    found = restorer.restore(f"well {shown} there")
    assert found.startswith("well ") and found.endswith(" there")
    assert meant is None or meant in found


def test_clean_text_stays(restorer):
    for text in ("A plain sentence, with commas; it ends (here).", "The 3 men paid $40 on 2024-05-01 at 10:30.", "", "price: 12.50", "***"):
        assert restorer.restore(text) == text


def test_decoding_equals_trying_everything(restorer):
    """The cheapest of all paths through the lattice, for short tokens."""
    r, channel = random.Random(2), restorer.channel
    for _ in range(150):
        token = "".join(r.choice("aidot1107$!@.()[]v5*") for _ in range(r.randint(1, 6)))
        steps = channel.options(token)
        if math.prod(map(len, steps)) > 30_000:
            continue
        best = (math.inf, "")
        for path in itertools.product(*steps):
            cost, state, read, fine = 0.0, (0,) * (toxicity.ORDER - 1), "", True
            for letters, extra in path:
                if letters == " " and state[-1] == 0:
                    fine = False
                    break
                more, state = channel.price(state, letters)
                cost, read = cost + extra + more, read + letters
            if fine:
                cost += float(channel.cost[state][0]) if state[-1] else 0.0
                best = min(best, (cost, read), key=lambda x: x[0])
        found = channel.decode(token)
        assert found == best[1].strip() or math.isclose(priced(channel, steps, found), best[0], rel_tol=1e-6), token


def priced(channel, steps, found):
    """The least cost of a path that reads so."""
    costs = []
    for path in itertools.product(*steps):
        if "".join(x for x, _ in path).strip() == found:
            cost, state = 0.0, (0,) * (toxicity.ORDER - 1)
            for letters, extra in path:
                more, state = channel.price(state, letters)
                cost += extra + more
            costs.append(cost + (float(channel.cost[state][0]) if state[-1] else 0.0))
    return min(costs)


def test_very_long_disguised_tokens_take_time_in_proportion(restorer):
    import time

    for unit in ("1d", "a.", "a ", "aab", "()", "x*", "aaa"):
        text = unit * (40_000 // len(unit))
        began = time.process_time()
        restorer.restore(text)
        assert time.process_time() - began < 20, unit


def test_the_fit_is_the_penalised_maximum():
    """At the weights found, the slope of the penalised likelihood is nothing in every direction, worked out plainly."""
    r = random.Random(3)
    words, sure = ["a", "b", "^cc"], frozenset({"a"})
    rows = [([w for w in words if r.random() < 0.4], r.randrange(2), r.randint(1, 9)) for _ in range(40)]
    weights, intercept, some = toxicity._fit(words, sure, rows)
    model = toxicity.Model(np.zeros(0), words, weights, intercept, some, sure)
    known = toxicity.Telling(words)
    slopes = {w: -0.2 * weights[i] for i, w in enumerate(words)} | {"some": -0.02 * some, "intercept": -1e-6 * intercept}
    for found, y, n in rows:
        off = n * (y - model.score(set(found), known))
        for w in found:
            slopes[w] += off
        slopes["some"] += off * ("a" in found)
        slopes["intercept"] += off
    assert all(abs(x) < 1e-4 for x in slopes.values()), slopes
