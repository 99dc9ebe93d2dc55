"""Ingredient tokens, segmentation and match: hand-derived values."""

import itertools
import math

from pyspark.sql import functions as F

from larder.operators import ingredients as I

ONTOLOGY = [
    (0, "Açúcar", "acucar", "ALTO", ["sacarose", "acucar mascavo"]),
    (1, "Farinha de trigo", "farinha", "MODERADO", ["trigo"]),
    (2, "Aveia", "fibra", "BENEFICO", []),
    (3, "Stevia", "edulcorante_natural", "SEGURO", ["aveia", "estevia"]),
    (4, "Glúten", "outro", "QUALQUER", []),
]


def ontology(spark):
    return spark.createDataFrame(ONTOLOGY, "entry int, display string, class string, risk string, synonyms array<string>")


def matched(spark, text):
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    return {r["original"]: (r["entry"], r["kind"], r["distance"]) for r in I.match(I.tokens(docs, "id", "text"), ontology(spark)).collect()}


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "INGREDIENTES: açúcar (INS 330), sal*; E 100a. (de cana) x, farinhadetrigo"), (2, None), (3, "")], "id long, text string")
    got = sorted((r["id"], r["pos"], r["original"], r["normalized"]) for r in I.tokens(docs, "id", "text").collect())
    assert [(g[2], g[3]) for g in got] == [("açúcar", "acucar"), ("sal", "sal"), ("farinhadetrigo", "farinha trigo")]


def test_layers(spark):
    got = matched(spark, "açúcar, acucar refinado, sacarosee, mascavo, stevia doce puro, aveiaa, nada disso, xx trigo yy, glutem extra aveia")
    assert got["açúcar"] == (0, "exact", 0)
    assert got["acucar refinado"] == (0, "containment", 9)
    assert got["sacarosee"] == (0, "levenshtein", 1)
    assert got["mascavo"] == (0, "containment", 7)  # the token inside a key
    assert got["aveiaa"] == (2, "levenshtein", 1)  # a display's slot isn't taken by a later synonym
    assert got["xx trigo yy"] == (1, "containment", 6)
    assert got["nada disso"] == (None, "none", -1)
    assert got["glutem extra aveia"][1] == "containment"


def test_decomposition_takes_the_worst_word(spark):
    got = matched(spark, "aveja sacarosi zz")
    assert got["aveja sacarosi zz"] == (0, "word_decomposition", 0)


def test_report(spark):
    docs = spark.createDataFrame([(1, "stevia, trigo, açúcar, sacarose, pedra, glúten"), (2, "pedra")], "id long, text string")
    r = {x["id"]: x for x in I.report(I.match(I.tokens(docs, "id", "text"), ontology(spark)), ontology(spark)).collect()}
    assert (r[1]["worst"], r[2]["worst"]) == ("ALTO", "NENHUM")
    assert [a["original"] for a in r[1]["alerts"]] == ["açúcar", "trigo", "stevia", "glúten"]
    assert (r[1]["high_risk"], r[1]["safe_sweeteners"], r[1]["unmatched"]) == (["açúcar"], ["stevia"], ["pedra"])
    text = {x["id"]: x["text"] for x in I.text_report(I.report(I.match(I.tokens(docs, "id", "text"), ontology(spark)), ontology(spark))).collect()}
    assert "[ALTO RISCO]\n  - açúcar" in text[1] and "Nao classificados (1): pedra" in text[2]


def test_segmenter_finds_the_cheapest_cut():
    vocabulary = {"de": 100, "da": 80, "trigo": 12, "farinha": 15, "sal": 20, "a": 1}
    s = I.Segmenter(vocabulary)
    log_total = math.log(sum(vocabulary.values()))
    cost = lambda w: log_total - math.log(vocabulary[w]) if w in vocabulary else log_total + 5 * len(w)
    for letters in ("farinhadetrigo", "saldetrigo", "xxsal", "qqqqqqq", "ab", "desal"):
        cuts = [[letters[i:j] for i, j in zip((0, *c), (*c, len(letters)))] for n in range(len(letters)) for c in itertools.combinations(range(1, len(letters)), n)]
        cuts = [c for c in cuts if max(map(len, c)) <= s.longest]
        least = min(sum(map(cost, c)) for c in cuts)
        got = s.cut(letters)
        if len(letters) > 2 and got != [letters]:
            assert abs(sum(map(cost, got)) - least) < 1e-9
    assert s.cut("farinhadetrigo") == ["farinha", "de", "trigo"] and s.cut("") == [] and s.cut("xy") == ["xy"]
    assert s.meaningful("farinhadetrigo") == "farinha trigo"


def test_parts_miss_no_key(spark):
    """Random texts and keys: what the equi-joins find equals what all pairs would give."""
    import random

    r = random.Random(7)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
    names = [" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(60)] + ["".join(r.choice("ab") for _ in range(n)) for n in range(3, 30)]
    changed = []
    for k in names:
        letters = list(k)
        for _ in range(r.randint(1, 3)):
            at = r.randrange(len(letters))
            letters[at : at + 1] = r.choice([[], [letters[at], "a"], ["b"]])
            letters = letters or ["a"]
        changed.append(" ".join("".join(letters).split()))
    texts = sorted({t for t in changed + [f"zz {k} yy" for k in names[:20]] + [k[1:] for k in names] if len(t) >= 3})
    onto = spark.createDataFrame([(i, n, "c", "ALTO", []) for i, n in enumerate(names)], "entry int, display string, class string, risk string, synonyms array<string>")
    keys = {(row["ordinal"], row["key"], row["entry"]) for row in I.index(onto).collect()}
    asked = spark.createDataFrame([(t,) for t in texts], "normalized string")
    got = {row["normalized"]: (row["entry"], row["kind"], row["distance"]) for row in I._layers(asked, I.index(onto)).collect()}

    def bounded(text, key):
        at = text.find(key)
        return at >= 0 and (at == 0 or text[at - 1] == " ") and (at + len(key) == len(text) or text[at + len(key)] == " ")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for t in texts:
        exact = [e for _, k, e in keys if k == t]
        near = []
        for o, k, e in keys:
            inside = bounded(t, k) or len(t) >= 5 and bounded(k, t)
            most = max(1, min(3, len(k) // 6))
            if inside or edits(t, k) <= most:
                near.append((abs(len(t) - len(k)) if inside else edits(t, k), o, "containment" if inside else "levenshtein", e))
        want = (exact[0], "exact", 0) if exact else (min(near)[3], min(near)[2], min(near)[0]) if near else None
        assert got.get(t) == want, t


def test_matching_reads_the_texts_once(spark, tiny):
    """The final plan of a match or a report has one scan of the parts, one of what was found for distinct texts, and one Python step."""
    import re

    from larder.plans import risk

    for name in ("j08_ontology_match", "a05_report_lists"):
        df = {"j08_ontology_match": risk.matches, "a05_report_lists": lambda s, d: risk.I.report(risk.matches(s, d), risk.ontology(s))}[name](spark, tiny)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(re.findall("FileScan parquet .*p_partkey", plan)) <= 2 and len(re.findall("FileScan", plan)) <= 3, plan
        assert len(re.findall("MapInArrow", plan)) <= 1


def test_a_vocabulary_of_any_size_cuts_as_a_small_one(spark):
    import random

    r = random.Random(5)
    vocabulary = {"".join(r.choice("abcde") for _ in range(r.randrange(2, 9))): r.randrange(1, 9000) for _ in range(300)}
    words = list(vocabulary)
    texts = [(i, ", ".join(" ".join("".join(r.choice(words) for _ in range(r.randrange(1, 5))) + r.choice(["", "x", "é", "9"]) for _ in range(r.randrange(1, 4))) for _ in range(3))) for i in range(80)]
    texts += [texts[0], (90, None), (91, ""), (92, "zzzzzzzzzzzzzzzzzz"), (93, "12345678901234")]
    docs = spark.createDataFrame(texts, "id int, text string")
    table = spark.createDataFrame([(w, n) for w, n in vocabulary.items()] + [(words[0], 0), (None, 5)], "word string, n int")
    small = sorted(map(tuple, I.tokens(docs, "id", "text", vocabulary).collect()))
    assert sorted(map(tuple, I.tokens(docs, "id", "text", table).collect())) == small and len(small) > 150
    none = table.limit(0)
    assert sorted(map(tuple, I.tokens(docs, "id", "text", none).collect())) == sorted(map(tuple, I.tokens(docs, "id", "text", {}).collect()))


def test_tokens_are_made_in_many_tasks(spark, tiny):
    """The table of parts is one small file; its texts are cut and folded in as many tasks as a shuffle has."""
    from larder.plans import risk

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert risk.toks(spark, tiny).select("id").rdd.getNumPartitions() >= n > 2


def test_a_text_is_cut_once_and_an_original_folded_once(spark, tiny):
    """Reading tokens cleans, cuts and folds nothing: it joins what was written of texts with what was written of distinct originals."""
    from larder.plans import risk

    df = risk.toks(spark, tiny)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 2 and "split(" not in plan and "regexp_replace" not in plan and "Union" not in plan, plan


def test_sublists_of_one_report(spark, tiny):
    """Every name of both lists has a row, also where a document has one list or both."""
    from larder.plans import risk

    r = risk.I.report(risk.matches(spark, tiny), risk.ontology(spark)).collect()
    want = sorted((x["id"], o, name) for x in r for c, name in (("high_risk", "high"), ("safe_sweeteners", "sweetener")) for o in x[c])
    df = risk.p23(spark, tiny)
    assert "Union" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == want and {w[2] for w in want} == {"high", "sweetener"}


def test_a_report_deals_tokens_out_once(spark, tiny):
    """Tokens go by document in one shuffle, never by the few entries of an ontology; sublists are two lists of one report."""
    from larder.plans import risk

    for query in (risk.f30, risk.p23):
        plan = query(spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(entry" not in plan, plan
        assert plan.count("FileScan") == 3, plan
