"""Ingredient lists: tokens, fuzzy ontology match, risk report (F-10 to F-12, J-08 to J-11, A-02 to A-05, O-05, O-11, P-23)."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import bounded_first, fold
from larder.sources.tables import written

#: Risk levels from worst to least; others rank 99.
RISKS = ("ALTO", "MODERADO-ALTO", "MODERADO", "BAIXO", "SEGURO", "BENEFICO", "INFORMATIVO")
UNKNOWN_RISK, NO_RISK = 99, "NENHUM"
SWEETENERS = ("edulcorante_artificial", "edulcorante_natural")
#: Words that are dropped from what segmentation yields.
STOPWORDS = """de da do das dos e com em por para ao a o as os na no nas nos um uma ou se ate sem entre que
manter conservar guardar armazenar consumir utilizar usar
contem pode tracos tracas identico identica identicos identicas semelhante semelhantes tipo sabor sabores similar
local seco seca limpo limpa fresco fresca gelado gelada temperatura ambiente fechado fechada apos abertura validade fabricacao lote i""".split()
#: A small vocabulary with frequencies, for where none is given.
FALLBACK_VOCABULARY = {"de": 10000, "da": 8000, "do": 8000, "e": 9000, "com": 4000, "acucar": 2000, "sal": 2000, "agua": 2000, "gordura": 800, "vegetal": 1000, "farinha": 1500, "trigo": 1200, "soja": 1000, "amido": 1000, "leite": 1500, "oleo": 1500, "aveia": 600}
#: What is removed from a text, in this order, and where it is split.
REMOVED = ((r"(?iU)\(?\b(?:INS|INA|E|ADT)\s*\d{3}[a-z]?\b\)?", ""), (r"\([^)]{1,60}\)", ""), (r"[*†‡§¶#@|]", ""), (r"(?U)[A-ZÁÉÍÓÚÀÂÊÔÃÕ\s]{4,}:", " "))
LONG_WORD, UNKNOWN_PENALTY, MOST_UNKNOWN = 10, 5, 0.6
#: Edit distance: a letter in so many, but at least and at most these.
LETTERS_AN_EDIT, LEAST_EDITS, MOST_EDITS = 6, 1, 3


def risk_rank(risk: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(r) for r in RISKS]), risk)
    return F.when(place > 0, place - 1).otherwise(UNKNOWN_RISK).cast("int")


class Segmenter:
    """F-12: the cheapest way to cut a run of letters into words. A word of the vocabulary costs log(total) - log(its
    frequency), another log(total) and UNKNOWN_PENALTY a letter; ties go to the earliest start of the last word."""

    def __init__(self, vocabulary: dict[str, int], total: int | None = None, longest: int | None = None) -> None:
        """With the whole vocabulary's sum of frequencies and longest word, its words that lie in the text at hand are enough."""
        self.vocabulary = vocabulary if total else vocabulary or FALLBACK_VOCABULARY
        self.longest = longest or max(map(len, self.vocabulary))
        self.total = math.log(total or sum(self.vocabulary.values()))
        self.cost = {w: self.total - math.log(n) for w, n in self.vocabulary.items() if n}

    def cut(self, letters: str) -> list[str]:
        """Expects letters a-z only."""
        n = len(letters)
        if n <= 2:
            return [letters] if letters else []
        cheapest, start = [0.0], [0]
        for end in range(1, n + 1):
            choices = ((cheapest[at] + self.cost.get(letters[at:end], self.total + UNKNOWN_PENALTY * (end - at)), at) for at in range(max(0, end - self.longest), end))
            total, at = min(choices)  # of equal totals the smallest start
            cheapest.append(total)
            start.append(at)
        words, end = [], n
        while end:
            words.append(letters[start[end] : end])
            end = start[end]
        words.reverse()
        unknown = sum(w not in self.vocabulary for w in words)
        return [letters] if len(words) > 1 and unknown / len(words) > MOST_UNKNOWN else words

    def meaningful(self, word: str) -> str:
        """F-11 for one long folded word: its parts without stopwords and short words, or itself if none are left."""
        kept = [w for w in self.cut("".join(c for c in word if "a" <= c <= "z")) if w not in STOPWORDS and len(w) >= 3]
        return " ".join(kept) or word


def segmented_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, parts) of distinct long folded words (word): F-11 with a vocabulary (word, n) of any size. All that may be a word in a text meets the
    vocabulary in an equi-join, and each text is cut by what is left; the whole vocabulary goes nowhere."""
    known = vocabulary.where("n > 0 and word is not null").groupBy("word").agg(F.max("n").cast("long").alias("n"))
    total, longest = known.agg(F.sum("n"), F.max(F.length("word"))).first()
    if not total:
        known = vocabulary.sparkSession.createDataFrame(list(FALLBACK_VOCABULARY.items()), "word string, n long")
        total, longest = sum(FALLBACK_VOCABULARY.values()), max(map(len, FALLBACK_VOCABULARY))
    runs = words.select("word", F.regexp_replace("word", "[^a-z]", "").alias("run")).where("run <> ''")
    inside = F.expr(f"array_distinct(flatten(transform(sequence(1, length(run)), at -> transform(sequence(1, least({longest}, length(run) - at + 1)), size -> substr(run, at, size)))))")
    found = runs.select("word", F.explode(inside).alias("part")).join(known.withColumnRenamed("word", "part"), "part").groupBy("word").agg(F.collect_list("part").alias("parts"), F.collect_list("n").alias("ns"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, parts, ns = (batch.column(i).to_pylist() for i in range(3))
            out = [Segmenter(dict(zip(p or (), n or ())), total, longest).meaningful(w) for w, p, n in zip(own, parts, ns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["word", "parts"])

    return words.join(found, "word", "left").select("word", "parts", "ns").mapInArrow(cut, "word string, parts string")


def tokens(docs: DataFrame, id_col: str, text: str, vocabulary: dict[str, int] | DataFrame | None = None) -> DataFrame:
    """(id, pos, original, normalized): F-10. Texts are cut once and written; originals repeat, so each distinct one is folded once and joined back."""
    cleaned = F.coalesce(F.col(text), F.lit(""))
    for pattern, to in REMOVED:
        cleaned = F.regexp_replace(cleaned, pattern, to)
    stripped = F.transform(F.split(cleaned, "[,;.]", -1), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    parts = written(docs.select(F.col(id_col).alias("id"), F.posexplode(stripped).alias("pos", "original")).where("original <> ''"), "parts")
    names = written(normalized(parts.select("original").distinct(), vocabulary), "normalized")
    return parts.join(names, "original").select("id", "pos", "original", "normalized")


def normalized(originals: DataFrame, vocabulary: dict[str, int] | DataFrame | None = None) -> DataFrame:
    """(original, normalized) of distinct texts (original): F-11; what is shorter than 3 characters has no row. Only long words go through Python: each
    as it comes by a small vocabulary that every task has, or each distinct one once by a table (word, n) of any size."""
    words = F.filter(F.transform(F.split("original", r"(?U)\s+", -1), fold), lambda w: w != "")
    folded = written(originals.select("original", words.alias("words")), "folded")
    has_long = F.exists("words", lambda w: F.length(w) > LONG_WORD)
    short = folded.where(~has_long).select("original", F.array_join("words", " ").alias("normalized"))
    if isinstance(vocabulary, DataFrame):
        rows = folded.where(has_long).select("original", F.posexplode("words").alias("nth", "word"))
        asked = written(rows.where(F.length("word") > LONG_WORD).select("word").distinct(), "long")
        both = rows.join(written(segmented_words(asked, vocabulary), "segmented"), "word", "left")
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.coalesce("parts", "word").alias("w")))), lambda x: x["w"]), " ")
        cut = both.groupBy("original").agg(whole.alias("normalized"))
        return short.unionByName(cut).where(F.length("normalized") >= 3)

    def segmented(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, known = Segmenter(vocabulary or {}), {}
        for batch in batches:
            out = []
            for ws in batch.column(1).to_pylist():
                for w in ws:
                    if len(w) > LONG_WORD and w not in known:
                        if len(known) > 500_000:
                            known.clear()
                        known[w] = segmenter.meaningful(w)
                out.append(" ".join(known[w] if len(w) > LONG_WORD else w for w in ws))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["original", "normalized"])

    long = folded.where(has_long).mapInArrow(segmented, "original string, normalized string")
    return short.unionByName(long).where(F.length("normalized") >= 3)


def index(ontology: DataFrame) -> DataFrame:
    """S-09: (ordinal, key, entry) from rows (entry, display, synonyms). A display's key takes its slot from whatever
    held it, a synonym only takes a free one; a slot keeps the place where it first appeared."""
    names = ontology.select("entry", F.posexplode(F.concat(F.array("display"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("nth", "name"))
    keys = names.select("entry", "nth", fold(F.col("name")).alias("key")).where("key <> '' or nth = 0")
    place = F.struct("entry", "nth")
    slots = keys.groupBy("key").agg(F.min(place).alias("place"), F.max(F.when(F.col("nth") == 0, F.col("entry"))).alias("own"), F.min(F.when(F.col("nth") > 0, place)).alias("first"))
    return slots.select((F.col("place.entry") * 1000 + F.col("place.nth")).alias("ordinal"), "key", F.coalesce("own", "first.entry").alias("entry"))


def _edits(length: Column) -> Column:
    """How many edits a key of this length allows."""
    return F.greatest(F.lit(LEAST_EDITS), F.least(F.lit(MOST_EDITS), F.floor(length / LETTERS_AN_EDIT))).cast("int")


def _cut(rows: DataFrame) -> DataFrame:
    """Rows with a key's length ``long`` and its ``edits``: one for each of edits + 1 parts of it, ``nth`` from 0, with where it starts and its size."""
    parts = F.col("edits") + 1
    base, short = F.floor(F.col("long") / parts).cast("int"), parts - F.col("long") % parts
    nth = F.col("nth")
    each = rows.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    return each.withColumn("start", nth * base + F.greatest(F.lit(0), nth - short)).withColumn("size", base + F.when(nth >= short, 1).otherwise(0))


def _near(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """(normalized, ordinal, key, entry): every key within its edits of a text, and some others.

    With k edits one of a key's k + 1 parts stays whole. It lies in the text where the edits before and after it, of which
    there are k in all, can have shifted it; so texts and keys meet by that part, in an equi-join.
    """
    n, apart = F.length("normalized"), F.length("normalized") - F.col("long")
    own = _cut(keys.withColumn("long", F.length("key")).where("long > 0").withColumn("edits", _edits(F.col("long"))))
    own = own.select("ordinal", "key", "entry", "long", "nth", F.substring("key", F.col("start") + 1, F.col("size")).alias("part"))
    wide = asked.withColumn("long", F.explode(F.sequence(F.greatest(F.lit(1), n - MOST_EDITS), n + MOST_EDITS))).withColumn("edits", _edits(F.col("long"))).where(F.abs(apart) <= F.col("edits"))
    cut = _cut(wide)
    before, after = F.col("nth"), F.col("edits") - F.col("nth")
    first = F.greatest(F.lit(0), F.col("start") - before, F.col("start") + apart - after)
    last = F.least(n - F.col("size"), F.col("start") + before, F.col("start") + apart + after)
    at = cut.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("at", F.explode(F.sequence("first", "last")))
    probes = at.select("normalized", "long", "nth", F.substring("normalized", F.col("at") + 1, F.col("size")).alias("part")).distinct()
    return probes.join(own, ["long", "nth", "part"]).select("normalized", "ordinal", "key", "entry")


def _inside(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """(normalized, ordinal, key, entry): every key inside a text or the other way round, and some others. What lies
    between word ends in another text begins with one of its words."""
    words = lambda c: F.array_distinct(F.split(c, " "))
    begin = lambda c: F.substring_index(c, " ", 1)
    key_in = asked.select("normalized", F.explode(words("normalized")).alias("w")).join(keys.withColumn("w", begin("key")), "w")
    text_in = asked.where(F.length("normalized") >= 5).withColumn("w", begin("normalized")).join(keys.withColumn("w", F.explode(words("key"))), "w")
    columns = ("normalized", "ordinal", "key", "entry")
    return key_in.select(*columns).unionByName(text_in.select(*columns))


def _layers(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """(normalized, entry, kind, distance): exact hits; for the others the nearest of containment and edit distance,
    the key that stands first among equals. Each distinct text is matched once, and meets only keys it shares a part with."""
    exact = asked.join(keys, F.col("normalized") == F.col("key")).select("normalized", "entry", F.lit("exact").alias("kind"), F.lit(0).alias("distance"))
    rest = asked.join(keys.select("key"), F.col("normalized") == F.col("key"), "left_anti")
    token, key = F.col("normalized"), F.col("key")
    apart, most = F.abs(F.length(key) - F.length(token)), _edits(F.length(key))
    inside = bounded_first(token, key) | ((F.length(token) >= 5) & bounded_first(key, token))
    near = _inside(rest, keys).unionByName(_near(rest, keys)).withColumn("inside", inside).where(F.col("inside") | ((apart <= most) & (F.levenshtein(token, key) <= most)))
    rank = F.struct(F.when(F.col("inside"), apart).otherwise(F.levenshtein(token, key)).alias("distance"), "ordinal", F.when(F.col("inside"), "containment").otherwise("levenshtein").alias("kind"), "entry")
    best = near.groupBy("normalized").agg(F.min(rank).alias("b"))
    return exact.unionByName(best.select("normalized", "b.entry", "b.kind", "b.distance"))


def matched_texts(asked: DataFrame, ontology: DataFrame) -> DataFrame:
    """(normalized, entry, kind, distance) of distinct texts (normalized): J-08 to J-11. What no layer finds is cut in words, of which the one
    with the worst risk counts, the first among equals. Texts without a match have no row."""
    keys = index(ontology)
    whole = written(_layers(asked, keys), "whole")
    left = asked.join(whole.select("normalized"), "normalized", "left_anti").where(F.col("normalized").contains(" "))
    words = written(left.select(F.col("normalized").alias("token"), F.posexplode(F.split("normalized", " ")).alias("nth", "normalized")).where(F.length("normalized") >= 3), "words")
    found = words.join(_layers(words.select("normalized").distinct(), keys), "normalized").join(ontology.select("entry", "risk"), "entry")
    worst = found.groupBy(F.col("token").alias("normalized")).agg(F.min(F.struct(risk_rank(F.col("risk")).alias("r"), "nth", "entry"))["entry"].alias("entry"))
    return whole.unionByName(worst.select("normalized", "entry", F.lit("word_decomposition").alias("kind"), F.lit(0).alias("distance")))


def match(toks: DataFrame, ontology: DataFrame) -> DataFrame:
    """Tokens with (entry, kind, distance). Texts repeat, so distinct ones are written once, all layers work on that table, and what they
    find is joined back once. No match: kind none, distance -1."""
    asked = written(toks.select("normalized").distinct(), "asked")
    every = written(matched_texts(asked, ontology), "matched")
    joined = toks.join(every, "normalized", "left")
    return joined.select("id", "pos", "original", "normalized", "entry", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("distance", F.lit(-1)).alias("distance"))


def deduplicated(matches: DataFrame, ontology: DataFrame) -> DataFrame:
    """A-04: matched tokens with their entry's columns, the first of each entry in a document."""
    first = matches.where("entry is not null").groupBy("id", "entry").agg(F.min(F.struct("pos", "original", "kind", "distance")).alias("m"))
    return first.select("id", "entry", "m.*").join(ontology.drop("synonyms"), "entry")


def risk_summary(found: DataFrame) -> DataFrame:
    """A-02: (id, risk, n)."""
    return found.groupBy("id", "risk").agg(F.count(F.lit(1)).alias("n"))


def report(matches: DataFrame, ontology: DataFrame) -> DataFrame:
    """A-03, A-05, O-05, P-23: a row for each document with its worst risk, alerts by risk and position, and lists. Matches are dealt out
    once, by document: in there, those of an entry are put together, then entries."""
    token = F.struct("pos", "original", "kind", "distance")
    entries = matches.repartition("id").groupBy("id", "entry").agg(F.count(F.lit(1)).alias("n"), F.min(token).alias("m"), F.collect_list(F.when(F.col("entry").isNull(), F.struct("pos", "original"))).alias("u"))
    known = entries.join(ontology.drop("synonyms"), "entry", "left").withColumn("rank", risk_rank(F.col("risk")))
    alert = F.struct("rank", "m.pos", "m.original", "display", "class", "risk", "m.kind", "m.distance")
    grouped = known.groupBy("id").agg(F.sum("n").alias("tokens"), F.sort_array(F.collect_list(F.when(F.col("entry").isNotNull(), alert))).alias("alerts"), F.sort_array(F.flatten(F.collect_list("u"))).alias("u"))
    names = lambda keep: F.transform(F.filter("alerts", keep), lambda a: a["original"])
    return grouped.select(
        "id",
        "tokens",
        F.coalesce(F.get(F.col("alerts"), F.lit(0))["risk"], F.lit(NO_RISK)).alias("worst"),
        "alerts",
        F.transform("u", lambda x: x["original"]).alias("unmatched"),
        names(lambda a: a["risk"].isin("ALTO", "MODERADO-ALTO")).alias("high_risk"),
        names(lambda a: a["class"].isin(*SWEETENERS) & a["risk"].isin("BAIXO", "SEGURO")).alias("safe_sweeteners"),
    )


def unmatched_line(unmatched: Column, most: int = 10) -> Column:
    """O-11: the first ten, and dots if there are more."""
    return F.concat(F.array_join(F.slice(unmatched, 1, most), ", "), F.when(F.size(unmatched) > most, " ...").otherwise(""))


def text_report(reports: DataFrame, name: str = "id") -> DataFrame:
    """F-29: the heading and sections of a readable report, (id, text)."""
    section = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n{title}\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), x)), "\n"))).otherwise("")
    pick = lambda *risks: F.transform(F.filter("alerts", lambda a: a["risk"].isin(*risks)), lambda a: F.concat(a["original"], F.lit(" ("), a["class"], F.lit(")")))
    low = F.transform(F.filter("alerts", lambda a: a["risk"].isin("BENEFICO", "BAIXO") & ~a["class"].isin(*SWEETENERS, "poliol")), lambda a: F.concat(a["original"], F.lit(" ("), a["class"], F.lit(")")))
    counts = F.format_string("Tokens extraidos: %d | Identificados: %d | Nao classificados: %d", F.col("tokens"), F.size("alerts"), F.size("unmatched"))
    unknown = F.when(F.size("unmatched") > 0, F.concat(F.format_string("\n\nNao classificados (%d): ", F.size("unmatched")), unmatched_line(F.col("unmatched")))).otherwise("")
    head = F.concat(F.lit("=== ANALISE DE INGREDIENTES — DIABETES MELLITUS ===\nImagem: "), F.col(name).cast("string"), F.lit("\nRisco global: "), F.col("worst"), F.lit("\n"), counts)
    body = [section("[ALTO RISCO]", F.col("high_risk")), section("--- Moderado ---", pick("MODERADO")), section("[EDULCORANTES SEGUROS]", F.col("safe_sweeteners")), section("[COMPONENTES DE BAIXO RISCO]", low), unknown]
    return reports.select("id", F.concat(head, *body).alias("text"))
