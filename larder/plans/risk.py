"""Ingredient queries: an invented ontology over the words of part names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from larder.operators import ingredients as I
from larder.plans.registry import query, table

#: entry, display, class, risk, glycemic index, synonyms
ONTOLOGY = [
    (0, "Widget", "acucar", "ALTO", "65", ["red widget", "widgét"]),
    (1, "Blue Bolt", "acucar", "MODERADO-ALTO", "55-65", ["bolt"]),
    (2, "Gear", "farinha", "MODERADO", None, ["gears box", "cold gear"]),
    (3, "Anvil", "fibra", "BAIXO", "", ["large anvil"]),
    (4, "Ring", "edulcorante_natural", "SEGURO", "N/A", ["small ring", "gear"]),
    (5, "Rod", "fibra", "BENEFICO", "10", []),
    (6, "Plate", "outro", "INFORMATIVO", None, ["hot plate tray"]),
    (7, "Gizmo", "edulcorante_artificial", "BAIXO", None, ["rod"]),
    (8, "Old Spring", "outro", "DESCONHECIDO", None, ["economy"]),
    (9, "Standard Flour", "farinha", "MODERADO", "70", ["standards"]),
    (10, "Promotion", "outro", "INFORMATIVO", None, ["promos"]),
]


def ontology(spark):
    """From an Arrow table, so that its size is known when a query is planned: it is broadcast, rows aren't dealt out by its few entries."""
    columns = {"entry": pa.int32(), "display": pa.string(), "class": pa.string(), "risk": pa.string(), "gi": pa.string(), "synonyms": pa.list_(pa.string())}
    rows = pa.table([pa.array(values, kind) for values, kind in zip(zip(*ONTOLOGY), columns.values())], names=list(columns))
    return spark.createDataFrame(rows).withColumn("gi", F.when(~F.col("gi").isin("", "N/A"), F.col("gi")))


TEXT = "p_name || ', ' || lower(p_type) || ' ' || split(p_name, ' ')[{i}] || 's; INS ' || (300 + p_size) || ', (' || p_brand || ') ' || reverse(split(p_name, ' ')[{j}]) || '. NOTA DE TESTE: xx ' || split(p_name, ' ')[{j}] || ' yy, new| bol, ' || split(p_name, ' ')[{i}]"
SPARK_TEXT, DUCK_TEXT = TEXT.format(i=0, j=1), TEXT.format(i=1, j=2)
FOLD = r"trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"

TOKENS = rf"""cleaned as (select p_partkey as id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({DUCK_TEXT}, '\(?\b(?:INS|INA|E|ADT)\s*\d{{3}}[a-z]?\b\)?', '', 'gi'), '\([^)]{{1,60}}\)', '', 'g'), '[*†‡§¶#@|]', '', 'g'), '[A-ZÁÉÍÓÚÀÂÊÔÃÕ\s]{{4,}}:', ' ', 'g') as t from part),
    parts as (select id, unnest(range(0, len(p))) as pos, unnest(p) as o from (select id, regexp_split_to_array(t, '[,;.]') as p from cleaned)),
    toks as (select id, pos, trim(o) as original, {FOLD.format('o')} as normalized from parts where trim(o) <> '' and length({FOLD.format('o')}) >= 3)"""
LISTED = ", ".join(f"({e}, '{n}', '{c}', '{r}', {len(s)}, {s or ['']})" for e, n, c, r, _, s in ONTOLOGY)
INDEX = f"""onto(entry, display, class, risk, ns, syn) as (values {LISTED}),
    names as (select entry, 0 as nth, {FOLD.format('display')} as key from onto union all select entry, nth, {FOLD.format('name')} from (select entry, unnest(range(1, ns + 1)) as nth, unnest(syn) as name from onto where ns > 0)),
    idx as (select key, min(entry * 1000 + nth) as ordinal, coalesce(max(case when nth = 0 then entry end), min(case when nth > 0 then entry * 1000 + nth end) // 1000) as entry from names group by key)"""
BOUND = "(position({k} in {t}) > 0 and (position({k} in {t}) = 1 or substr({t}, position({k} in {t}) - 1, 1) = ' ') and (position({k} in {t}) + length({k}) > length({t}) or substr({t}, position({k} in {t}) + length({k}), 1) = ' '))"


def layers(name: str, asked: str) -> str:
    inside = f"({BOUND.format(k='key', t='n')} or (length(n) >= 5 and {BOUND.format(k='n', t='key')}))"
    return f"""{name}_e as (select n, i.entry, 'exact' as kind, 0 as distance from {asked} join idx i on n = key),
    {name}_p as (select n, entry, ordinal, case when {inside} then 'containment' else 'levenshtein' end as kind, case when {inside} then abs(length(key) - length(n)) else levenshtein(n, key) end as distance
        from (select n from {asked} where n not in (select n from {name}_e)) join idx on {inside} or levenshtein(n, key) <= greatest(1, least(3, length(key) // 6))),
    {name} as (select * from {name}_e union all select n, entry, kind, distance from (select *, row_number() over (partition by n order by distance, ordinal) as r from {name}_p) where r = 1)"""


RANK = "coalesce(nullif(list_position(['ALTO', 'MODERADO-ALTO', 'MODERADO', 'BAIXO', 'SEGURO', 'BENEFICO', 'INFORMATIVO'], risk), 0) - 1, 99)"
MATCH = f"""with {TOKENS}, {INDEX}, asked as (select distinct normalized as n from toks), {layers('whole', 'asked')},
    words as (select tok, nth, n from (select n as tok, unnest(range(0, len(w))) as nth, unnest(w) as n from (select n, string_split(n, ' ') as w from asked where n not in (select n from whole) and contains(n, ' '))) where length(n) >= 3),
    single as (select distinct n from words), {layers('part1', 'single')},
    worst as (select tok as n, entry from (select tok, p.entry, row_number() over (partition by tok order by {RANK}, nth) as r from words join part1 p using (n) join onto o on o.entry = p.entry) where r = 1),
    every as (select * from whole union all select n, entry, 'word_decomposition', 0 from worst),
    matched as (select id, cast(pos as integer) as pos, original, normalized, entry, coalesce(kind, 'none') as kind, cast(coalesce(distance, -1) as integer) as distance from toks left join every on n = normalized),
    dedup as (select id, d.entry, pos, original, kind, distance, display, class, risk, {RANK} as rank from (select *, row_number() over (partition by id, entry order by pos) as r from matched where entry is not null) d join onto o on o.entry = d.entry where r = 1)"""


def toks(spark, d):
    # a row of a few bytes becomes a text that is cleaned, cut and folded: as many tasks as a shuffle has, however few the file's parts are
    spread = table(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("p_partkey"))
    return I.tokens(spread.withColumn("text", F.expr(SPARK_TEXT)), "p_partkey", "text")


def matches(spark, d):
    return I.match(toks(spark, d), ontology(spark))


@query("f10_tokens", f"with {TOKENS} select id, cast(pos as integer) as pos, original, normalized from toks")
def f10(spark, d):
    return toks(spark, d)


@query("s09_ontology_index", f"""with names as (select p_partkey as entry, 0 as nth, {FOLD.format('p_name')} as key from part
      union all select p_partkey, 1, {FOLD.format('p_brand')} from part union all select p_partkey, 2, {FOLD.format("string_split(p_name, ' ')[1]")} from part)
    select key, min(entry * 1000 + nth) as ordinal, coalesce(max(case when nth = 0 then entry end), min(case when nth > 0 then entry * 1000 + nth end) // 1000) as entry from names group by key""")
def s09(spark, d):
    """The index of an ontology of parts: names, and as synonyms brands and first words, which many parts share."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("entry"), F.col("p_name").alias("display"), F.array("p_brand", F.split("p_name", " ")[0]).alias("synonyms"))
    return I.index(part)


@query("j08_ontology_match", f"{MATCH} select * from matched")
def j08(spark, d):
    return matches(spark, d)


@query("j09_containment", f"{MATCH} select normalized, entry, distance from matched where kind = 'containment' group by all")
def j09(spark, d):
    return matches(spark, d).where("kind = 'containment'").select("normalized", "entry", "distance").distinct()


@query("j10_edit_distance", f"{MATCH} select normalized, entry, distance from matched where kind = 'levenshtein' group by all")
def j10(spark, d):
    return matches(spark, d).where("kind = 'levenshtein'").select("normalized", "entry", "distance").distinct()


@query("j11_decomposition", f"{MATCH} select normalized, entry from matched where kind = 'word_decomposition' group by all")
def j11(spark, d):
    return matches(spark, d).where("kind = 'word_decomposition'").select("normalized", "entry").distinct()


@query("a04_first_of_each_entry", f"{MATCH} select id, entry, pos, original, risk from dedup")
def a04(spark, d):
    return I.deduplicated(matches(spark, d), ontology(spark)).select("id", "entry", "pos", "original", "risk")


@query("a02_risk_summary", f"{MATCH} select id, risk, count(*) as n from dedup group by all")
def a02(spark, d):
    return I.risk_summary(I.deduplicated(matches(spark, d), ontology(spark)))


REPORT = f"""{MATCH}, al as (select id, arg_min(risk, rank * 1000 + pos) as worst, string_agg(original || '/' || kind, ';' order by rank, pos) as alerts,
    coalesce(string_agg(case when risk in ('ALTO', 'MODERADO-ALTO') then original end, ';' order by rank, pos), '') as high_risk,
    coalesce(string_agg(case when class in ('edulcorante_artificial', 'edulcorante_natural') and risk in ('BAIXO', 'SEGURO') then original end, ';' order by rank, pos), '') as safe_sweeteners from dedup group by id),
    un as (select id, count(*) as tokens, coalesce(string_agg(case when entry is null then original end, ';' order by pos), '') as unmatched from matched group by id)"""


@query("a03_worst_risk", f"{REPORT} select un.id, tokens, coalesce(worst, 'NENHUM') as worst from un left join al using (id)")
def a03(spark, d):
    return I.report(matches(spark, d), ontology(spark)).select("id", "tokens", "worst")


@query("a05_report_lists", f"{REPORT} select id, coalesce(alerts, '') as alerts, coalesce(high_risk, '') as high_risk, coalesce(safe_sweeteners, '') as safe_sweeteners, unmatched from un left join al using (id)")
def a05(spark, d):
    r = I.report(matches(spark, d), ontology(spark))
    shown = F.array_join(F.transform("alerts", lambda a: F.concat(a["original"], F.lit("/"), a["kind"])), ";")
    return r.select("id", shown.alias("alerts"), *[F.array_join(c, ";").alias(c) for c in ("high_risk", "safe_sweeteners", "unmatched")])


@query("o05_alerts_by_risk", f"{MATCH} select id, row_number() over (partition by id order by rank, pos) as place, original, risk from dedup")
def o05(spark, d):
    r = I.report(matches(spark, d), ontology(spark)).select("id", F.posexplode("alerts").alias("place", "a"))
    return r.select("id", (F.col("place") + 1).alias("place"), "a.original", "a.risk")


@query("p23_sublists", f"{MATCH} select id, original, case when risk in ('ALTO', 'MODERADO-ALTO') then 'high' else 'sweetener' end as list from dedup where risk in ('ALTO', 'MODERADO-ALTO') or (class in ('edulcorante_artificial', 'edulcorante_natural') and risk in ('BAIXO', 'SEGURO'))")
def p23(spark, d):
    r = I.report(matches(spark, d), ontology(spark))
    named = lambda c, name: F.transform(c, lambda x: F.struct(x.alias("original"), F.lit(name).alias("list")))
    both = r.select("id", F.concat(named("high_risk", "high"), named("safe_sweeteners", "sweetener")).alias("both"))
    return both.select("id", F.explode("both").alias("x")).select("id", "x.original", "x.list")


@query("o11_first_unmatched", f"""{MATCH}, u as (select id, original, row_number() over (partition by id order by pos) as r, count(*) over (partition by id) as n from matched where entry is null)
    select id, string_agg(original, ', ' order by r) || case when max(n) > 1 then ' ...' else '' end as line from u where r <= 1 group by id""")
def o11(spark, d):
    r = I.report(matches(spark, d), ontology(spark)).where(F.size("unmatched") > 0)
    return r.select("id", I.unmatched_line(F.col("unmatched"), 1).alias("line"))


@query("o10_worst_overall", f"{MATCH} select risk, count(*) as n from dedup group by risk order by min(rank), risk limit 1")
def o10(spark, d):
    found = I.deduplicated(matches(spark, d), ontology(spark))
    return found.groupBy("risk").agg(F.count(F.lit(1)).alias("n")).orderBy(I.risk_rank(F.col("risk")), "risk").limit(1)


BULLETS = "string_agg(case when {0} then chr(10) || '  - ' || {1} end, '' order by rank, pos)"
NAMED = "original || ' (' || class || ')'"


@query("f29_text_report", f"""{MATCH}, al as (select id, count(*) as n, arg_min(risk, rank * 1000 + pos) as worst, {BULLETS.format("risk in ('ALTO', 'MODERADO-ALTO')", 'original')} as high, {BULLETS.format("risk = 'MODERADO'", NAMED)} as middle,
        {BULLETS.format("class in ('edulcorante_artificial', 'edulcorante_natural') and risk in ('BAIXO', 'SEGURO')", 'original')} as sweet,
        {BULLETS.format("risk in ('BENEFICO', 'BAIXO') and class not in ('edulcorante_artificial', 'edulcorante_natural', 'poliol')", NAMED)} as low from dedup group by id),
    un as (select id, count(*) as tokens, coalesce(list(original order by pos) filter (where entry is null), []) as u from matched group by id)
    select un.id, '=== ANALISE DE INGREDIENTES — DIABETES MELLITUS ===' || chr(10) || 'Imagem: ' || un.id || chr(10) || 'Risco global: ' || coalesce(worst, 'NENHUM') || chr(10)
        || 'Tokens extraidos: ' || tokens || ' | Identificados: ' || coalesce(n, 0) || ' | Nao classificados: ' || len(u)
        || coalesce(chr(10) || chr(10) || '[ALTO RISCO]' || high, '') || coalesce(chr(10) || chr(10) || '--- Moderado ---' || middle, '') || coalesce(chr(10) || chr(10) || '[EDULCORANTES SEGUROS]' || sweet, '') || coalesce(chr(10) || chr(10) || '[COMPONENTES DE BAIXO RISCO]' || low, '')
        || case when len(u) > 0 then chr(10) || chr(10) || 'Nao classificados (' || len(u) || '): ' || array_to_string(u[1:10], ', ') || case when len(u) > 10 then ' ...' else '' end else '' end as text from un left join al using (id)""")
def f29(spark, d):
    return I.text_report(I.report(matches(spark, d), ontology(spark)))


@query("f12_segmentation")
def f12(spark, d):
    """Part names without their space, cut by a vocabulary of their words and frequencies."""
    part = table(spark, d, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    joined = part.select("p_partkey", F.concat(F.regexp_replace("p_name", " ", ""), F.lit("box")).alias("text"))
    return I.tokens(joined, "p_partkey", "text", words)


@query("f11_normalized_words", f"with {TOKENS} select original, min(normalized) as normalized from toks group by original")
def f11(spark, d):
    return toks(spark, d).groupBy("original").agg(F.min("normalized").alias("normalized"))


@query("f31_alerts", f"{MATCH} select id, original, display, class, risk, kind, distance from dedup")
def f31(spark, d):
    r = I.report(matches(spark, d), ontology(spark)).select("id", F.explode("alerts").alias("a"))
    return r.select("id", "a.original", "a.display", "a.class", "a.risk", "a.kind", "a.distance")


@query("f30_contract", f"""{REPORT} select un.id, '{{"risco_global":"' || coalesce(worst, 'NENHUM') || '","identificados":' || (select count(*) from dedup x where x.id = un.id) || '}}' as body from un left join al using (id)""")
def f30(spark, d):
    r = I.report(matches(spark, d), ontology(spark))
    return r.select("id", F.to_json(F.struct(F.col("worst").alias("risco_global"), F.size("alerts").alias("identificados"))).alias("body"))
