"""Nutrition text queries: lines written from order lines, with likely misreadings."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import layout
from larder.operators import nutrition as N
from larder.operators import requests
from larder.plans.registry import query, table

NAME = """case l_orderkey % 12 when 0 then 'Carboidratos' when 1 then 'Valor Energetico' when 2 then 'Sodio' when 3 then 'Proteina' when 4 then 'Gorduras Trans' when 5 then 'Fibra alimentar'
    when 6 then 'Acucares totais' when 7 then 'Gorduras satur' when 8 then 'INFORMACAO NUTRICIONAL POR PORCAO' when 9 then 'Gordurs totals' when 10 then 'Sadio' else 'Colesterol' end"""
QTY = "cast(cast(l_quantity as integer) as string)"
CELL = f"case l_partkey % 9 when 0 then {QTY} || ' g' when 1 then {QTY} || '9' when 2 then {QTY} || ',49' when 3 then 'l' || {QTY} || ' mg' when 4 then {QTY} || 'kcal = 1' || {QTY} || 'kJ' when 5 then '' when 6 then {QTY} when 7 then 'g' else 'S' || {QTY} end"
VD = f"case l_suppkey % 8 when 0 then '**' when 1 then cast(l_linenumber as string) when 2 then '' when 3 then '1,2' when 4 then '»' when 5 then '45272' when 6 then '2%' else 'abc' end"
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LINES = f"(select {KEY}, {NAME} as name, {CELL} as cell, {VD} as vd from lineitem)"


def lines(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{NAME} as name", f"{CELL} as cell", f"{VD} as vd")


def keyed(df, *columns):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *columns)


KEYS = ", ".join(f"('{k}', {i}, '{u}', '{s}')" for i, (k, u, s) in enumerate(N.NUTRIENTS))
NEAR = rf"""near as (select name, arg_min(k, dist * 100 + i) as nutrient, arg_min(u, dist * 100 + i) as unit, arg_min(s, dist * 100 + i) as display, min(dist) as distance from (
    select name, k, i, u, s, levenshtein(trim(regexp_replace(regexp_replace(lower(strip_accents(name)), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')), k) as dist from (select distinct name from ln), (values {KEYS}) t(k, i, u, s))
    group by name having min(dist) <= 6)"""


@query("f13_digits", f"select {KEY}, translate(cell, 'ÚúUOoQlIiSZsz', '0000001115522') as digits from {LINES}")
def f13(spark, d):
    return keyed(lines(spark, d), N.digits(F.col("cell")).alias("digits"))


@query("j12_nearest_nutrient", f"with ln as (select * from {LINES}), {NEAR} select {KEY}, nutrient, unit, distance from ln left join near using (name)")
def j12(spark, d):
    near = N.once(lines(spark, d), F.col("name"), N.nearest, "n")
    return keyed(near, N.key_of(F.col("n")).alias("nutrient"), N.unit_of(F.col("n")).alias("unit"), F.col("n.distance").alias("distance"))


SECOND = "case l_linenumber % 5 when 0 then 'saturadas' when 1 then 'trans' when 2 then 'totais' when 3 then 'energetico' else 'mg' end"


@query("j13_one_or_two_columns", f"""with p as (select *, {SECOND} as b, name || ' ' || {SECOND} as pair from {LINES}), ln as (select name from p union select pair as name from p), {NEAR}
    select {KEY}, b, coalesce(t.distance < coalesce(o.distance, 999), false) as merged, case when t.distance < coalesce(o.distance, 999) then t.nutrient else o.nutrient end as nutrient
    from p left join near o on o.name = p.name left join near t on t.name = p.pair""")
def j13(spark, d):
    named = lines(spark, d).withColumn("b", F.expr(SECOND))
    both = N.once(N.once(named, F.col("name"), N.nearest, "one"), F.concat_ws(" ", "name", "b"), N.nearest, "two")
    merged = F.coalesce(F.col("two.distance") < F.coalesce("one.distance", F.lit(999)), F.lit(False))
    return keyed(both, "b", merged.alias("merged"), F.when(merged, N.key_of(F.col("two"))).otherwise(N.key_of(F.col("one"))).alias("nutrient"))


@query("f17_nine_for_g", f"""select {KEY}, regexp_full_match(cell, '[0-9]+9') and try_cast(cell as bigint) >= 100 as confused from (select * from {LINES})""")
def f17(spark, d):
    return keyed(lines(spark, d), N.nine_for_g(F.col("cell"), F.lit("g")).alias("confused"))


@query("f18_daily_value", f"""select {KEY}, case when t = '' then null when regexp_matches(t, '[*''»«]') then '**' when contains(r, ',') then null when regexp_matches(r, '[0-9]') then regexp_extract(r, '[0-9]{{1,3}}') else '**' end as fixed
    from (select *, trim(vd) as t, translate(trim(vd), 'ÚúUOoQlIiSZsz', '0000001115522') as r from {LINES})""")
def f18(spark, d):
    return keyed(lines(spark, d), N.daily_value(F.col("vd")).alias("fixed"))


@query("f21_symbols", f"""select {KEY}, trim(regexp_replace(replace(replace(replace(replace(replace(cell || 'k]  AVD() ' || vd || ' WVD()', 'k]', 'kJ'), 'k|', 'kJ'), 'k)', 'kJ'), 'AVD()', '%VD(*)'), 'WVD()', '%VD(*)'), '\\s+', ' ', 'g')) as line from {LINES}""")
def f21(spark, d):
    return keyed(lines(spark, d), N.symbols(F.expr("cell || 'k]  AVD() ' || vd || ' WVD()'")).alias("line"))


@query("f22_labels", f"""select {KEY}, trim(regexp_extract(name || ' ' || cell, '^\\s*([A-Za-zÀ-ÿ\\s]+)', 1)) as label, case when regexp_matches(vd, '\\*') then '**' when regexp_matches(vd, '[0-9]') then regexp_extract(vd, '[0-9]{{1,2}}') end as vd from {LINES}""")
def f22(spark, d):
    return keyed(lines(spark, d), N.label_of(F.expr("name || ' ' || cell")).alias("label"), N.daily_token(F.col("vd")).alias("vd"))


@query("f23_collisions", f"""select {KEY}, case when regexp_full_match(cell, '[0-9]+[.,][0-9]9') then cell[:-2] when h and not regexp_matches(cell, '[.,]') and ends_with(cell, '9') and length(cell) >= 2 then cell[:-2]
    when not h and regexp_full_match(cell, '[0-9]+9') and cast(cell as bigint) >= 100 then cell[:-2] end as fixed from (select *, l_suppkey % 2 = 0 as h from {LINES})""")
def f23(spark, d):
    return keyed(lines(spark, d), N.collision(F.col("cell"), F.lit("g"), F.expr("l_suppkey % 2 = 0")).alias("fixed"))


@query("f25_cloud_lines", f"""with ln as (select * from {LINES}), {NEAR},
    pairs as (select *, name || ' ' || cell as pair from ln), two as (select name as pair, nutrient, display, distance from (with ln as (select distinct pair as name from pairs), {NEAR} select * from near)),
    c as (select p.*, o.display as d1, o.distance as n1, t.display as d2, t.distance as n2 from pairs p left join near o using (name) left join two t using (pair)),
    m as (select *, coalesce(n2 < coalesce(n1, 999), false) as merged from c)
    select {KEY}, case when merged then d2 else coalesce(d1, name) end || case when merged then '' else chr(9) || trim(cell) end
      || case when regexp_matches(vd, '[*''"»«]') then chr(9) || '**' when regexp_full_match(vd, '[0-9]{{4,}}') then '' else chr(9) || vd end as line from m""")
def f25(spark, d):
    return keyed(N.once(lines(spark, d), F.expr("concat(name, '\\t', cell, '\\t', vd)"), N.cloud_line, "line"), "line")


@query("f09_rows", f"""select {KEY}, name as nutrient, array_to_string(list_filter([trim(cell), trim(vd)], lambda x: x <> ''), '|') as vals from {LINES} where regexp_matches(cell || vd, '[0-9]')""")
def f09(spark, d):
    parsed = keyed(lines(spark, d), F.explode(N.rows(F.expr("concat('INFORMACAO\\n', name, '\\t', cell, '\\t', vd, '\\n')"))).alias("r"))
    return keyed(parsed, F.col("r.nutrient").alias("nutrient"), F.array_join("r.values", "|").alias("vals"))


@query("p14_rows_with_digits", f"select {KEY} from {LINES} where regexp_matches(cell, '[0-9]')")
def p14(spark, d):
    return keyed(lines(spark, d).where(F.size(N.rows(F.expr("concat(name, '\\t', cell)"))) > 0))


@query("a19_columns", f"""select {KEY}, case when n >= 2 then 2 when n = 1 then 1 end as columns from (select *, case when regexp_matches(cell || vd, '[0-9]') then (case when trim(cell) <> '' then 1 else 0 end) + (case when trim(vd) <> '' then 1 else 0 end) end as n from {LINES})""")
def a19(spark, d):
    c = N.columns(N.rows(F.expr("concat(name, '\\t', cell, '\\t', vd)")))
    return keyed(lines(spark, d), F.when(c.isNotNull(), F.size(c)).alias("columns"))


@query("f36_serialized", f"""select {KEY}, name || ': ' || array_to_string(list_filter([trim(cell), trim(vd)], lambda x: x <> ''), ' | ') as body from {LINES} where regexp_matches(cell || vd, '[0-9]')""")
def f36(spark, d):
    parsed = keyed(lines(spark, d), N.rows(F.expr("concat(name, '\\t', cell, '\\t', vd)")).alias("r")).where(F.size("r") > 0)
    return keyed(parsed, N.serialized(F.col("r")).alias("body"))


@query("f14_postprocess")
def f14(spark, d):
    """Tabular and linear lines (F-14 to F-16, F-19, F-20); the state machine is compared with a plain version in tests."""
    text = F.expr("concat(name, '\\t', cell, '\\t', vd, '\\n', name, ' ', cell, ' ', vd)")
    return keyed(N.postprocessed(lines(spark, d).withColumn("raw", text), "raw", "text"), "text")


@query("f08_items", """select conv_id, turn, len(p) as n, array_to_string(p, '#') as items from (select conv_id, turn, list_filter(list_transform(case when regexp_matches(t, '[,;]') then regexp_split_to_array(t, '[,;]') else regexp_split_to_array(t, '[\\r\\n]+') end,
    lambda x: regexp_replace(x, '^[ \\t\\-•·.]+|[ \\t\\-•·.]+$', '', 'g')), lambda x: length(x) >= 2 and not regexp_full_match(x, '[0-9]+')) as p from (select conv_id, turn, trim(text, E' \\n\\t\\r') as t from conversations))""")
def f08(spark, d):
    from larder.functions.text import split_items

    items = split_items(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", items.alias("p")).select("conv_id", "turn", F.size("p").alias("n"), F.array_join("p", "#").alias("items"))


@query("f39_canonical_list", """select conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> ''), '#') as items from conversations""")
def f39(spark, d):
    from larder.functions.text import canonical_list

    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(canonical_list(F.col("text")), "#").alias("items"))


FOLDED = r"trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9\s]', '{0}', 'g'), '\s+', ' ', 'g'))"


def fold_query(name, function, sql):
    from larder.functions import text as T

    @query(name, f"select conv_id, turn, {sql} as folded from conversations")
    def run(spark, d):
        return table(spark, d, "conversations").select("conv_id", "turn", getattr(T, function)(F.col("text")).alias("folded"))


fold_query("f01_fold", "fold", FOLDED.format(" "))
fold_query("f02_fold_deleting", "fold_deleting", FOLDED.format(""))
fold_query("f03_fold_letters", "fold_letters", "regexp_replace(lower(strip_accents(text)), '[^a-z]', '', 'g')")
fold_query("f04_fold_metric", "fold_metric", r"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '(\d)\s+(mcg|mg|ml|g|kcal|kj|ui|iu)\b', '\1\2', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))")
fold_query("f05_fold_label", "fold_label", "regexp_replace(lower(text), '[^a-z0-9]', '', 'g')")
fold_query("f06_unaccent", "unaccent", "strip_accents(text)")
fold_query("f40_truncated", "truncated", "substr(text, 1, 500)")


@query("f07_levenshtein", """select a.p_partkey, levenshtein(a.p_name, b.p_name) as distance from part a join part b on b.p_partkey = a.p_partkey + 1""")
def f07(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return part.join(other, "p_partkey").select("p_partkey", F.levenshtein("p_name", "other").alias("distance"))


@query("f24_bounded_first", """select p_partkey, w, position(w in n) > 0 and (position(w in n) = 1 or substr(n, position(w in n) - 1, 1) = ' ') and (position(w in n) + length(w) > length(n) or substr(n, position(w in n) + length(w), 1) = ' ') as bounded
    from (select p_partkey, 'x' || p_name || ' ' || p_name as n from part), (values ('old'), ('ring'), ('hot'), ('cold ring')) t(w)""")
def f24(spark, d):
    from larder.functions.text import bounded_first

    part = table(spark, d, "part").select("p_partkey", F.concat(F.lit("x"), "p_name", F.lit(" "), "p_name").alias("n"), F.explode(F.array(*[F.lit(w) for w in ("old", "ring", "hot", "cold ring")])).alias("w"))
    return part.select("p_partkey", "w", bounded_first(F.col("n"), F.col("w")).alias("bounded"))


@query("f28_sha256", "select p_partkey, sha256(p_name) as digest from part")
def f28(spark, d):
    return table(spark, d, "part").select("p_partkey", F.sha2(F.col("p_name").cast("binary"), 256).alias("digest"))


@query("f41_clamped_crop", """select l_orderkey, l_linenumber, l_partkey, greatest(cast(l_quantity as integer) - 10, 0) as x1, least(cast(l_quantity as integer) + l_linenumber + 10, 50) as x2 from lineitem""")
def f41(spark, d):
    x1, x2 = layout.clamped(F.col("l_quantity").cast("int"), F.col("l_quantity").cast("int") + F.col("l_linenumber"), F.lit(10), F.lit(50))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x1.alias("x1"), x2.alias("x2"))


@query("f42_resize_limit", """select l_orderkey, l_linenumber, l_partkey, case when m > 1500 then cast(trunc(w * 1500.0 / m) as integer) else w end as width, case when m > 1500 then cast(trunc(h * 1500.0 / m) as integer) else h end as height
    from (select *, greatest(w, h) as m from (select *, cast(l_quantity as integer) * 100 as w, l_linenumber * 400 as h from lineitem))""")
def f42(spark, d):
    sized = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "cast(l_quantity as int) * 100 as w", "l_linenumber * 400 as h")
    width, height = layout.fitted(F.col("w"), F.col("h"))
    return sized.select("l_orderkey", "l_linenumber", "l_partkey", width.alias("width"), height.alias("height"))


ASKED = """(select event_id, user_id, upper(event_type) as method, '/' || coalesce(props ->> '$.k', '') as path, case when event_id % 11 = 0 then 500 when event_id % 5 = 0 then 404 when event_id % 3 = 0 then 201 else 200 end as status, value from events)"""


def asked(spark, d):
    """Requests: an event's value is how many milliseconds its answer took."""
    e = table(spark, d, "events").withColumn("began", F.col("ts").cast("timestamp"))
    ended = F.timestamp_micros(F.unix_micros("began") + F.round(F.col("value") * 1000).cast("long"))
    status = F.expr("case when event_id % 11 = 0 then 500 when event_id % 5 = 0 then 404 when event_id % 3 = 0 then 201 else 200 end")
    path = F.concat(F.lit("/"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")))
    return requests.logged(e.select(F.col("event_id").cast("string").alias("request_id"), F.upper("event_type").alias("method"), path.alias("path"), status.alias("status"), "began", ended.alias("ended")))


@query("f44_request_fields", f"""select method, path, status, event_id as request_id, cast(case when ms < 0 then 0 else round(ms, 1) end as double) as duration_ms, concat('method=', method, ' path=', path, ' status=', status, ' duration_ms=', printf('%.1f', round(case when ms < 0 then 0 else ms end, 1)), ' request_id=', event_id) as line
    from (select * replace (cast(event_id as varchar) as event_id), round(value * 1000) / 1000 as ms from {ASKED})""")
def f44(spark, d):
    return asked(spark, d).select("method", "path", "status", "request_id", "duration_ms", "line")


@query("f44_request_summary", f"""select method, status // 100 as class, count(*) as requests, max(ms) as slowest, quantile_disc(ms, 0.5) as median, quantile_disc(ms, 0.95) as p95, count(case when ms >= 50 then 1 end) as slow
    from (select *, cast(round(greatest(0, round(value * 1000) / 1000), 1) as double) as ms from {ASKED}) group by 1, 2""")
def f44_summary(spark, d):
    """Requests by method and class of status: how many, how many took long, and how long they took."""
    return requests.summary(asked(spark, d), 50.0)


ENERGY = "'Valor Energetico ' || cell || case l_linenumber % 4 when 0 then ' kcal = 1' || l_suppkey || ' k) ' || l_linenumber when 1 then ' kcal 2' || l_suppkey || 'k j' when 2 then ' KCAL=' || l_suppkey || 'kJ 12' else ' kJ' end"
REPAIRED = r"regexp_replace(regexp_replace({0}, '\bk\s*[\)\]\|]?\b', 'kJ', 'gi'), 'k\s?j', 'kJ', 'gi')"
SHAPE = r"(?i)([0-9]+[\.,]?[0-9]*)\s*kcal\s*=?\s*([0-9]+[\.,]?[0-9]*)\s*kJ\s*([0-9]{1,2})?"
ENERGY_SQL = f"case when regexp_matches(r, '{SHAPE}') then 'Valor Energético ' || regexp_extract(r, '{SHAPE}', 1) || 'kcal=' || regexp_extract(r, '{SHAPE}', 2) || 'kJ' || case when regexp_extract(r, '{SHAPE}', 3) <> '' then ' ' || regexp_extract(r, '{SHAPE}', 3) else '' end else r end"


@query("f20_energy_lines", f"select {KEY}, {ENERGY_SQL} as line from (select *, {REPAIRED.format(ENERGY)} as r from {LINES})")
def f20(spark, d):
    return keyed(lines(spark, d), N.energy_line(F.expr(ENERGY)).alias("line"))


LINEAR = r"^\s*([A-Za-zÀ-ÿ\s]+?)\s+([0-9.,]+)\s*([A-Za-z%*()]+)?\s*([0-9.,*]+)?\s*$"


@query("f19_linear_lines", rf"""with x as (select {KEY}, trim(regexp_replace(name || ' ' || cell || ' ' || vd, '\s+', ' ', 'g')) as x from {LINES}),
    lab as (select *, trim(regexp_extract(x, '^\s*([A-Za-zÀ-ÿ\s]+)', 1)) as name from x), ln as (select name from lab where name <> ''), {NEAR},
    p as (select lab.*, nutrient, unit, display, regexp_extract(x, '{LINEAR}', 2) as v, regexp_extract(x, '{LINEAR}', 4) as t, {REPAIRED.format('x')} as r from lab left join near using (name)),
    w as (select *, case when regexp_matches(t, '\*') then '**' when regexp_matches(t, '[0-9]') then regexp_extract(t, '[0-9]{{1,2}}') end as d from p),
    f as (select *, case when unit <> 'g' then v when regexp_full_match(v, '[0-9]+[.,][0-9]9') then v[:-2] when d is not null and not regexp_matches(v, '[.,]') and ends_with(v, '9') and length(v) >= 2 then v[:-2]
      when d is null and regexp_full_match(v, '[0-9]+9') and cast(v as bigint) >= 100 then v[:-2] else v end as fixed from w)
    select {KEY}, case when nutrient is null then x when nutrient = 'valor energetico' then {ENERGY_SQL} when regexp_matches(x, '{LINEAR}') then concat_ws(' ', display, fixed, unit, d) else x end as line from f""")
def f19(spark, d):
    return keyed(N.once(lines(spark, d), F.expr("concat(name, ' ', cell, ' ', vd)"), N.linear_line, "line"), "line")


@query("f16_quantities")
def f16(spark, d):
    """Quantity and daily value of cells, by the state machine; compared with a plain version in tests."""
    named = N.once(lines(spark, d), F.col("name"), N.nearest, "n")
    q = N.quantity(F.array("cell", "vd"), N.unit_of(F.col("n")))
    return keyed(named.withColumn("q", q), F.col("q.quantity").alias("quantity"), F.col("q.vd").alias("vd"))


@query("f15_tabular_lines")
def f15(spark, d):
    return keyed(N.once(lines(spark, d), F.expr("concat(name, '\\t', cell, '\\t', vd)"), N.tabular_line, "line"), "line")
