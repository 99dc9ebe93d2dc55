"""Lookup, filter, join and paging queries on the star schema's tables.

Products are parts (barcode: the key padded to 13 digits), users are customers, scans are events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators import history, lookup
from larder.operators import search as find
from larder.operators.trigram_index import TrigramIndex
from larder.plans.registry import query, table
from larder.streaming.operators import shared_folder


def products(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("barcode"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))


PRODUCTS = "(select lpad(cast(p_partkey as varchar), 13, '0') as barcode, p_name as name, p_brand as brand from part)"


@query("s01_scan", "select * from nation")
def s01(spark, d):
    return table(spark, d, "nation")


@query("s03_upload_checks", """select page_id, case when strlen(html) > 3000 then 413 when strlen(html) = 0 then 400
    when t is not null and t not in ('image/jpeg', 'image/jpg', 'image/png', 'image/webp', 'image/heic', 'image/heif') then 400 else 200 end as status
    from (select *, case page_id % 4 when 0 then 'image/png' when 1 then 'text/html' when 2 then 'image/heic' end as t from pages)""")
def s03(spark, d):
    kind = F.expr("case page_id % 4 when 0 then 'image/png' when 1 then 'text/html' when 2 then 'image/heic' end")
    return table(spark, d, "pages").select("page_id", lookup.upload_verdict(F.octet_length("html"), kind, 3000).alias("status"))


@query("p01_by_key", "select * from customer where c_custkey = 42")
def p01(spark, d):
    return lookup.by_key(table(spark, d, "customer"), c_custkey=42)


@query("p02_lowered_key", "select * from customer where lower(c_name) = lower('CUSTOMER#000000042')")
def p02(spark, d):
    return lookup.by_lowered(table(spark, d, "customer"), "c_name", "CUSTOMER#000000042")


@query("p03_owned_row", "select event_id, user_id, event_type from events where event_id = 7 and user_id = (select user_id from events where event_id = 7)")
def p03(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    owner = events.where("event_id = 7").select("user_id")
    return lookup.by_key(events, event_id=7).join(owner, "user_id", "left_semi").select("event_id", "user_id", "event_type")


PROFILES = """(select doc_id as barcode, nullif(lang, 'en') as kind, case when doc_id % 3 = 0 then null else source end as level, n_chars as summary from documents)"""


def profiles(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("barcode"), F.nullif("lang", F.lit("en")).alias("kind"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("level"), F.col("n_chars").alias("summary"))


@query("p04_nullable_key", f"select * from {PROFILES} where barcode is not distinct from 3 and kind is not distinct from null and level is not distinct from null")
def p04(spark, d):
    return lookup.by_nullable(profiles(spark, d), barcode=3, kind=None, level=None)


@query("p05_cache_state", """select o_orderkey, case when m.l is not null and m.l >= o_orderdate and m.v = 2 then 'fresh' when m.l is null then 'missing' else 'regenerate' end as state
    from orders left join (select l_orderkey, max(l_shipdate) as l, max(l_linenumber) % 3 as v from lineitem where l_quantity > 20 group by l_orderkey) m on l_orderkey = o_orderkey""")
def p05(spark, d):
    cached = table(spark, d, "lineitem").where("l_quantity > 20").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("l"), (F.max("l_linenumber") % 3).alias("v"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    joined = orders.join(cached, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.select("o_orderkey", lookup.cache_state(F.col("l"), F.col("o_orderdate"), F.col("v"), 2, True).alias("state"))


#: What a user might type to look for a part: nothing, a letter, two, three, its barcode, a longer number, its name.
TYPED = "case p_partkey % 7 when 0 then '  ' when 1 then concat(' ', substr(p_name, 1, 1), ' ') when 2 then substr(p_name, 1, 2) when 3 then substr(p_name, 1, 3) when 4 then lpad(cast(p_partkey as string), 13, '0') when 5 then cast(1000000 + p_partkey as string) else p_name end"


@query("p06_query_kinds", f"""select p_partkey, case when length(trim(q)) < 2 then 'empty' when regexp_full_match(trim(q), '[0-9]+') and length(trim(q)) in (8, 12, 13) then 'exact' when length(trim(q)) < 3 then 'contains' else 'fuzzy' end as kind
    from (select p_partkey, {TYPED.replace("as string", "as varchar")} as q from part)""")
def p06(spark, d):
    return table(spark, d, "part").select("p_partkey", find.kind(F.expr(TYPED)).alias("kind"))


@query("p06_exact_search", f"select *, cast(null as double) as similarity from {PRODUCTS} where barcode = '0000000000042' order by name, barcode limit 20")
def p06_exact(spark, d):
    return find.search(products(spark, d), "0000000000042")


@query("p07_contains", f"select *, cast(null as double) as similarity from {PRODUCTS} where lower(strip_accents(name || ' ' || brand)) like '%ró%' or lower(strip_accents(name || ' ' || brand)) like '%ro%'")
def p07(spark, d):
    return find.matches(products(spark, d), "ró")


def similarity_sql(first: str, second: str) -> str:
    """word_similarity in DuckDB's SQL, of two texts that are folded already."""
    grams = lambda x: f"flatten(list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"
    return f"""(select coalesce(max(len(list_intersect(run, a)) / (len(list_distinct(a)) + len(list_distinct(run)) - len(list_intersect(run, a)))), 0.0)
      from (select a, b[i:j] as run from (select {grams(first)} as a, {grams(second)} as b) g, unnest(range(1, len(b) + 1)) s(i), unnest(range(1, len(b) + 1)) e(j)
            where j >= i and list_contains(a, b[i]) and list_contains(a, b[j])))"""


FUZZY = f"""(select barcode, name, brand, {similarity_sql("'blue bolt'", 't')} as similarity, {similarity_sql('t', "'blue bolt'")} as reversed
    from (select *, lower(strip_accents(name || ' ' || brand)) as t from {PRODUCTS}))"""


_indexes: dict[tuple, TrigramIndex] = {}


def product_index(spark, d):
    """The index of a table's products, built once an application as long as the table's files stay as they are."""
    files = table(spark, d, "part").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    stamp = files.agg(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()[0]
    key = (spark.sparkContext.applicationId, d, stamp)
    if key not in _indexes:
        _indexes[key] = TrigramIndex.build(products(spark, d), f"{shared_folder(spark)}/trigrams")
    return _indexes[key]


@query("p08_fuzzy_filter", f"select barcode, name, brand, similarity from {FUZZY} where reversed >= 0.15")
def p08(spark, d):
    return find.matches(products(spark, d), "blue bolt", product_index(spark, d))


@query("o03_fuzzy_page", f"select barcode, name, brand, similarity from {FUZZY} where reversed >= 0.15 order by similarity desc, barcode limit 20 offset 20")
def o03(spark, d):
    return find.search(products(spark, d), "blue bolt", 2, index=product_index(spark, d))


@query("a01_total", f"select count(*) as total from {FUZZY} where reversed >= 0.15")
def a01(spark, d):
    return find.total(products(spark, d), "blue bolt", product_index(spark, d))


@query("f38_word_similarity", f"""select barcode, {similarity_sql("'red widget'", 't')} as forward, {similarity_sql('t', "'red widget'")} as backward
    from (select barcode, lower(strip_accents(name || ' ' || brand)) as t from {PRODUCTS})""")
def f38(spark, d):
    t = F.lower(T.unaccent(find.search_text("name", "brand")))
    q = F.lit("red widget")
    return products(spark, d).select("barcode", T.word_similarity(q, t).alias("forward"), T.word_similarity(t, q).alias("backward"))


@query("f06_sql_functions", f"""select barcode, trim(regexp_replace(regexp_replace(lower(strip_accents(t)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as folded, {similarity_sql("'red widget'", "u")} as similarity
    from (select barcode, 'Açúcar ' || name || ' ñ' as t, lower(strip_accents('Açúcar ' || name || ' ñ')) as u from {PRODUCTS})""")
def f06_sql(spark, d):
    """The text functions in a query that is written as SQL."""
    from larder.functions import sql

    sql.register(spark)
    told = "select barcode, larder_fold(t) as folded, larder_word_similarity('red widget', larder_unaccent_search(t)) as similarity from (select barcode, concat('Açúcar ', name, ' ñ') as t from {products})"
    return spark.sql(told, products=products(spark, d))


@query("o01_page_of_scans", "select event_id, ts, event_type from events where user_id = 8 order by ts desc, event_id limit 10 offset 10")
def o01(spark, d):
    mine = table(spark, d, "events").where("user_id = 8").select("event_id", "ts", "event_type")
    return find.page(mine, [F.desc("ts"), F.asc("event_id")], 2, 10)


@query("o02_page_by_name", f"select barcode, name, brand from {PRODUCTS} where name ilike '%ri%' order by name nulls last, barcode limit 20 offset 40")
def o02(spark, d):
    return find.page(products(spark, d).where(T.contains_folded(F.col("name"), "ri")), [F.asc_nulls_last("name"), F.asc("barcode")], 3, 20)


@query("p09_json_fields", "select event_id, props ->> '$.k' as k, props ->> '$.name' as name from events")
def p09(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.name").alias("name"))


@query("p10_page_envelope", f"select barcode, name, brand, 1 as page, 5 as page_size from {PRODUCTS} order by barcode limit 5")
def p10(spark, d):
    return find.page(products(spark, d), [F.asc("barcode")], 1, 5).select("barcode", "name", "brand", F.lit(1).alias("page"), F.lit(5).alias("page_size"))


@query("p11_payload", """select barcode, '{"cache_hit":false,"name":"' || name || '","brand":' || coalesce('"' || nullif(brand, 'Brand#1') || '"', 'null') || '}' as payload from """ + PRODUCTS)
def p11(spark, d):
    body = lookup.as_json(F.lit(False).alias("cache_hit"), "name", F.nullif("brand", F.lit("Brand#1")).alias("brand"))
    return products(spark, d).select("barcode", body.alias("payload"))


@query("s16_json_rows", """select '{"barcode":"' || barcode || '","name":"' || name || '","brand":' || coalesce('"' || nullif(brand, 'Brand#1') || '"', 'null') || '}' as value from """ + PRODUCTS)
def s16(spark, d):
    """Products as files of JSON objects, read back as lines."""
    folder = f"{shared_folder(spark)}/products"
    lookup.write_json(products(spark, d).withColumn("brand", F.nullif("brand", F.lit("Brand#1"))), folder)
    return spark.read.text(folder)


@query("p12_valid_tokens", """select event_id as jti, user_id as subject from events where event_type = 'view' and nullif(user_id, 8) is not null
    and event_id not in (select event_id from events where event_type = 'view' and value > 50)""")
def p12(spark, d):
    events = table(spark, d, "events")
    tokens = events.select(F.col("event_id").alias("jti"), F.nullif("user_id", F.lit(8)).alias("subject"), F.col("event_type").alias("kind"))
    revoked = events.where("event_type = 'view' and value > 50").select(F.col("event_id").alias("jti"))
    return lookup.valid_tokens(tokens, revoked, "view").select("jti", "subject")


@query("p15_refusals", """select turn, conv_id, coalesce(length(text) > 60 and position(',' in text) = 0, false) as one_phrase, text ilike '%voi%' or text ilike '%sorry%' as refusal from conversations""")
def p15(spark, d):
    one = (F.length("text") > 60) & ~F.contains("text", F.lit(","))
    return table(spark, d, "conversations").select("turn", "conv_id", F.coalesce(one, F.lit(False)).alias("one_phrase"), F.lower("text").rlike("voi|sorry").alias("refusal"))


@query("p16_length_check", "select c_custkey, length(c_mktsegment) >= 9 as valid from customer")
def p16(spark, d):
    return table(spark, d, "customer").select("c_custkey", (F.length("c_mktsegment") >= 9).alias("valid"))


@query("p17_category", """select p_partkey, coalesce(case when p_size = 1 then 'ingredient' end, case when p_size % 10 = 0 then 'text' end, case when p_size / 1000.0 >= 0.015 then 'table' else 'text' end) as category from part""")
def p17(spark, d):
    override, forced = F.expr("case when p_size = 1 then 'ingredient' end"), F.expr("case when p_size % 10 = 0 then 'text' end")
    return table(spark, d, "part").select("p_partkey", lookup.category(override, forced, F.col("p_size") / 1000.0).alias("category"))


@query("j01_left_child", "select o_orderkey, o_totalprice, c_name, c_mktsegment from orders left join customer on c_custkey = o_custkey and c_custkey % 2 = 0")
def j01(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("c_custkey"))
    return lookup.with_children(orders, table(spark, d, "customer").where("c_custkey % 2 = 0"), "c_custkey", "c_name", "c_mktsegment").drop("c_custkey")


@query("j02_two_children", "select p_partkey, p_name, s_name, n_name from part left join supplier on s_suppkey = p_partkey left join nation on n_nationkey = p_partkey")
def j02(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    once = lookup.with_children(part, table(spark, d, "supplier").withColumnRenamed("s_suppkey", "p_partkey"), "p_partkey", "s_name")
    return lookup.with_children(once, table(spark, d, "nation").withColumn("p_partkey", F.col("n_nationkey").cast("long")), "p_partkey", "n_name")


@query("j03_nested_children", """select o_orderkey, cast(count(l_linenumber) as integer) as n, coalesce(string_agg(l_linenumber || ':' || cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey), '') as children
    from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def j03(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    joined = lookup.nested(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", "l_linenumber", "l_partkey")
    each = F.transform("children", lambda c: F.concat(c["l_linenumber"].cast("string"), F.lit(":"), c["l_partkey"].cast("string")))
    return joined.select("o_orderkey", F.size("children").alias("n"), F.array_join(each, ",").alias("children"))


@query("j04_null_safe_join", f"""select a.barcode, a.summary, b.summary as other from {PROFILES} a left join (select * from {PROFILES} where barcode % 2 = 0) b
    on a.barcode = b.barcode and a.kind is not distinct from b.kind and a.level is not distinct from b.level""")
def j04(spark, d):
    a, b = profiles(spark, d).alias("a"), profiles(spark, d).where("barcode % 2 = 0").alias("b")
    on = (F.col("a.barcode") == F.col("b.barcode")) & F.col("a.kind").eqNullSafe(F.col("b.kind")) & F.col("a.level").eqNullSafe(F.col("b.level"))
    return a.join(b, on, "left").select("a.barcode", "a.summary", F.col("b.summary").alias("other"))


SUMMARIES = """(select l_partkey as barcode, nullif(l_returnflag, 'A') as kind, nullif(l_linestatus, 'F') as level, cast(max(l_orderkey) as varchar) as summary from lineitem where l_quantity > 30 group by 1, 2, 3)"""


@query("j05_personal_or_default", f"""select p.person, p.barcode, coalesce(o.summary, d.summary) as summary, case when o.summary is not null then p.kind end as kind, case when o.summary is not null then p.level end as level
    from (select o_orderkey as person, o_orderkey % 2000 as barcode, nullif(o_orderstatus, 'O') as kind, case when o_orderkey % 2 = 0 then 'O' end as level from orders) p
    left join {SUMMARIES} o on p.barcode = o.barcode and p.kind is not distinct from o.kind and p.level is not distinct from o.level
    left join (select * from {SUMMARIES} where kind is null and level is null) d on p.barcode = d.barcode""")
def j05(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 30")
    summaries = lines.groupBy(F.col("l_partkey").alias("barcode"), F.nullif("l_returnflag", F.lit("A")).alias("kind"), F.nullif("l_linestatus", F.lit("F")).alias("level")).agg(F.max("l_orderkey").cast("string").alias("summary"))
    people = table(spark, d, "orders").selectExpr("o_orderkey as person", "o_orderkey % 2000 as barcode", "nullif(o_orderstatus, 'O') as kind", "case when o_orderkey % 2 = 0 then 'O' end as level")
    return lookup.personal_or_default(people, summaries)


@query("j07_conflicts", "select s_suppkey, s_name from supplier where s_suppkey in (select c_custkey from customer where c_acctbal > 5000)")
def j07(spark, d):
    old = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("s_suppkey"))
    return history.conflicts(old, table(spark, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"])
