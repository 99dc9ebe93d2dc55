"""Queries over snapshots and their changes, windows and limits, on customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import history
from larder.plans.registry import query, table

EVENT = ["event_id", "ts", "user_id", "event_type", "value"]


def events(spark, d):
    return table(spark, d, "events").select(*EVENT)


@query("w01_latest_per_key", """select event_id, ts, user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1""")
def w01(spark, d):
    return history.latest(events(spark, d), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


@query("w07_demand", """select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts) range between 7200000000 preceding and current row) as demand from events""")
def w07(spark, d):
    return history.demand(events(spark, d), "user_id", "ts", 7200).select("event_id", "user_id", "demand")


@query("t03_window_limit", """select user_id, time_bucket(interval '1 day', ts) as window_start, count(*) as requests, count(*) > 3 as limited from events group by 1, 2""")
def t03(spark, d):
    return history.over_limit(events(spark, d), "user_id", "ts", 3, "1 day").withColumn("window_start", F.to_timestamp_ntz(F.col("window_start").cast("string")))


@query("t04_cache_hits", """select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by ts, event_id) > 1 as cache_hit from events""")
def t04(spark, d):
    return history.first_seen(events(spark, d), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).select("event_id", "user_id", "event_type", "cache_hit")


@query("t06_first_warning", """select event_id, user_id, ts from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events where event_type = 'error') where r = 1""")
def t06(spark, d):
    return history.latest(events(spark, d).where("event_type = 'error'"), ["user_id"], [F.asc("ts"), F.asc("event_id")]).select("event_id", "user_id", "ts")


@query("t05_stale_entries", """select o_orderkey, l.last from orders join (select l_orderkey, max(l_shipdate) as last from lineitem group by 1) l on l_orderkey = o_orderkey where l.last < o_orderdate""")
def t05(spark, d):
    last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    return table(spark, d, "orders").join(last, "o_orderkey").where("last < o_orderdate").select("o_orderkey", "last")


def halves(spark, d):
    e = events(spark, d)
    return e.where("ts < timestamp '2024-01-20'"), e.where("ts >= timestamp '2024-01-15'")


LATEST = "(select * from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from {0}) where r = 1)"
OLD, NEW = "(select * from events where ts < timestamp '2024-01-20')", "(select * from events where ts >= timestamp '2024-01-15')"


def snapshots(spark, d):
    order = [F.desc("ts"), F.desc("event_id")]
    old, new = halves(spark, d)
    return history.latest(old.where("user_id % 3 <> 0"), ["user_id", "event_type"], order), history.latest(new, ["user_id", "event_type"], order)


@query("m05_upsert", f"""select event_id, ts, user_id, event_type, value from {LATEST.format(NEW)} union all
    select event_id, ts, user_id, event_type, value from {LATEST.format("(select * from " + OLD + " where user_id % 3 <> 0)")} o
    where not exists (select 1 from {LATEST.format(NEW)} n where n.user_id = o.user_id and n.event_type = o.event_type)""")
def m05(spark, d):
    old, new = snapshots(spark, d)
    return history.upsert(old, new, ["user_id", "event_type"])


@query("m11_upsert_version", """select p_partkey, case when s.s_suppkey is null then 1 else 2 end as version, coalesce(s.s_name, p_name) as summary from part left join supplier s on s_suppkey = p_partkey
    union all select s_suppkey, 2, s_name from supplier where s_suppkey not in (select p_partkey from part)""")
def m11(spark, d):
    old = table(spark, d, "part").select("p_partkey", F.lit(1).alias("version"), F.col("p_name").alias("summary"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.lit(2).alias("version"), F.col("s_name").alias("summary"))
    return history.upsert(old, new, ["p_partkey"])


@query("m01_insert_new", """select c_custkey as id, lower(c_name) as email from customer where c_mktsegment <> 'BUILDING' union all select s_suppkey, lower(s_name) from supplier where s_suppkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')""")
def m01(spark, d):
    old = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").selectExpr("c_custkey as id", "lower(c_name) as email")
    return history.insert_new(old, table(spark, d, "supplier").selectExpr("s_suppkey as id", "lower(s_name) as email"), ["id"])


@query("m06_append", "select event_id, event_type from events union all select event_id + 10000000, 'analysis' from events where event_type = 'view'")
def m06(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "event_type").unionByName(e.where("event_type = 'view'").selectExpr("event_id + 10000000 as event_id", "'analysis' as event_type"))


@query("m07_insert_ignore", """select event_id as jti, user_id from events where event_type = 'signup' union all select event_id, -1 from events where value > 40 and event_type <> 'signup'""")
def m07(spark, d):
    e = events(spark, d)
    return history.insert_new(e.where("event_type = 'signup'").selectExpr("event_id as jti", "user_id"), e.where("value > 40").selectExpr("event_id as jti", "-1L as user_id"), ["jti"])


@query("m13_revoke_both", """select jti from (select event_id as jti from events where event_type = 'signup' union select event_id from events where event_type = 'error' union select event_id + 1 from events where event_type = 'error')""")
def m13(spark, d):
    e = events(spark, d)
    old = e.where("event_type = 'signup'").selectExpr("event_id as jti")
    once = history.insert_new(old, e.where("event_type = 'error'").selectExpr("event_id as jti"), ["jti"])
    return history.insert_new(once, e.where("event_type = 'error'").selectExpr("event_id + 1 as jti"), ["jti"])


@query("m03_patch", """select c_custkey, c_nationkey, case when c_custkey % 2 = 0 then (case when c_custkey % 10 = 0 then null else 'New' || c_custkey end) else c_name end as c_name,
    case when c_custkey % 7 = 0 then c_mktsegment || '' else c_mktsegment end as c_mktsegment,
    case when c_custkey % 2 = 0 then timestamp '2024-06-01' else timestamp '2024-01-01' end as updated_at from customer""")
def m03(spark, d):
    customer = table(spark, d, "customer")
    old = customer.select("c_custkey", "c_nationkey", "c_name", "c_mktsegment", F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    changes = customer.where("c_custkey % 2 = 0 or c_custkey % 7 = 0").selectExpr(
        "c_custkey", "case when c_custkey % 10 <> 0 then concat('New', c_custkey) end as c_name", "c_custkey % 2 = 0 as set_c_name", "c_mktsegment", "c_custkey % 7 = 0 as set_c_mktsegment")
    out = history.patch(old, changes, "c_custkey", ["c_name", "c_mktsegment"], "updated_at", "2024-06-01")
    return out.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("m04_patch_keeping", """select c_custkey, c_acctbal, coalesce(nullif(case when c_custkey % 4 = 0 then 'VIP' end, ''), c_mktsegment) as c_mktsegment from customer""")
def m04(spark, d):
    customer = table(spark, d, "customer")
    changes = customer.selectExpr("c_custkey", "case when c_custkey % 4 = 0 then 'VIP' end as c_mktsegment")
    return history.patch_keeping_nulls(customer.select("c_custkey", "c_acctbal", "c_mktsegment"), changes, "c_custkey", ["c_mktsegment"])


@query("m02_insert_with_children", """select p_partkey as barcode, 'product' as part, p_name as body from part union all
    select p_partkey, 'table', cast(p_size as varchar) from part where p_size > 10 union all select p_partkey, 'ingredients', p_type from part where p_retailprice > 902""")
def m02(spark, d):
    new = table(spark, d, "part")
    parent = new.selectExpr("p_partkey as barcode", "'product' as part", "p_name as body")
    one = new.where("p_size > 10").selectExpr("p_partkey as barcode", "'table' as part", "string(p_size) as body")
    return parent.unionByName(one).unionByName(new.where("p_retailprice > 902").selectExpr("p_partkey as barcode", "'ingredients' as part", "p_type as body"))


@query("m08_delete", "select event_id, user_id from events where user_id not in (select c_custkey from customer where c_mktsegment = 'MACHINERY')")
def m08(spark, d):
    gone = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"))
    return history.delete(events(spark, d), gone, ["user_id"]).select("event_id", "user_id")


@query("m08_deleted_count", "select count(*) as deleted from events where user_id in (select c_custkey from customer where c_mktsegment = 'MACHINERY')")
def m08_count(spark, d):
    gone = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"))
    return history.conflicts(gone, events(spark, d), ["user_id"]).agg(F.count(F.lit(1)).alias("deleted"))


@query("m09_delete_owner", """select 'owner' as part, c_custkey as id, c_custkey as owner from customer where c_nationkey <> 3 union all
    select 'order', o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 3) union all
    select 'event', event_id, case when user_id not in (select c_custkey from customer where c_nationkey = 3) then user_id end from events""")
def m09(spark, d):
    owners = table(spark, d, "customer").selectExpr("c_custkey as owner", "c_nationkey")
    owned = table(spark, d, "orders").selectExpr("o_orderkey as id", "o_custkey as owner")
    linked = events(spark, d).selectExpr("event_id as id", "user_id as owner")
    a, b, c = history.delete_owner(owners, owned, linked, "owner", owners.where("c_nationkey = 3"))
    a = a.selectExpr("'owner' as part", "owner as id", "owner")
    return a.unionByName(b.selectExpr("'order' as part", "id", "owner")).unionByName(c.selectExpr("'event' as part", "id", "owner"))


@query("m10_purge", "select event_id, ts from events where not ts < timestamp '2024-01-15 12:00:00'")
def m10(spark, d):
    return history.purge(events(spark, d), "ts", "2024-01-15 12:00:00").select("event_id", "ts")


@query("m12_upgrade_guest", """select c_custkey, case when c_mktsegment = 'HOUSEHOLD' and c_acctbal >= 0 then 'user' || c_custkey || '@example.com' end as email, not (c_mktsegment = 'HOUSEHOLD' and c_acctbal >= 0) as is_guest from customer""")
def m12(spark, d):
    ok = F.expr("c_mktsegment = 'HOUSEHOLD' and c_acctbal >= 0")
    return table(spark, d, "customer").select("c_custkey", F.when(ok, F.expr("concat('user', c_custkey, '@example.com')")).alias("email"), (~ok).alias("is_guest"))


@query("s11_response_cache", """select event_type, user_id, event_id, last_feature = 'k' and last_hints is not distinct from ['pt', 'en'] as hit from (
    select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r, case when event_id % 2 = 0 then 'k' else 'd' end as last_feature,
    case event_id % 3 when 0 then ['pt', 'en'] when 1 then ['en', 'pt'] end as last_hints from events) where r = 1""")
def s11(spark, d):
    put = events(spark, d).withColumns({"feature": F.expr("case when event_id % 2 = 0 then 'k' else 'd' end"), "hints": F.expr("case event_id % 3 when 0 then array('pt', 'en') when 1 then array('en', 'pt') end")})
    slot = history.latest(put, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    hit = (F.col("feature") == "k") & F.col("hints").eqNullSafe(F.array(F.lit("pt"), F.lit("en")))
    return slot.select("event_type", "user_id", "event_id", hit.alias("hit"))
