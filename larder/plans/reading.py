"""Queries over stored results of outside engines: what is fetched, chosen and put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import reading as R
from larder.plans.attempts import ANCHOR, COLUMNS, cells, responses
from larder.plans.extras import BINARY, DUCK_SIZES, pictures
from larder.plans.registry import query, table
from larder.sources.response_cache import ResponseCache
from larder.streaming.operators import shared_folder

FETCHED = """u as (select user_id, arg_max(event_type, event_id) as last_type, arg_max(value, event_id) as seconds, arg_max(cast(props ->> '$.k' as integer), event_id) as k, max(event_id) as last,
      arg_max(props, event_id) filter (where event_type <> 'error') as answer, arg_min(event_type, event_id) = 'purchase' as kept, arg_min(props, event_id) as first from events group by 1),
    o as (select *, answer is null or last_type = 'error' or seconds > 30 as fails, seconds > 30 as late from u),
    j as (select event_id, 's' || user_id as sha256, 'DOCUMENT_TEXT_DETECTION' as feature, 'pt' as hints, event_id as "at", o.*, kept or (not fails and row_number() over (partition by user_id order by event_id) > 1) as hit from events join o using (user_id)),
    f as (select event_id, sha256, feature, hints, "at", hit as cache_hit, case when kept then first when not fails then answer end as response, not hit as called,
        case when not hit and fails then case when last_type = 'error' and k < 50 then 'quota_exceeded' when last_type = 'error' then 'auth_error' when late then 'timeout' else 'generic_error' end end as error,
        case when not hit and fails then last_type || ' ' || last end as message, case when not hit and last_type = 'error' and late then 'timeout' else '' end as secondary from j)"""


def fetch(spark, d):
    """Requests for users' pictures. What an engine gives is what happened to a user last: its events hold the answer, how long it took, and
    errors; of users whose first event was a purchase, that one's answer is kept."""
    e = table(spark, d, "events")
    key = [F.concat(F.lit("s"), "user_id").alias("sha256"), F.lit("DOCUMENT_TEXT_DETECTION").alias("feature"), F.lit("pt").alias("hints")]
    requests = e.select("event_id", *key, F.col("event_id").alias("at"))
    last = lambda c: F.max_by(c, "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    users = e.groupBy("user_id").agg(last("event_type").alias("last_type"), last("value").alias("seconds"), last(k).alias("k"), F.max("event_id").alias("last"), F.max_by(F.when(F.col("event_type") != "error", F.col("props")), F.when(F.col("event_type") != "error", F.col("event_id"))).alias("answer"), F.min_by("event_type", "event_id").alias("first_type"), F.min_by("props", "event_id").alias("first"))
    cache = users.where("first_type = 'purchase'").select(*key, F.col("first").alias("response"))
    classes = F.expr("case when last_type = 'error' then array(if(k < 50, 'quota_exceeded', 'auth_error')) end")
    outcomes = users.select(*key, F.col("answer").alias("response"), "seconds", classes.alias("classes"), F.concat_ws(" ", "last_type", "last").alias("message"))
    return R.fetched(requests, cache, outcomes).withColumn("secondary", F.array_join("secondary", ","))


@query("s13_fetch", f"with {FETCHED} select * from f")
def s13(spark, d):
    return fetch(spark, d)


@query("s11_cache_puts", f"with {FETCHED} select distinct sha256, feature, hints, response from f where called and error is null")
def s11_puts(spark, d):
    return R.cache_puts(fetch(spark, d))


#: What an event asks an engine for.
FEATURE = "if(event_type in ('view', 'click'), 'DOCUMENT_TEXT_DETECTION', 'TEXT_DETECTION')"


def kept_responses(spark, d):
    """A cache that the events were put in, in two goes: each is an answer to its user's picture."""
    cache = ResponseCache(spark, f"{shared_folder(spark)}/responses")
    answers = table(spark, d, "events").select(F.sha2(F.col("user_id").cast("string"), 256).alias("sha256"), F.expr(FEATURE).alias("feature"), F.array(F.lit("pt"), F.lit("en")).alias("hints"), F.to_json(F.struct("event_id", "event_type")).alias("response"), F.col("event_id").alias("size"), F.col("event_id").alias("put_at"))
    for some in ("put_at % 3 <> 0", "put_at % 3 = 0"):
        cache.put(answers.where(some))
    return cache


@query("s11_cache_get", """with a as (select user_id, event_id, event_type, case when event_type in ('view', 'click') then 'DOCUMENT_TEXT_DETECTION' else 'TEXT_DETECTION' end as feature from events),
    last as (select user_id, arg_max(feature, event_id) as feature, arg_max('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}', event_id) as response from a group by 1)
    select event_id, a.feature, case when event_id % 5 > 0 and a.feature = last.feature then response end as response from a join last using (user_id)""")
def s11_get(spark, d):
    """What is kept for each event's request; every fifth gives its hints in another order."""
    hints = F.expr("if(event_id % 5 = 0, array('en', 'pt'), array('pt', 'en'))")
    requests = table(spark, d, "events").select("event_id", F.sha2(F.col("user_id").cast("string"), 256).alias("sha256"), F.expr(FEATURE).alias("feature"), hints.alias("hints"))
    cache = kept_responses(spark, d)
    cache.compact()
    return cache.get(requests).select("event_id", "feature", "response")


@query("i29_cloud_reading", """with s as (select l_orderkey as k, cast(count(distinct l_linenumber) as integer) as b, cast(count(*) as integer) as w, avg(case when l_partkey % 5 <> 0 and l_partkey % 7 <> 0 then l_quantity / 50 end) as c from lineitem group by 1)
    select k as l_orderkey, case k % 4 when 0 then 'all ' || k when 1 then 'order ' || k else '' end as text, case when k % 4 < 2 then case when c is null then 0 when c > 1 then 100 else c * 100 end else 0 end as mean_confidence,
        case when k % 4 < 2 then b else 0 end as blocks, case when k % 4 < 2 then b else 0 end as paragraphs, case when k % 4 < 2 then w else 0 end as words, k % 4 <> 2 and k % 2 = 0 as cache_hit,
        case when k % 4 < 2 and c is null then 'no_numeric_confidences' end as warning, case k % 4 when 2 then 'invalid_feature' when 3 then 'timeout' end as error, case k % 4 when 2 then 'unknown feature: OTHER' when 3 then 'late' end as message,
        case when k % 4 = 3 then 'generic_error' else '' end as secondary from s""")
def i29(spark, d):
    r = responses(spark, d).withColumn("feature", F.expr("case l_orderkey % 4 when 0 then 'TEXT_DETECTION' when 2 then 'OTHER' else 'DOCUMENT_TEXT_DETECTION' end"))
    failed = F.col("l_orderkey") % 4 == 3
    results = r.select("l_orderkey", "feature", (F.col("l_orderkey") % 2 == 0).alias("cache_hit"), F.when(failed, "timeout").alias("error"), F.when(failed, "late").alias("message"), F.when(failed, F.array(F.lit("generic_error"))).otherwise(F.array().cast("array<string>")).alias("secondary"), F.when(~failed, F.col("payload")).alias("response"))
    return R.cloud_readings(results, "l_orderkey").withColumn("secondary", F.array_join("secondary", ","))


@query("i28_cell_reading", f"""{ANCHOR}, {COLUMNS}, width as (select page, count(*) as n from cols group by page),
    near as (select cc.page, cc.cell, arg_min("column", abs(center - c) * 1000 + "column") as col from cc join cols on cols.page = cc.page group by cc.page, cc.cell),
    slot as (select page, row, col, cell, n, case when page % 10 = 0 then '' when n > 1 and col = n - 1 then 'v' || cell % 1000 else 'c' || cell % 1000 end as t, case when n > 1 and col = n - 1 then cell % 50 else cell % 101 end as c
        from (select w.page, w.row, w.cell, near.col, width.n, row_number() over (partition by w.page, w.row, near.col order by w.x desc, w.cell desc) as r from walk w join near on near.page = w.page and near.cell = w.cell join width on width.page = w.page) where r = 1),
    line as (select q.page, q.row, max(coalesce(t, '') <> '') as filled, string_agg(coalesce(t, ''), chr(9) order by i) as line from (select distinct page, row, n, unnest(range(0, n)) as i from slot) q left join slot s on s.page = q.page and s.row = q.row and s.col = q.i group by q.page, q.row),
    grid as (select page, coalesce(string_agg(case when filled then line end, chr(10) order by row), '') as grid, count(*) as rows from line group by page),
    conf as (select page, coalesce(sum(case when c > 0 then c end), 0) as s, count(case when c > 0 then 1 end) as k, max(n) as columns from slot group by page), counted as (select page, count(*) as cells from {{DUCK_CELLS}} group by page)
    select page, case when page % 3 = 0 then trim('head ' || page || chr(10) || grid, ' ' || chr(10) || chr(9)) when grid <> '' then grid else 'all ' || page end as text,
        case when k + case when page % 3 = 0 then 1 when grid = '' then 1 else 0 end > 0 then (s + case when page % 3 = 0 then 50 when grid = '' then 7 else 0 end) / (k + case when page % 3 = 0 or grid = '' then 1 else 0 end) else 0 end as mean_confidence,
        cast(cells as integer) as cells, cast(rows as integer) as rows, cast(columns as integer) as columns from grid join conf using (page) join counted using (page)""".replace("{DUCK_CELLS}", "(select distinct l_orderkey as page, ((l_linenumber * 100000 + l_partkey) * 1000 + l_suppkey) * 100 + cast(trunc(l_quantity) as integer) as cell from lineitem)"))
def i28(spark, d):
    """Cells that an engine read in two ways; every tenth page's are blank; every third page has a header."""
    read = cells(spark, d).selectExpr("*", "case when page % 10 = 0 then ' ' else concat('c', cell % 1000, '\n') end as text", "double(cell % 101) as confidence", "case when page % 10 = 0 then '' else concat('v', cell % 1000) end as last_text", "double(cell % 50) as last_confidence")
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page")).distinct()
    whole = pages.select("page", F.concat(F.lit("all "), "page").alias("text"), F.lit(7.0).alias("confidence"))
    headers = pages.where("page % 3 = 0").select("page", F.concat(F.lit(" head "), "page").alias("text"), F.lit(50.0).alias("confidence"))
    return R.cell_readings(read, whole, "page", headers)


@query("i24_best_detection", """select page, x1, y1, x2, y2, confidence from (select *, row_number() over (partition by page order by confidence desc, nth) as r from (
    select l_orderkey as page, (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey as nth, l_discount * 10 as confidence, l_returnflag as label, cast(trunc(l_tax * 400) as integer) as x1, cast(trunc(l_discount * 300) as integer) as y1, least(400, cast(trunc((l_tax + l_quantity / 50) * 400) as integer)) as x2, least(300, cast(trunc((l_discount + l_quantity / 60) * 300) as integer)) as y2 from lineitem)
    where confidence >= 0.3 and label in ('A', 'N') and x2 > x1 and y2 > y1 and (x2 - x1) * (y2 - y1) >= 0.04 * 120000) where r = 1""")
def i24(spark, d):
    found = table(spark, d, "lineitem").selectExpr("l_orderkey as page", "(l_linenumber * 1000000L + l_partkey) * 1000 + l_suppkey as nth", "l_returnflag as label", "l_discount * 10 as confidence", "l_tax as left", "l_discount as top", "l_tax + l_quantity / 50 as right", "l_discount + l_quantity / 60 as bottom", "400 as width", "300 as height")
    return R.best_detection(found, "page", ("a.", "N"), 0.3)


HINT = "case when shown in ('text', 'aslant') then 'text' else 'table' end"


@query("i24_regions")
def i24_regions(spark, d):
    """The region of every picture, by what it shows: a text or a table."""
    return R.regions_of(pictures(spark, d).withColumn("category", F.expr(HINT)), "p_partkey", "category")


@query("i24_region_kinds", f"""select p_partkey as key, case when shown in ('framed', 'colour') then 'grid' when shown = 'panel' then 'quadrilateral' when shown in ('text', 'aslant') then 'text' else 'none' end as found,
    case when shown in ('framed', 'colour') then greatest(0, margin - 2 - width * 4 // 100) else -1 end as x1, case when shown in ('framed', 'colour') then greatest(0, margin - 2 - height * 4 // 100) else -1 end as y1 from {DUCK_SIZES}""")
def i24_kinds(spark, d):
    """What each picture's region was found by, and where a grid's begins: its lines, two pixels of widening, and a share of the sides around."""
    grid = lambda c: F.when(F.col("found") == "grid", F.col(c)).otherwise(-1).alias(c)
    return i24_regions(spark, d).select("key", "found", grid("x1"), grid("y1"))


@query("i28_cells_to_read")
def i28_cells(spark, d):
    """What an engine is to read of every picture: header, cells and whole, by hash of their bytes."""
    made = R.cells_of(pictures(spark, d), "p_partkey", BINARY, 0.2)
    return made.withColumn("png", F.sha2("png", 256))
