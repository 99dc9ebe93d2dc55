"""Queries over attempts (conversation turns), boxes (order lines), responses and presets."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import annotations as A
from larder.operators import cascade, layout, metrics
from larder.plans.registry import query, table
from larder.sources import preset_files as preset_source
from larder.sources import presets as P
from larder.streaming.operators import shared_folder

KEYWORDS = ("reau de", "la le", "the and", "die der", "de la")
LEAST = (40.0, 40, 1)


def attempts(spark, d):
    turns = table(spark, d, "conversations").selectExpr("conv_id", "turn", "text", "double(length(text) % 101) as confidence")
    return cascade.scored(turns, "text", "confidence", KEYWORDS, LEAST)


FOLDED = r"trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
HITS = " + ".join(f"(case when f <> '' and len(list_filter(range(1, greatest(1, len(w) - {len(k.split()) - 1}) + 1), lambda i: levenshtein(array_to_string(w[i:i + {len(k.split()) - 1}], ' '), '{k}') <= 3)) > 0 then 1 else 0 end)" for k in KEYWORDS)
SCORED = rf"""scored as (select *, confidence >= 40 and text_length >= 40 and keyword_hits >= 1 as passed, (confidence / 100.0) * 0.5 + least(keyword_hits / 5.0, 1.0) * 0.4 + least(text_length / 500.0, 1.0) * 0.1 as score from (
    select conv_id, turn, text, cast(length(text) % 101 as double) as confidence, cast(length(trim(text, E' \n\t\r')) as integer) as text_length, cast({HITS} as integer) as keyword_hits from (select *, string_split(f, ' ') as w from (select *, {FOLDED} as f from conversations))))"""


@query("f26_scores", f"with {SCORED} select conv_id, turn, text_length, keyword_hits, passed, score from scored")
def f26(spark, d):
    return attempts(spark, d).select("conv_id", "turn", "text_length", "keyword_hits", "passed", "score")


@query("j14_keyword_hits", f"with {SCORED} select keyword_hits, count(*) as n from scored group by 1")
def j14(spark, d):
    return attempts(spark, d).groupBy("keyword_hits").agg(F.count(F.lit(1)).alias("n"))


@query("p18_passed", f"with {SCORED} select conv_id, turn from scored where passed")
def p18(spark, d):
    return attempts(spark, d).where("passed").select("conv_id", "turn")


def winner_sql(stop: bool) -> str:
    order = "case when passed then 0 else 1 end, case when passed then turn else -score end, turn" if stop else "-score, turn"
    ran = "coalesce(min(case when passed then turn end) over w + 1, count(*) over w)" if stop else "count(*) over w"
    return f"""with {SCORED} select conv_id, turn as winner, passed, score, ran from (select *, row_number() over (partition by conv_id order by {order}) as r, {ran} as ran from scored window w as (partition by conv_id)) where r = 1"""


@query("o06_first_pass_or_best", winner_sql(True))
def o06(spark, d):
    return cascade.winners(attempts(spark, d), "conv_id", "turn")


@query("w05_best_of_all", winner_sql(False))
def w05(spark, d):
    return cascade.winners(attempts(spark, d), "conv_id", "turn", stop=False)


@query("o07_polarity", "select o_orderkey, case when a.m > b.m then 'inverted' else 'normal' end as polarity from orders join (select l_orderkey, avg(l_quantity) as m from lineitem where l_linenumber % 2 = 0 group by 1) a on a.l_orderkey = o_orderkey join (select l_orderkey, avg(l_quantity) as m from lineitem where l_linenumber % 2 = 1 group by 1) b on b.l_orderkey = o_orderkey")
def o07(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg(F.expr("case when l_linenumber % 2 = 0 then l_quantity end")).alias("a"), F.avg(F.expr("case when l_linenumber % 2 = 1 then l_quantity end")).alias("b")).where("a is not null and b is not null")
    return table(spark, d, "orders").join(lines, "o_orderkey").select("o_orderkey", cascade.polarity(F.col("b"), F.col("a")).alias("polarity"))


LISTED = ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in P.PRESETS)
PRESETS = f"(select * from (values {LISTED}) t(category, name, kind, priority, psm, confidence, length, hits, steps))"


#: A preset file of a supplier, as JSON: some lack a priority or a key, are of an unknown kind, or are cut.
FILE = """concat('{', case when s_suppkey % 13 = 5 then '' else concat('"name":"', s_name, '",') end, '"kind":"', case s_suppkey % 6 when 0 then 'cloud_vision' when 1 then 'linear_table' when 2 then 'linear_text' when 3 then 'linear_ingredient' when 4 then 'cell_based' else 'oil_painting' end, '",',
    case when s_suppkey % 4 = 1 then '' else concat('"priority":', s_nationkey, ',') end, '"steps":[{"op":"grayscale"},{"op":"clahe","clip_limit":2.5,"tile_grid_size":[8,8]}],"ocr":{"psm":', s_suppkey % 10, '}', case when s_suppkey % 17 = 7 then '' else '}' end)"""
FOLDERS = "case s_suppkey % 5 when 0 then 'text' when 1 then 'ingredients' when 2 then 'other' else 'table' end"
DUCK_FILES = """(select *, case when error is not null then folder when k = 0 then folder when k in (1, 4) then 'table' when k = 2 then 'text' else 'ingredients' end as category, case when error is null then coalesce(given, 100) end as priority,
      case when error is null then case k when 0 then 'cloud_vision' when 1 then 'linear_table' when 2 then 'linear_text' when 3 then 'linear_ingredient' else 'cell_based' end end as kind from
    (select s_suppkey, s_name, s_suppkey % 6 as k, case s_suppkey % 5 when 0 then 'text' when 1 then 'ingredients' else 'table' end as folder, case when s_suppkey % 4 <> 1 then s_nationkey end as given,
      case when s_suppkey % 17 = 7 then 'not JSON' when s_suppkey % 13 = 5 then 'missing: name' when s_suppkey % 6 = 5 then 'unknown kind: oil_painting' end as error from supplier where s_suppkey % 5 <> 2))"""


def preset_files(spark, d):
    """A preset file for each supplier, written in folders of categories and read by the data source."""
    folder = f"{shared_folder(spark)}/presets"
    files = table(spark, d, "supplier").select(F.expr(FOLDERS).alias("category"), F.concat("s_suppkey", F.lit(".json")).alias("file"), F.expr(FILE).alias("body"))
    # files take longer to write than their rows to read: as many tasks as a shuffle has
    preset_source.write(files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file"), folder)
    return preset_source.load(spark, folder)


@query("s07_preset_files", f"select category, case when error is null then s_name end as name, kind, priority, case when error is null then 'grayscale; clahe clip_limit=2.5 tile_grid_size=8,8' end as steps, case when error is null then cast(s_suppkey % 10 as varchar) end as psm, error from {DUCK_FILES}")
def s07(spark, d):
    """All files: presets, and what is wrong with the others."""
    return preset_files(spark, d).select("category", "name", "kind", "priority", "steps", F.col("ocr")["psm"].alias("psm"), "error")


@query("s08_presets", f"select s_suppkey, s_nationkey, kind, priority from {DUCK_FILES} join supplier using (s_suppkey) where error is null".replace("select s_suppkey, s_nationkey", "select s_suppkey, supplier.s_nationkey"))
def s08(spark, d):
    """Presets with their suppliers, whose keys name the files; names may repeat."""
    of = F.col("s_suppkey") == F.regexp_extract("file", r"^(.*)\.json$", 1).cast("long")
    return preset_files(spark, d).where("error is null").join(table(spark, d, "supplier"), of).select("s_suppkey", "s_nationkey", "kind", "priority")


@query("s19_preset_listing", f"select category, string_agg(s_name, ',' order by priority, s_name) as names from {DUCK_FILES} where error is null group by category")
def s19(spark, d):
    return P.listed(preset_files(spark, d).where("error is null"))


@query("o04_preset_order", f"select category, s_name as name, row_number() over (partition by category order by priority, s_name) as place from {DUCK_FILES} where error is null")
def o04(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("category").orderBy("priority", "name"))
    return preset_files(spark, d).where("error is null").select("category", "name", place.alias("place"))


@query("s06_presets_of_category", f"select s_name as name, kind, priority from {DUCK_FILES} where error is null and category = 'ingredients'")
def s06(spark, d):
    return P.ordered(preset_files(spark, d).where("error is null and category = 'ingredients'")).select("name", "kind", "priority")


@query("j16_attempt_presets", f"select conv_id, turn, name from (select *, case conv_id % 3 when 0 then 'ingredients' when 1 then 'table' else 'text' end as category from conversations) join {PRESETS} p using (category) where p.priority = 10")
def j16(spark, d):
    turns = table(spark, d, "conversations").selectExpr("conv_id", "turn", "case conv_id % 3 when 0 then 'ingredient' when 1 then 'table' else 'text' end as category")
    return cascade.with_presets(turns, P.presets(spark).where("priority = 10").select("category", "name")).select("conv_id", "turn", "name")


@query("s18_outcomes", f"with {SCORED} select conv_id, turn, '{{\"attempt_index\":' || turn || ',\"passed\":' || passed || ',\"hits\":' || keyword_hits || '}}' as outcome from scored")
def s18(spark, d):
    body = F.struct(F.col("turn").alias("attempt_index"), "passed", F.col("keyword_hits").alias("hits"))
    return attempts(spark, d).select("conv_id", "turn", F.to_json(body).alias("outcome"))


CELLS = "l_orderkey as page, ((l_linenumber * 100000L + l_partkey) * 1000 + l_suppkey) * 100 + cast(l_quantity as int) as cell, l_linenumber * 10 + cast(l_quantity as int) as y, cast(l_extendedprice / 100 as int) as x, 12 + cast(l_tax * 100 as int) as h, 20 + l_linenumber as w"


def cells(spark, d):
    return table(spark, d, "lineitem").selectExpr(*CELLS.split(", ")).distinct()


DUCK_CELLS = "(select distinct l_orderkey as page, ((l_linenumber * 100000 + l_partkey) * 1000 + l_suppkey) * 100 + cast(trunc(l_quantity) as integer) as cell, l_linenumber * 10 + cast(trunc(l_quantity) as integer) as y, cast(trunc(l_extendedprice / 100) as integer) as x, 12 + cast(trunc(l_tax * 100) as integer) as h, 20 + l_linenumber as w from lineitem )"
ANCHOR = f"""with recursive c as (select * exclude n, row_number() over (partition by page order by y, x, h, cell) as n, greatest(8, cast(trunc(0.5 * avg(h) over (partition by page)) as integer)) as tol from (select *, row_number() over (partition by page, cell order by y, x, h) as n from {DUCK_CELLS}) where n = 1),
    walk as (select page, cell, y, x, n, 0 as row, y as anchor from c where n = 1 union all select c.page, c.cell, c.y, c.x, c.n, case when abs(c.y - w.anchor) > c.tol then w.row + 1 else w.row end, case when abs(c.y - w.anchor) > c.tol then c.y else w.anchor end from walk w join c on c.page = w.page and c.n = w.n + 1)"""


@query("w03_rows_by_anchor", f"{ANCHOR} select page, cell, y, x, row from walk")
def w03(spark, d):
    return layout.rows_by_anchor(cells(spark, d), "page", "y", "x", "h")


COLUMNS = f"""cc as (select page, cell, x + w // 2 as c, greatest(10, cast(trunc(0.4 * avg(w) over (partition by page)) as integer)) as tol from {DUCK_CELLS}),
    jumps as (select *, case when c - lag(c) over (partition by page order by c) > tol then 1 else 0 end as j from cc),
    numbered as (select *, sum(j) over (partition by page order by c range unbounded preceding) as col from jumps), cols as (select page, cast(col as integer) as "column", cast(floor(sum(c) / count(*)) as integer) as center from numbered group by page, col)"""


@query("w02_columns_by_gap", f"with {COLUMNS} select * from cols")
def w02(spark, d):
    return layout.columns_by_gap(cells(spark, d), "page", "x", "w")


@query("j15_nearest_columns", f"with {COLUMNS} select cc.page, cell, arg_min(\"column\", abs(center - c) * 1000 + \"column\") as \"column\" from cc join cols on cols.page = cc.page group by cc.page, cell")
def j15(spark, d):
    c = cells(spark, d)
    return layout.nearest_columns(c, layout.columns_by_gap(c, "page", "x", "w"), "page", "x", "w").select("page", "cell", "column")


@query("a12_tolerances", f"select page, greatest(8, cast(trunc(0.5 * avg(h)) as integer)) as rows, greatest(10, cast(trunc(0.4 * avg(w)) as integer)) as columns from {DUCK_CELLS} group by page")
def a12(spark, d):
    mean = cells(spark, d).groupBy("page").agg(F.avg("h").alias("h"), F.avg("w").alias("w"))
    return mean.select("page", layout.tolerance(F.col("h"), layout.CELL_ROWS).alias("rows"), layout.tolerance(F.col("w"), layout.CELL_COLUMNS).alias("columns"))


@query("a11_upper_median", "select l_orderkey, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] as median from lineitem group by l_orderkey")
def a11(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(layout.upper_median(F.collect_list("l_quantity")).alias("median"))


@query("o09_reading_order", f"select page, cell, row_number() over (partition by page order by y, x, h, cell) as place from {DUCK_CELLS}")
def o09(spark, d):
    return layout.reading_places(cells(spark, d), "page", "y", "x", "h", "cell").select("page", "cell", "place")


@query("p19_cell_sizes", f"select page, cell from {DUCK_CELLS} where w >= 22 and h >= 14 and w * h / 10000.0 between 0.03 and 0.05")
def p19(spark, d):
    return layout.cells_that_count(cells(spark, d), "w", "h", F.lit(10000.0), (0.03, 0.05), (22, 14)).select("page", "cell")


@query("o08_best_box", f"select page, cell from (select *, row_number() over (partition by page order by w * h / 10000.0 * h desc, cell) as r from {DUCK_CELLS}) where r = 1")
def o08(spark, d):
    return layout.best_box(cells(spark, d), "page", "cell", F.expr("w * h / 10000.0 * h"))


@query("p20_box_filters", f"select page, cell, w * h / 5000.0 as ratio from {DUCK_CELLS} where w * h / 5000.0 >= 0.06 and w / h < 1.5")
def p20(spark, d):
    return cells(spark, d).selectExpr("page", "cell", "w * h / 5000.0 as ratio", "w / h as shape").where("ratio >= 0.06 and shape < 1.5").select("page", "cell", F.col("ratio").cast("double").alias("ratio"))


def words(spark, d):
    """Each order's lines as words in three columns, with drifting heights."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    y = "l_linenumber * 18 + (l_partkey + i) % 5"
    return line.selectExpr("l_orderkey as page", "concat('w', l_linenumber, '_', i) as text", "cast(i * 90 + l_partkey % 7 as int) as x1", "cast(i * 90 + l_partkey % 7 + 40 + l_suppkey % 9 as int) as x2", f"cast({y} as int) as y1", f"cast({y} + 10 + l_suppkey % 3 as int) as y2")


BY_MEAN = """with recursive wd as (select l_orderkey as page, 'w' || l_linenumber || '_' || i as text, cast(i * 90 + l_partkey % 7 as integer) as x1, cast(i * 90 + l_partkey % 7 + 40 + l_suppkey % 9 as integer) as x2,
        cast(l_linenumber * 18 + (l_partkey + i) % 5 as integer) as y1, cast(l_linenumber * 18 + (l_partkey + i) % 5 + 10 + l_suppkey % 3 as integer) as y2 from lineitem, range(0, 3) t(i)),
    med as (select page, greatest(6, cast(trunc(list_sort(list(y2 - y1))[len(list(y2 - y1)) // 2 + 1] * 0.55) as integer)) as tol from wd where y2 > y1 group by page),
    s as (select *, row_number() over (partition by page order by c, x1, x2, y1, y2, text) as n from (select wd.*, (y1 + y2) // 2 as c, tol from wd join med using (page))),
    walk(page, n, text, x1, x2, c, row, sums, cnts) as (
      select page, n, text, x1, x2, c, cast(0 as bigint), [cast(c as double)], [1] from s where n = 1
      union all
      select page, n, text, x1, x2, c, r, case when r = len(sums) then list_append(sums, cast(c as double)) else list_transform(sums, lambda v, j: case when j = r + 1 then v + c else v end) end,
        case when r = len(cnts) then list_append(cnts, 1) else list_transform(cnts, lambda v, j: case when j = r + 1 then v + 1 else v end) end
      from (select s.page, s.n, s.text, s.x1, s.x2, s.c, w.sums, w.cnts, cast(coalesce(nullif(list_position(list_transform(w.sums, lambda v, j: abs(s.c - v / w.cnts[j]) <= s.tol), true), 0) - 1, len(w.sums)) as bigint) as r
            from walk w join s on s.page = w.page and s.n = w.n + 1)),
    placed as (select page, text, x1, x2, c, cast(row as integer) as row, cast(row_number() over (partition by page, row order by x1, c, x2, text) as integer) as place from walk),
    gap as (select page, row, place, start, x1 as stop from (select *, lag(x2) over (partition by page, row order by place) as start from placed) where start is not null),
    sep as (select page, x, n from (select page, x, count(distinct row) as n from (select page, row, unnest(range(start, stop)) as x from gap where stop - start >= 10) group by page, x) where n >= 2)"""


@query("w04_rows_by_mean", f"{BY_MEAN} select * from placed")
def w04(spark, d):
    return layout.rows_by_mean(words(spark, d), "page")


@query("w06_gaps", f"{BY_MEAN} select * from gap")
def w06(spark, d):
    return layout.gaps(words(spark, d), "page")


@query("a13_separators", f"{BY_MEAN} select * from sep")
def a13(spark, d):
    return layout.separators(words(spark, d), "page")


@query("f35_table_text", f"""{BY_MEAN}, tab as (select distinct page, row, place from (select page, row, place, unnest(range(start, stop)) as x from gap where stop - start > 10) join sep using (page, x)),
    lines as (select p.page, p.row, string_agg(case when p.place = 1 then '' when t.place is not null then chr(9) else ' ' end || text, '' order by p.place) as line from placed p left join tab t on t.page = p.page and t.row = p.row and t.place = p.place group by p.page, p.row)
    select page, string_agg(line, chr(10) order by row) as text from lines group by page""")
def f35(spark, d):
    return layout.table_text(words(spark, d), "page")


RESPONSE = """'{"' || case when {k} % 2 = 0 then 'fullTextAnnotation' else 'full_text_annotation' end || '":{"text":"order ' || {k} || '","pages":[{"blocks":[' || b || ']}]},"textAnnotations":[{"description":"all ' || {k} || '"}' || a || ']}'"""


def responses(spark, d):
    lines = table(spark, d, "lineitem")
    word = F.expr("""concat('{"confidence":', case when l_partkey % 5 = 0 then '"high"' when l_partkey % 7 = 0 then 'null' else string(l_quantity / 50) end, ',"boundingBox":{"vertices":[{"x":1}]}}')""")
    flat = F.expr("""concat(',{"description":"', case when l_linenumber = 3 then '' else concat('w', l_partkey) end, '","boundingPoly":{"vertices":[{"x":', l_linenumber, ',"y":', l_suppkey, '},{"x":', l_linenumber + 5, '}]}}')""")
    block = lines.groupBy("l_orderkey", "l_linenumber").agg(F.concat(F.lit('{"paragraphs":[{"words":['), F.array_join(F.array_sort(F.collect_list(word)), ","), F.lit("]}]}")).alias("b"), F.array_join(F.array_sort(F.collect_list(flat)), "").alias("a"))
    whole = block.groupBy("l_orderkey").agg(F.array_join(F.collect_list("b"), ",").alias("b"), F.array_join(F.array_sort(F.collect_list("a")), "").alias("a"))
    return whole.select("l_orderkey", F.expr(RESPONSE.replace("{k}", "l_orderkey")).alias("payload"))


@query("a07_annotation_statistics", """select l_orderkey, cast(count(distinct l_linenumber) as integer) as blocks, cast(count(distinct l_linenumber) as integer) as paragraphs, cast(count(*) as integer) as words,
    coalesce(case when avg(case when l_partkey % 5 <> 0 and l_partkey % 7 <> 0 then l_quantity / 50 end) > 1 then 100 else avg(case when l_partkey % 5 <> 0 and l_partkey % 7 <> 0 then l_quantity / 50 end) * 100 end, 0) as mean_confidence, case when count(case when l_partkey % 5 <> 0 and l_partkey % 7 <> 0 then 1 end) = 0 then 'no_numeric_confidences' end as warning from lineitem group by l_orderkey""")
def a07(spark, d):
    return A.statistics(responses(spark, d), "l_orderkey", "payload")


@query("a08_annotation_counts", "select l_orderkey, cast(count(distinct l_linenumber) as integer) as blocks, cast(count(*) as integer) as words from lineitem group by l_orderkey")
def a08(spark, d):
    return A.statistics(responses(spark, d), "l_orderkey", "payload").select("l_orderkey", "blocks", "words")


@query("f34_word_tokens", "select l_orderkey, 'w' || l_partkey as text, l_linenumber as x1, 0 as y1, l_linenumber + 5 as x2, cast(l_suppkey as integer) as y2 from lineitem where l_linenumber <> 3")
def f34(spark, d):
    return A.word_tokens(responses(spark, d), "l_orderkey", "payload").drop("pos")


@query("a09_boxes", "select l_orderkey, min(l_linenumber) as x1, max(l_linenumber + 5) as x2, cast(max(l_suppkey) as integer) as y2 from lineitem where l_linenumber <> 3 group by l_orderkey")
def a09(spark, d):
    return A.word_tokens(responses(spark, d), "l_orderkey", "payload").groupBy("l_orderkey").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


@query("f32_response_text", "select l_orderkey, case when l_orderkey % 3 = 0 then 'all ' || l_orderkey else 'order ' || l_orderkey end as text from lineitem group by l_orderkey")
def f32(spark, d):
    feature = F.expr("case when l_orderkey % 3 = 0 then 'TEXT_DETECTION' when l_orderkey % 3 = 1 then 'DOCUMENT_TEXT_DETECTION' else 'OTHER' end")
    return responses(spark, d).select("l_orderkey", A.text_of(A.parsed(F.col("payload")), feature).alias("text"))


@query("f33_first_present", "select event_id, case when event_id % 3 = 0 then null when event_id % 3 = 1 then props ->> '$.k' else 'x' end as value from events")
def f33(spark, d):
    payload = F.expr("""case event_id % 3 when 0 then '{"a":null,"b":"y"}' when 1 then concat('{"b":', get_json_object(props, '$.k'), '}') else '{"a":"x","b":"y"}' end""")
    return table(spark, d, "events").select("event_id", A.first_present(payload, "a", "b").alias("value"))


@query("a06_mean_confidence", "select user_id, coalesce(avg(case when value - 5 >= 0 then value - 5 end), 0) as mean from events group by user_id")
def a06(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(A.mean_confidence(F.expr("string(value - 5)")).alias("mean"))


@query("a10_positive_mean", "select event_type, coalesce(avg(case when value > 20 then value end), 0.0) as mean from events group by event_type")
def a10(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.coalesce(F.avg(F.expr("case when value > 20 then value end")), F.lit(0.0)).alias("mean"))


PAIRS = "(select a.p_partkey, a.p_name || ' 12 mg' as reference, b.p_name || ' 12mg' as found from part a join part b on b.p_partkey = a.p_partkey + 1)"


def pairs(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat("p_name", F.lit(" 12mg")).alias("found"))
    return part.join(other, "p_partkey").select("p_partkey", F.concat("p_name", F.lit(" 12 mg")).alias("reference"), "found")


@query("a15_character_rate", f"select p_partkey, levenshtein(replace(reference, '12 mg', '12mg'), found) / length(replace(reference, '12 mg', '12mg')) as cer from {PAIRS}")
def a15(spark, d):
    return pairs(spark, d).select("p_partkey", metrics.character_rate(F.col("reference"), F.col("found")).alias("cer"))


@query("a14_word_edits", f"""select p_partkey, cast(case when a[1] <> b[1] then 1 else 0 end + case when a[2] <> b[2] then 1 else 0 end as integer) as errors,
    (case when a[1] <> b[1] then 1 else 0 end + case when a[2] <> b[2] then 1 else 0 end) / 3.0 as wer from (select p_partkey, string_split(reference, ' ') as a, string_split(found, ' ') as b from {PAIRS})""")
def a14(spark, d):
    return metrics.error_rates(pairs(spark, d), "reference", "found").select("p_partkey", "errors", "wer")


#: Words of a turn and of the next one in its conversation.
TURNS = "(select conv_id, turn, string_split(text, ' ') as a, string_split(lead(text) over (partition by conv_id order by turn), ' ') as b from conversations)"


@query("a14_edits_by_kind", f"""with recursive p as (select * from {TURNS} where a is not null and b is not null), run(conv_id, turn, n, cells) as (
    select conv_id, turn, 0, list_transform(range(0, len(b) + 1), lambda j: {{'t': j, 'p': 0, 's': 0, 'd': 0, 'n': j}}) from p
    union all
    select conv_id, turn, n + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [{{'t': j, 'p': 0, 's': 0, 'd': 0, 'n': 0}}]),
      lambda made, e: list_append(made, case when b[e[1].t] = a[n + 1] then cells[e[1].t] else list_min([
        {{'t': cells[e[1].t].t + 1, 'p': 0, 's': cells[e[1].t].s + 1, 'd': cells[e[1].t].d, 'n': cells[e[1].t].n}},
        {{'t': cells[e[1].t + 1].t + 1, 'p': 1, 's': cells[e[1].t + 1].s, 'd': cells[e[1].t + 1].d + 1, 'n': cells[e[1].t + 1].n}},
        {{'t': made[e[1].t].t + 1, 'p': 2, 's': made[e[1].t].s, 'd': made[e[1].t].d, 'n': made[e[1].t].n + 1}}]) end), [{{'t': n + 1, 'p': 0, 's': 0, 'd': n + 1, 'n': 0}}])
    from run join p using (conv_id, turn) where n < len(a))
    select conv_id, turn, cast(cells[-1].s as integer) as substitutions, cast(cells[-1].d as integer) as deletions, cast(cells[-1].n as integer) as insertions from run join p using (conv_id, turn) where n = len(a)""")
def a14_kinds(spark, d):
    """Words substituted, deleted and inserted from each turn of a conversation to the next."""
    from pyspark.sql import Window

    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    # two texts of a few hundred bytes are compared word by word: as many tasks as a shuffle has, which aren't put together for being small
    spread = table(spark, d, "conversations").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    turns = spread.select("conv_id", "turn", F.split("text", " ", -1).alias("a"), F.split(after, " ", -1).alias("b")).where("a is not null and b is not null")
    e = turns.select("conv_id", "turn", metrics.word_edits(F.col("a"), F.col("b")).alias("e"))
    return e.select("conv_id", "turn", F.col("e.s").alias("substitutions"), F.col("e.d").alias("deletions"), F.col("e.i").alias("insertions"))


@query("a16_corpus_rate", f"select sum(levenshtein(replace(reference, '12 mg', '12mg'), found)) / sum(length(reference) - 1) as rate from {PAIRS}")
def a16(spark, d):
    from larder.functions.text import fold_metric

    a, b = fold_metric(F.col("reference")), fold_metric(F.col("found"))
    return metrics.corpus_rate(pairs(spark, d).select(F.levenshtein(a, b).alias("e"), F.length(a).alias("n")), "e", "n")
