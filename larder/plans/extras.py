"""Streaming and image queries; tests compare streams with their batch forms."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from larder.functions import images
from larder.operators import history
from larder.operators import search as find
from larder.plans.registry import query, table
from larder.sources import presets as P


@query("t02_admissions", """with recursive e as (select user_id, epoch_us(ts) / 86400000000.0 as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
    run(user_id, n, t, clock, held) as (
      select distinct user_id, cast(0 as bigint), cast(0 as double), cast('-infinity' as double), cast([] as double[]) from e
      union all
      select user_id, n, t, case when len(h) >= 2 then greatest(c, h[len(h) - 1] + 3) else c end,
        list_append(case when len(h) >= 2 then list_filter(h, lambda x: x > greatest(c, h[len(h) - 1] + 3) - 3) else h end, case when len(h) >= 2 then greatest(c, h[len(h) - 1] + 3) else c end)
      from (select r.user_id, e.n, e.t, greatest(r.clock, e.t) as c, list_filter(r.held, lambda x: x >= greatest(r.clock, e.t) - 3) as h from run r join e on e.user_id = r.user_id and e.n = r.n + 1))
    select user_id, t as requested, clock as admitted from run where n > 0""")
def t02(spark, d):
    """Waits of each user's requests under a limit of 2 in 3 days."""
    days = table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("at"))
    return history.admitted(days, "user_id", "at", 2, 3.0)


@query("t01_ttl_days", "select cast(ts as date) as day, count(*) as kept from events where not ts < timestamp '2024-01-20' group by 1")
def t01(spark, d):
    return history.purge(table(spark, d, "events"), "ts", "2024-01-20").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("kept"))


#: What a picture shows, by key: a ruled table in white space, on the whole picture, on dark ground, in colour, of many rows; a panel aslant; text, straight or
#: aslant; nothing.
SHOWN = ("framed", "table", "dark", "colour", "tall", "panel", "text", "aslant", "blank", "table", "tall", "dark")
#: Sizes of a supplier's picture, from its lines: columns and rows of a table, sides of its cells, white space, sides of the picture.
SIZES = (
    ("cols", "3 + lines % 3"),
    ("lanes", "case when shown = 'tall' then 15 else 5 + quantity % 3 end"),
    ("cw", "case cols when 3 then 70 when 4 then 52 else 42 end"),
    ("ch", "42"),
    ("margin", "case when shown in ('framed', 'colour') then 36 else 0 end"),
    ("width", "case when shown in ('panel', 'text', 'aslant', 'blank') then 240 else cols * cw + 2 + 2 * margin end"),
    ("height", "case when shown in ('panel', 'text', 'aslant', 'blank') then 180 else lanes * ch + 2 + 2 * margin end"),
)
#: The ink at a place (x, y) of a picture; ~ stands for whole division.
INK = """case when shown in ('panel') then
      x + y ~ 5 >= 60 and x + y ~ 5 < 200 and y - x ~ 5 >= 10 and y - x ~ 5 < 110 and not (x + y ~ 5 >= 62 and x + y ~ 5 < 198 and y - x ~ 5 >= 12 and y - x ~ 5 < 108)
    when shown = 'text' then x >= 30 and x < 130 and y >= 40 and y < 148 and y % 18 < 8 and x % 12 < 9
    when shown = 'aslant' then x - y ~ 12 >= 50 and x - y ~ 12 < 170 and y + x ~ 12 >= 30 and y + x ~ 12 < 138 and (y + x ~ 12) % 18 < 8 and (x - y ~ 12) % 14 < 9
    when shown = 'blank' then false
    else x >= margin and y >= margin and x < margin + cols * cw + 2 and y < margin + lanes * ch + 2
      and ((x - margin) % cw < 2 or (y - margin) % ch < 2 or ((x - margin) % cw >= 10 and (x - margin) % cw < 15 and (y - margin) % ch >= 12 and (y - margin) % ch < 12 + 4 + lines % 2)) end"""
#: A picture's bytes: one a place, or blue, green and red.
PIXEL = f"case when shown = 'dark' then case when {INK} then 225 else 30 end when {INK} then case when shown = 'colour' then case c when 0 then 30 when 1 then 20 else 90 end else 25 end else case when shown = 'colour' then 250 - 20 * c else 235 end end"


def sizes(spark, d):
    """What each supplier's picture shows, and its sizes, from the lines of its parts."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    shown = lines.withColumn("shown", F.element_at(F.array(*map(F.lit, SHOWN)), (F.col("p_partkey") % len(SHOWN) + 1).cast("int")))
    for name, size in SIZES:
        shown = shown.withColumn(name, F.expr(size).cast("int"))
    return shown


DUCK_SIZES = f"""(select p_partkey, lines, quantity, shown, cols, lanes, cw, ch, margin, {SIZES[5][1]} as width, {SIZES[6][1]} as height from
    (select *, {SIZES[1][1]} as lanes, {SIZES[2][1]} as cw, {SIZES[3][1]} as ch, {SIZES[4][1]} as margin from (select *, {SIZES[0][1]} as cols, [{", ".join(map(repr, SHOWN))}][p_partkey % {len(SHOWN)} + 1] as shown from
    (select l_suppkey as p_partkey, count(*) as lines, cast(sum(trunc(l_quantity)) as bigint) as quantity from lineitem group by 1))))"""


def drawn(shown: str, lines: int, cols: int, lanes: int, cw: int, ch: int, margin: int, width: int, height: int) -> np.ndarray:
    """A picture, as INK and PIXEL have it in SQL."""
    y, x = np.mgrid[0:height, 0:width]
    between = lambda v, a, b: (v >= a) & (v < b)
    if shown == "panel":
        u, v = x + y // 5, y - x // 5
        ink = between(u, 60, 200) & between(v, 10, 110) & ~(between(u, 62, 198) & between(v, 12, 108))
    elif shown == "text":
        ink = between(x, 30, 130) & between(y, 40, 148) & (y % 18 < 8) & (x % 12 < 9)
    elif shown == "aslant":
        u, v = x - y // 12, y + x // 12
        ink = between(u, 50, 170) & between(v, 30, 138) & (v % 18 < 8) & (u % 14 < 9)
    elif shown == "blank":
        ink = np.zeros((height, width), bool)
    else:
        u, v = x - margin, y - margin
        ruled = (u % cw < 2) | (v % ch < 2)
        dots = between(u % cw, 10, 15) & between(v % ch, 12, 16 + lines % 2)
        ink = between(u, 0, cols * cw + 2) & between(v, 0, lanes * ch + 2) & (ruled | dots)
    if shown == "colour":
        return np.stack([np.where(ink, dark, 250 - 20 * c) for c, dark in enumerate((30, 20, 90))], axis=2).astype(np.uint8)
    return np.where(ink, *((225, 30) if shown == "dark" else (25, 235))).astype(np.uint8)


#: So many pictures are held at once.
PICTURES = 16


def with_pixels(batches):
    """Rows with their pictures' pixels, a few at a time, however many come at once."""
    given = ("shown", "lines", *(name for name, _ in SIZES))
    for batch in batches:
        for at in range(0, batch.num_rows, PICTURES):
            rows = batch.slice(at, PICTURES)
            made = [drawn(**row).tobytes() for row in rows.select(given).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(made, pa.binary())], [*rows.schema.names, "pixels"])


def pictures(spark, d):
    """A picture for each supplier (key, height, width, pixels); what it shows is told by the rest."""
    # a row here is a few numbers, and becomes a picture: as many tasks as a shuffle has, whatever the rows' size. By the key itself, rows lie together
    # already, and the planner leaves out this shuffle and puts the partitions of the one before together, down to a single task
    spread = sizes(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("p_partkey"))
    return spread.mapInArrow(with_pixels, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spread.schema) + ", pixels binary")


#: The step that makes a picture what cells and lines are looked for in.
BINARY = "grayscale; otsu_threshold; ensure_black_text_on_white"


def _levels(value: str) -> str:
    """SQL for the grey value of a place: channels weighed and rounded, where there are several."""
    at = lambda c: "(" + re.sub(r"\bc\b", str(c), value).replace("~", "//") + ")"
    return f"case when shown = 'colour' then round_even(0.114 * {at(0)} + 0.587 * {at(1)} + 0.299 * {at(2)}, 0) else {at(0)} end"


def _pixel_sql() -> str:
    """SQL for steps that a query can express, pixel by pixel: windows along rows and columns take what is there at the borders, which for least and
    greatest values is the same as repeated borders."""
    over = lambda pick, column, by, order, before, after: f"{pick}({column}) over (partition by key, {by} order by {order} rows between {before} preceding and {after} following)"

    def morph(table: str, pick: str, before: int, after: int) -> str:
        return f"(select * replace ({over(pick, 'v', 'y', 'x', before, after)} as v) from (select * replace ({over(pick, 'v', 'x', 'y', before, after)} as v) from {table}))"

    beside = "over (partition by key, y order by x)"
    below = "over (partition by key, x order by y)"
    triples = f"(select *, [coalesce(lag(v) {beside}, v), v, coalesce(lead(v) {beside}, v)] as t from g)"
    steps = {
        "grayscale": "g",
        "grayscale; invert": "(select * replace (255 - v as v) from g)",
        "grayscale; otsu_threshold": "(select g.* replace (case when v > level then 255 else 0 end as v) from g join otsu using (key))",
        "grayscale; ensure_black_text_on_white": "(select g.* replace (case when dark > 0.5 then 255 - v else v end as v) from g join darkness using (key))",
        "grayscale; thin_text_if_thick": f"(select t.* exclude (e) replace (case when dark >= 0.14 then e else v end as v) from (select g.*, thin.v as e from g join {morph('g', 'min', 1, 0)} thin using (key, i)) t join darkness using (key))",
        "grayscale; morph_erode": morph("g", "min", 1, 0),
        "grayscale; morph_dilate": morph("g", "max", 1, 0),
        "grayscale; morph_close": morph(morph("g", "max", 1, 1), "min", 1, 1),
        "grayscale; morph_open": morph(morph("g", "min", 1, 1), "max", 1, 1),
        "grayscale; median_blur": f"(select * exclude (t) replace (list_sort(coalesce(lag(t) {below}, t) || t || coalesce(lead(t) {below}, t))[5] as v) from {triples})",
    }
    parts = " union all ".join(f"select key, '{name}' as steps, any_value(height) as height, any_value(width) as width, cast(sum(v * (i % {images.MARKS} + 1)) as bigint) as mark from {rows} group by key" for name, rows in steps.items())
    return f"""with g as materialized (select key, height, width, i, x, y, cast({_levels(PIXEL)} as integer) as v from (select p_partkey as key, * exclude (p_partkey), i % width as x, i // width as y from (select *, unnest(range(0, width * height)) as i from {DUCK_SIZES}))),
    darkness as (select key, avg(case when v < 128 then 1.0 else 0.0 end) as dark from g group by key),
    levels as (select key, v, sum(n) over w as low, sum(n) over (partition by key) as total, sum(n * v) over w as below, sum(n * v) over (partition by key) as whole from (select key, v, count(*) as n from g group by 1, 2) window w as (partition by key order by v)),
    otsu as (select key, coalesce(arg_max(v, [low * (total - low) * (below / low - (whole - below) / (total - low)) ** 2, -v]) filter (where low < total), 0) as level from levels group by key)
    {parts}""", list(steps)


PIXEL_SQL, PIXEL_STEPS = _pixel_sql()


@query("i03_steps_by_pixels", PIXEL_SQL)
def i03(spark, d):
    """Steps that only compare, count or pick pixels, on every picture."""
    steps = F.explode(F.array(*[F.lit(s) for s in PIXEL_STEPS])).alias("steps")
    return images.marked(pictures(spark, d).select("p_partkey", "height", "width", "pixels", steps), "p_partkey", "steps")


@query("i01_sizes", f"""select p_partkey as key, step as steps, cast(case when step = 'resize_max_height' then least(height, 500) else greatest(height, 600) end as integer) as height,
    cast(case when step = 'resize_max_height' and height > 500 then round_even(width * (500.0::double / height), 0) when step = 'resize_min_height' and height < 600 then round_even(width * (600.0::double / height), 0) else width end as integer) as width
    from {DUCK_SIZES}, (values ('resize_max_height'), ('resize_min_height')) s(step)""")
def i01_sizes(spark, d):
    """Pictures that are too high or too low get a height of their own, and a width that keeps their shape."""
    steps = F.explode(F.array(F.lit("resize_max_height"), F.lit("resize_min_height"))).alias("steps")
    return images.marked(pictures(spark, d).select("p_partkey", "height", "width", "pixels", steps), "p_partkey", "steps").drop("mark")


@query("i01_image_steps")
def i01(spark, d):
    """Every image step on every picture."""
    steps = F.array(*[F.lit(s) for s in images.STEPS]).alias("steps")  # not a row for each: pixels would be sent again with every step
    return images.processed(pictures(spark, d).select("p_partkey", "height", "width", "pixels", steps), "p_partkey", "steps")


@query("i27_preset_pipelines")
def i27(spark, d):
    """The image steps of every preset."""
    return images.processed(pictures(spark, d).withColumn("steps", F.array(*[F.lit(p[-1]) for p in P.PRESETS if p[-1]])), "p_partkey", "steps")


@query("i23_grid_density", f"""select p_partkey as key, case when shown in ('panel', 'text', 'aslant', 'blank') then 0.0
    else (2.0 * (cols + 1) * (lanes * ch + 2) + 2.0 * (lanes + 1) * (cols * cw + 2) - 4.0 * (cols + 1) * (lanes + 1)
      + case when margin > 0 and height // 8 % 2 = 0 then 2 * (cols + 1) else 0 end + case when margin > 0 and width // 8 % 2 = 0 then 2 * (lanes + 1) else 0 end) / (width * height) end as density from {DUCK_SIZES}""")
def i23(spark, d):
    """The share of long lines in pictures made black and white: a table's lines, less where they cross; kernels of even sizes move lines on by one."""
    return images.processed(pictures(spark, d).withColumn("steps", F.lit(BINARY)), "p_partkey", "steps").select("key", "density")


@query("o12_error_precedence", """select event_id, case when event_id % 2 = 0 then 'auth_error' when event_id % 3 = 0 then 'quota_exceeded' when event_id % 5 = 0 then 'timeout' else 'generic_error' end as error,
    array_to_string(list_filter([case when event_id % 2 = 0 and event_id % 3 = 0 then 'quota_exceeded' end, case when event_id % 5 = 0 and (event_id % 2 = 0 or event_id % 3 = 0) then 'timeout' end], lambda x: x is not null), ',') as secondary from events""")
def o12(spark, d):
    from larder.sources.options import error_of

    classes = F.filter(F.array(F.expr("case when event_id % 5 = 0 then 'timeout' end"), F.expr("case when event_id % 3 = 0 then 'quota_exceeded' end"), F.expr("case when event_id % 2 = 0 then 'auth_error' end")), lambda c: c.isNotNull())
    e = table(spark, d, "events").select("event_id", error_of(classes).alias("e"))
    return e.select("event_id", "e.error", F.array_join("e.secondary", ",").alias("secondary"))


@query("f37_prompt", """select p_partkey, case when p_partkey % 3 = 0 then '' else 'Produto: "' || p_name || '"' || chr(10) end || '{"size":' || p_size || '}' || case when p_size % 2 = 0 then chr(10) || chr(10) || '--- Tabela Nutricional (apoio) ---' || chr(10) || p_type else '' end as prompt from part""")
def f37(spark, d):
    from larder.sources.options import prompt

    label, body = F.expr("case when p_partkey % 3 <> 0 then p_name end"), F.to_json(F.struct(F.col("p_size").alias("size")))
    return table(spark, d, "part").select("p_partkey", prompt(label, body, F.expr("case when p_size % 2 = 0 then p_type end")).alias("prompt"))


@query("p15_refusal_markers", """select doc_id, case when trim(text, E' \\n\\t\\r') = '' then false else regexp_matches(lower(text), 'não há|nao ha|nenhum ingrediente|texto fornecido') or (length(trim(text, E' \\n\\t\\r')) > 60 and not contains(text, ',')) end as refusal from documents""")
def p15(spark, d):
    from larder.sources.options import is_refusal

    return table(spark, d, "documents").select("doc_id", is_refusal(F.col("text")).alias("refusal"))


@query("p13_kept_tokens", "select c_custkey, w from (select c_custkey, unnest(['x', 'xy', cast(c_nationkey as varchar), cast(c_custkey as varchar) || 'a', c_mktsegment]) as w from customer) where length(w) >= 2 and not regexp_full_match(w, '[0-9]+')")
def p13(spark, d):
    from larder.functions.text import split_items

    joined = F.expr("concat('x,xy,', c_nationkey, ',', c_custkey, 'a,', c_mktsegment)")
    return table(spark, d, "customer").select("c_custkey", F.explode(split_items(joined)).alias("w"))


@query("w08_positions", "select p_partkey, cast(n - 1 as integer) as pos, w from (select p_partkey, unnest(range(1, len(s) + 1)) as n, unnest(s) as w from (select p_partkey, string_split(p_name, ' ') as s from part))")
def w08(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "w"))


@query("a18_keyword_total", """select conv_id, turn, cast((case when contains(' ' || w || ' ', ' de ') then 1 else 0 end) + (case when contains(' ' || w || ' ', ' the ') then 1 else 0 end) as integer) as hits from (select *, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as w from conversations)""")
def a18(spark, d):
    from larder.operators.cascade import keyword_hits

    return table(spark, d, "conversations").select("conv_id", "turn", keyword_hits(F.col("text"), ("de", "the"), 0).alias("hits"))


@query("s10_vocabulary", "select w as word, count(*) as n from (select unnest(string_split(p_name, ' ')) as w from part) group by w")
def s10(spark, d):
    """A vocabulary file made of the words of part names, read back."""
    from larder.streaming.operators import shared_folder

    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    folder = f"{shared_folder(spark)}/words"
    words.select(F.concat_ws("\t", "word", "n")).write.text(folder)
    return P.read_vocabulary(spark, folder)


@query("s15_external_text", "select p_partkey, case when p_partkey % 2 = 0 then upper(p_name) else p_name end as p_name from part")
def s15(spark, d):
    """A stand-in for an outside model, which gives nothing for some texts."""
    from larder.sources.options import external

    part = table(spark, d, "part").select("p_partkey", F.expr("case when p_partkey % 2 = 0 then p_name else concat('!', p_name) end").alias("p_name"))
    out = external(part, "p_name", lambda texts: [t.upper() if t[0] != "!" else None for t in texts])
    return out.withColumn("p_name", F.regexp_replace("p_name", "^!", ""))


@query("j06_not_revoked", "select event_id from events where event_id not in (select event_id from events where event_type = 'error')")
def j06(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    return history.delete(e, e.where("event_type = 'error'"), ["event_id"]).select("event_id")


@query("a17_dark_share", f"""select key, avg(case when {_levels(PIXEL)} < 128 then 1.0 else 0.0 end) as dark from
    (select p_partkey as key, *, i % width as x, i // width as y from (select *, unnest(range(0, width * height)) as i from {DUCK_SIZES})) group by key""")
def a17(spark, d):
    return images.processed(pictures(spark, d).withColumn("steps", F.lit("")), "p_partkey", "steps").select("key", "dark")


@query("r01_scan_page_with_total", """select event_id, k, total from (select event_id, ts, props ->> '$.k' as k from events where user_id = 8 order by ts desc, event_id limit 5), (select count(*) as total from events where user_id = 8)""")
def r01(spark, d):
    """A page of a user's scans as the route gives it: fields of the payload, and the total as a second aggregate."""
    mine = table(spark, d, "events").where("user_id = 8")
    total = mine.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    rows = find.page(mine.select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").alias("k")), [F.desc("ts"), F.asc("event_id")], 1, 5)
    return rows.join(total, "user_id").select("event_id", "k", "total")


@query("r02_product_with_children", """select barcode, name, coalesce(n, 0) as lines, summary from (select p_partkey as barcode, p_name as name from part) left join (select l_partkey as barcode, count(*) as n from lineitem group by 1) using (barcode)
    left join (select l_partkey as barcode, max(l_shipmode) as summary from (select l_partkey, l_returnflag as l_shipmode from lineitem where l_quantity > 45) group by 1) using (barcode)""")
def r02(spark, d):
    from larder.operators.lookup import with_children

    lines = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "barcode")
    parts = table(spark, d, "part").selectExpr("p_partkey as barcode", "p_name as name")
    once = with_children(parts, lines.groupBy("barcode").agg(F.count(F.lit(1)).alias("lines")), "barcode", "lines")
    both = with_children(once, lines.where("l_quantity > 45").groupBy("barcode").agg(F.max("l_returnflag").alias("summary")), "barcode", "summary")
    return both.withColumn("lines", F.coalesce("lines", F.lit(0)))


@query("i22_cells_and_cache_keys")
def i22(spark, d):
    return images.keyed(pictures(spark, d), "p_partkey", BINARY)


@query("i22_cell_boxes", f"""select p_partkey as key, cast(j * cols + i as integer) as cell, cast(i * cw + 3 as integer) as x, cast(j * ch + 3 as integer) as y, cast(cw - 4 as integer) as w, cast(ch - 4 as integer) as h
    from (select *, unnest(range(0, cols)) as i from (select *, unnest(range(0, lanes)) as j from {DUCK_SIZES} where shown in ('table', 'dark', 'tall')))""")
def i22_boxes(spark, d):
    """Cells of tables that fill their pictures, in reading order; where white space is around a table, its region holds all others."""
    return images.cells(pictures(spark, d), "p_partkey", BINARY)


@query("i26_overlays", f"""select p_partkey as key, cast(case when shown in ('table', 'dark', 'tall') then cols * lanes * ((cw - 1) * (ch - 1) - (cw - 5) * (ch - 5)) else 0 end as bigint) as painted from {DUCK_SIZES}""")
def i26(spark, d):
    """Pixels that the outlines of a picture's cells take: two wide, around each."""
    from larder.functions import overlays

    shown = pictures(spark, d)
    return overlays.overlays(shown, images.cells(shown, "p_partkey", BINARY).withColumnRenamed("key", "p_partkey"), "p_partkey").select("key", "painted")


@query("s04_files", f"""select p_partkey as key, case when p_partkey % 4 < 2 then height end as height, case when p_partkey % 4 < 2 then width end as width, p_partkey % 4 < 2 as same from {DUCK_SIZES}""")
def s04_files(spark, d):
    """Pictures to PNG files and back; of every four, one file is cut and one isn't of a picture."""
    from larder.functions import codecs

    content = F.expr("case key % 4 when 2 then substring(content, 1, octet_length(content) - 9) when 3 then cast('GIF89a' as binary) else content end")
    # a picture goes along with its file: a join by key would bring all pixels together, and the planner, which can't know their size, broadcasts them
    files = codecs.encoded(pictures(spark, d), "p_partkey", ["pixels"]).select("key", F.col("pixels").alias("drawn"), content.alias("content"))
    return codecs.decoded(files, "key").select("key", "height", "width", F.coalesce(F.col("pixels") == F.col("drawn"), F.lit(False)).alias("same"))


@query("s04_unreadable_images")
def s04(spark, d):
    """Pictures whose bytes don't fit their size give nulls."""
    cut = pictures(spark, d).withColumn("pixels", F.when(F.col("p_partkey") % 2 == 0, F.col("pixels")))
    return images.processed(cut.withColumn("steps", F.lit("otsu_threshold")), "p_partkey", "steps")


def event_stream(spark, d):
    from larder.streaming.operators import read_stream

    return read_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("t04_stream_first_of_key", "select distinct user_id, event_type from events")
def t04_stream(spark, d):
    from larder.streaming import operators as S

    first = S.first_of_key(event_stream(spark, d), ["user_id", "event_type"], "ts", "400 days")
    return S.collected(first.select("user_id", "event_type"), "first")


@query("t03_stream_windows", """select user_id, time_bucket(interval '1 day', ts) as window_start, count(*) as requests, count(*) > 3 as limited from events group by 1, 2
    having time_bucket(interval '1 day', ts) + interval '1 day' <= (select max(ts) from events)""")
def t03_stream(spark, d):
    """Windows that the watermark has passed."""
    from larder.streaming import operators as S

    counted = S.collected(S.window_counts(event_stream(spark, d), "user_id", "ts", "1 day", "0 seconds", 3), "windows")
    return counted.withColumn("window_start", F.to_timestamp_ntz(F.col("window_start").cast("string")))


@query("t02_stream_limiter")
def t02_stream(spark, d):
    from larder.streaming import operators as S

    return S.collected(S.limited(event_stream(spark, d), "user_id", "ts", 2, 3 * 86400.0), "limited")


@query("t01_stream_eviction", "select count(*) as kept from events where not ts < timestamp '2024-01-20'")
def t01_stream(spark, d):
    from larder.streaming import operators as S

    kept = S.collected(history.purge(event_stream(spark, d), "ts", "2024-01-20").select("event_id"), "kept")
    return kept.agg(F.count(F.lit(1)).alias("kept"))


@query("t01_stream_purge", "select event_id as token, epoch_us(ts) // 1000 + 10 * 86400000 as expires from events where epoch_us(ts) // 1000 + 10 * 86400000 <= (select epoch_us(max(ts)) // 1000 from events)")
def t01_purge(spark, d):
    """Tokens of ten days whose time was up at the last event."""
    from larder.streaming import operators as S

    return S.collected(S.purged(event_stream(spark, d), "user_id", "event_id", "ts", 10 * 86400.0), "purged")
