"""Mixing sources to target weights by Pfair scheduling (operator 9), in DataFrame and SQL functions only.

Target weights are whole numbers; a source of weight a out of a total of d has the share a / d of the slots. Each
source's documents, in the order of a hash, are cut in blocks of ``block`` documents. A source's k-th block (from 0)
is released at slot floor(k d / a) and is due by slot ceil((k + 1) d / a). Of the blocks released, each slot takes the
one that is due first (ties: the larger weight, then the source that sorts first). As the shares add up to 1, this meets
every deadline, so that at any slot every source is less than one block off its target.

The schedule repeats exactly after d slots, so only these are simulated, as a fold in SQL. Sources of equal weight
have the same releases and deadlines and take turns, so the fold keeps one counter for each *distinct weight*: its
cost is d times the number of distinct weights, whatever the number of documents. No weight is rounded, capped or
merged with others. A source that runs out leaves its slots empty; no document is dropped or repeated.

Documents are numbered within their source, and sources within their weight, without gathering either: they are counted
by hash bucket, buckets' offsets are summed up, and numbering happens within buckets.

Defined cases: weights of a source that are given several times add up; null, zero and negative ones count as none, and
sources without a weight come after all slots (slot null); fractional weights are exact if they are whole multiples of
the smallest or of a power of ten down to a millionth, and otherwise rounded to millionths of their sum (below half of one they
count as none); a null source is a source of its own; a null id sorts first; repeated rows are
numbered one after another, in any order; an empty table gives no rows; texts aren't read unless whole rows are asked
for; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

BLOCK = 16
#: Hexadecimal digits of a hash by which rows are dealt out to buckets for numbering.
DIGITS = 4
#: A source's target weight is its number of documents to this power, so that small sources weigh more than they
#: hold, in whole numbers of which the largest source has so many.
TEMPERATURE, TOP = 0.5, 64
#: Fractional weights are taken in parts of so many.
PARTS = 1_000_000
#: Slots folded in one go before their results are put to the others.
RUN = 512


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _hash(value: Column) -> Column:
    return F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))


def tempered(docs: DataFrame, source: str = "source", power: float = TEMPERATURE, top: int = TOP) -> DataFrame:
    """(source, weight): whole-number target weights, in proportion to each source's number of documents to a power."""
    counts = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    share = F.pow(F.col("n") / counts.agg(F.max("n").alias("most")).scalar(), F.lit(power))
    return counts.select("source", F.greatest(F.lit(1), F.round(top * share)).cast("long").alias("weight"))


def _whole(weights: DataFrame) -> DataFrame:
    """(k, a): one row for each source that has a weight, a whole number."""
    w = weights.where("weight > 0").groupBy(_key(F.col("source")).alias("k")).agg(F.sum("weight").alias("a"))
    if not isinstance(weights.schema["weight"].dataType, IntegralType):
        # of some units, the first of which all weights are whole multiples; a few numbers come to the driver
        least, total = w.agg(F.min("a").cast("double"), F.sum("a").cast("double")).first()
        units = [1.0, *([least] if least else []), *(10.0**-i for i in range(1, 7))]
        is_whole = w.agg(*[F.max(F.abs(F.col("a") / u - F.round(F.col("a") / u)) > 1e-9 * F.col("a") / u) for u in units]).first()
        unit = next((u for u, off in zip(units, is_whole) if off is False), (total or 1.0) / PARTS)
        w = w.withColumn("a", F.round(F.col("a") / unit))
    return w.select("k", F.col("a").cast("long").alias("a")).where("a > 0")


def numbered(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the place (from 0) of each row within its group, in the order of the hash of ``value`` and then itself.
    Groups may be of any size: rows are numbered within hash buckets, whose offsets come from counts. Group columns aren't null."""
    base = df.withColumn("_h", _hash(F.col(value))).withColumn("_b", F.substring("_h", 1, DIGITS))
    counts = base.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_c", F.substring("_b", 1, DIGITS // 2))
    # offsets in two steps, so that neither has more rows of a group together than a hash has values of half the digits
    upto = lambda *by: Window.partitionBy(*group, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    coarse = counts.groupBy(*group, "_c").agg(F.sum("_n").alias("_n")).select(*group, "_c", F.coalesce(F.sum("_n").over(upto("_c")), F.lit(0)).alias("_start"))
    fine = counts.select(*group, "_c", "_b", F.coalesce(F.sum("_n").over(upto("_c", "_b")), F.lit(0)).alias("_before"))
    offsets = fine.join(coarse, [*group, "_c"]).select(*group, "_b", (F.col("_before") + F.col("_start")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", F.asc_nulls_first(value))) - 1
    return base.withColumn("_within", within).join(offsets, [*group, "_b"]).withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_h", "_b", "_within", "_before")


def one_period(sources: DataFrame) -> DataFrame:
    """(a, nth, slot, m, d) of ``sources`` (k, a): the nth block that goes to sources of weight a is in this slot; they are m, taking turns.

    Each slot is one step of a fold over the counters of the distinct weights.
    """
    classes = sources.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    listed = classes.agg(F.reverse(F.array_sort(F.collect_list(F.struct("a", "m")))).alias("c"), F.sum(F.expr("a * m")).cast("long").alias("d")).where("d > 0")
    pick = """array_min(transform(st.done, (n, i) -> if(n < c[i].a * c[i].m and ((n div c[i].m) * d) div c[i].a <= t,
              named_struct('due', ((n div c[i].m + 1) * d + c[i].a - 1) div c[i].a, 'i', i), null))).i"""
    slot = f"""transform(array({pick}), p -> named_struct('done', transform(st.done, (n, i) -> if(i = p, n + 1, n)), 'picks', concat(st.picks, array(p))))[0]"""
    none = "cast(array() as array<int>)"
    run = f"""aggregate(sequence(t0, least(t0 + {RUN}, d) - 1), named_struct('done', all.done, 'picks', {none}), (st, t) -> {slot})"""
    step = f"""transform(array({run}), r -> named_struct('done', r.done, 'picks', concat(all.picks, array(r.picks))))[0]"""
    start = f"named_struct('done', transform(c, x -> 0L), 'picks', cast(array() as array<array<int>>))"
    folded = listed.select("c", "d", F.posexplode(F.expr(f"flatten(aggregate(sequence(0L, d - 1, {RUN}L), {start}, (all, t0) -> {step}).picks)")).alias("slot", "i"))
    each = folded.select(F.expr("c[i].a").alias("a"), F.expr("c[i].m").alias("m"), "d", F.col("slot").cast("long").alias("slot"))
    return each.withColumn("nth", (F.row_number().over(Window.partitionBy("a").orderBy("slot")) - 1).cast("long"))


def schedule(docs: DataFrame, weights: DataFrame, block: int = BLOCK, id_col: str = "doc_id", source: str = "source", whole: bool = False) -> DataFrame:
    """(doc_id, source, block, slot, place, release, deadline), and with ``whole`` the input's row in struct ``row``.

    ``weights`` has source and weight; see the module's docstring for weights that aren't whole or are missing.
    """
    own = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").alias("src"), _key(F.col(f"`{source}`")).alias("k")]
    base = docs.select(*own, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []))
    rows = numbered(base, ["k"], "id", "n").withColumn("block", F.expr(f"n div {block}")).withColumn("place", F.expr(f"n % {block}"))
    known = _whole(weights)
    turns = numbered(known, ["a"], "k", "turn")
    period = one_period(known)
    # block b of a source is, in period b div a, the (b % a)th of its turns among sources of its weight
    slots = period.select("a", "m", "d", "nth", "slot")
    sizes = period.groupBy("a").agg(F.max("m").alias("m"), F.max("d").alias("d"))
    placed = rows.join(turns.join(sizes, "a"), "k", "left").withColumn("nth", F.expr("(block % a) * m + turn"))
    placed = placed.join(slots.select("a", "nth", F.col("slot").alias("s")), ["a", "nth"], "left")
    slot, release, deadline = F.expr("(block div a) * d + s"), F.expr("(block * d) div a"), F.expr("((block + 1) * d + a - 1) div a")
    out = [F.col("id").alias(id_col), F.col("src").alias(source), F.col("block").cast("long").alias("block"), slot.alias("slot"), F.col("place").cast("int").alias("place"), release.alias("release"), deadline.alias("deadline")]
    return placed.select(*out, *(["row"] if whole else []))


def mixed(docs: DataFrame, weights: DataFrame, block: int = BLOCK, id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` in scheduled order, for a writer that keeps the order of partitions and rows."""
    placed = schedule(docs, weights, block, id_col=id_col, source=source, whole=True)
    return placed.orderBy(F.asc_nulls_last("slot"), F.asc_nulls_last("block"), source, "place").select("row.*")


def oracle(block: int = BLOCK, power: float = TEMPERATURE, top: int = TOP) -> str:
    """Source by source and slot by slot up to the last block's slot, without periods or classes of equal weights."""
    return f"""
    with recursive c as (select coalesce('=' || source, '') as k, count(*) as n from documents group by 1),
    w as (select k, n, cast(greatest(1, round({top} * pow(n / (select max(n) from c), {power}))) as bigint) as a from c),
    s as (select *, cast((select sum(a) from w) as bigint) as d, row_number() over (order by a desc, md5(k), k) as i from w),
    l as (select list(a order by i) as al, max(d) as d, max(((n + {block - 1}) // {block} * d + a - 1) // a) as last from s),
    run(t, done, i, n) as (
      select cast(-1 as bigint), list_transform(al, lambda x: cast(0 as bigint)), cast(0 as bigint), cast(0 as bigint) from l
      union all
      select t, list_transform(done, lambda x, j: case when j = pick then x + 1 else x end), pick, done[pick] from (
        select t, done, list_min(list_transform(done, lambda x, j: case when (x * d) // al[j] <= t
                          then (((x + 1) * d + al[j] - 1) // al[j]) * 1000000 + j end)) % 1000000 as pick
        from (select run.t + 1 as t, run.done, l.al, l.d from run, l where run.t + 1 < l.last))),
    m as (select doc_id, source, coalesce('=' || source, '') as k, row_number() over (partition by source order by md5(cast(doc_id as varchar)), doc_id) - 1 as n from documents)
    select doc_id, source, cast(m.n // {block} as bigint) as block, run.t as slot, cast(m.n % {block} as integer) as place,
           cast((m.n // {block} * d) // a as bigint) as release, cast(((m.n // {block} + 1) * d + a - 1) // a as bigint) as deadline
    from m join s using (k) join run on run.i = s.i and run.n = m.n // {block} and run.t >= 0
    """
