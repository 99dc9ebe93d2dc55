"""URL filters by a sort-merge range join (operator 8).

A host's canonical key is its labels in reverse, each followed by a dot, so that a host and all its subdomains are
one interval of keys. Rules open such intervals. Urls and rules are dealt out by key range and sorted; each task sweeps
them with a stack of the hosts whose rules are open: intervals nest, so what doesn't hold the next key any more is on
top. Each host on the stack keeps its rules' paths by length, so a url is looked at once, whatever the number of
paths: of every open host, its path's beginnings of those lengths are looked up.

A rule that begins in one range and goes on into others must be known there: each range's first key can lie inside
at most as many hosts as it has labels. Their rules are found by an equi-join with that key's beginnings (of the lengths
that rules' hosts have) and sorted in front of the range, so nothing is gathered on the driver.

Defined cases: a null url, or one without ``://``, has an empty host and path; of rules that fit, the longest
(host and path together, then the smaller text) wins; a url no rule fits gets ``default``; of a rule given several times
the smallest verdict counts; rules without a host count as none; repeated rows each get a row; null ids stay null; an
empty table gives no rows; the html and other columns aren't read. Hosts, paths and urls may be of any length. A task
holds the rules of one key's open hosts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Written, releasing

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://`` up to /, ?, # or the end, A-Z lower-cased; the path from there up to ? or #."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _reversed(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _with_rules_open(stored: DataFrame, rules: DataFrame) -> DataFrame:
    """``stored`` and, in front of each range (kind 0), the rules whose host the range's first key lies in or is. A rule that
    is in its range too is opened twice, which changes nothing."""
    firsts = stored.groupBy("part").agg(F.min("key").alias("first"))
    lengths = rules.agg(F.collect_set(F.length("key")).alias("n")).scalar()  # as many as rules' hosts have lengths
    cut = F.transform(F.filter("n", lambda n: n <= F.length("first")), lambda n: F.substring("first", F.lit(1), n))
    opened = firsts.withColumn("n", lengths).select("part", F.explode(cut).alias("key")).join(rules, "key")
    return stored.withColumn("kind", F.lit(1)).unionByName(opened.withColumn("kind", F.lit(0)), allowMissingColumns=True)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict). ``rules`` has host, path and verdict."""
    spark = pages.sparkSession
    known = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null")
    known = known.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    rule_rows = known.select(_reversed(F.col("host")).alias("key"), F.col("path"), F.concat("host", "path").alias("rule"), "verdict")
    host, path = host_and_path(F.col(url))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    id_kind = pages.schema[id_col].dataType.simpleString()
    mixed = urls.withColumn("key", _reversed(F.col("host"))).unionByName(rule_rows, allowMissingColumns=True)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # rules come first among equal keys; the salt spreads a hot key over ranges
    salted = mixed.withColumn("salt", F.when(F.col("rule").isNull(), F.xxhash64("id", "path")))
    ranged = salted.repartitionByRange(parts, F.asc("key"), F.asc_nulls_first("salt"))
    stored = Written(ranged.withColumn("part", F.spark_partition_id()), "urls")
    every = _with_rules_open(stored.frame, rule_rows)

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        stack: list[tuple[str, dict[int, dict[str, tuple[str, str]]]]] = []
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for key, i, h, p, rule, verdict, here in zip(*cols):
                if here != part:
                    part, stack = here, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if rule is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}))
                    stack[-1][1].setdefault(len(p), {})[p] = (rule, verdict)
                    continue
                best = (0, "", None, None)
                for _, by_length in stack:
                    for n, paths in by_length.items():
                        found = paths.get(p[:n]) if n <= len(p) else None
                        if found is not None and (best[2] is None or (-len(found[0]), found[0]) < best[:2]):
                            best = (-len(found[0]), found[0], *found)
                for column, value in zip(out, (i, h, p, best[2], best[3] if best[2] is not None else default)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(1).type), *(pa.array(c, pa.string()) for c in out[1:])], ["id", "host", "path", "rule", "verdict"])

    # each range together and sorted again: a file's rows come in the order they were written, but no plan promises it
    sorted_ = every.repartition("part").sortWithinPartitions("part", "kind", "key", F.asc_nulls_first("salt"))
    swept = sorted_.select("key", "id", "host", "path", "rule", "verdict", "part").mapInArrow(releasing(sweep), f"id {id_kind}, host string, path string, rule string, verdict string")
    return swept.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")


def oracle(rules: list[tuple[str, str, str]], default: str = DEFAULT) -> str:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
    with rest as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as r from pages),
    parsed as (select page_id, row_number() over () as k, translate(coalesce(regexp_extract(r, '^([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
                      coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') as path from rest),
    rules(h, p, v) as (values {listed}),
    fit as (select k, h || p as rule, v, row_number() over (partition by k order by length(h || p) desc, h || p) as n
            from parsed join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
    select page_id, host, path, rule, coalesce(v, '{default}') as verdict from parsed left join (select * from fit where n = 1) using (k)
    """
