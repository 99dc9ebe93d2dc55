"""Sharding by extendible hashing (operator 6).

A document's key is a hash of its id. The directory has a bucket for each hash prefix; a bucket over the byte
limit, and only such a bucket, splits on the next bit. Sizes are gathered as a histogram of ``STEP`` more bits a
round: one pass finds, for every prefix of up to STEP bits, the shallowest bucket that fits; what is over the limit
at the round's last bit goes on to the next round. Histograms are pre-aggregated and stay DataFrames.

When all ``BITS`` bits are used up, rows that still share a bucket have the same id. They are told apart by a
second hash over a row's place, stored with the sizes, so that a hot id is split like any other bucket.

Defined cases: a null text has 0 bytes; a null id is an id of its own; a document larger than the limit gets a
bucket of its own, as far as hash bits go; repeated rows are placed each by itself; no rows, no shards; other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Written

STEP, ID_BITS, PLACE_BITS = 12, 48, 48
BITS = ID_BITS + PLACE_BITS
#: Directory entries (some 100 bytes each) that are broadcast; the first round has at most 2 ** STEP.
BROADCAST_ENTRIES = 200_000


def _bits(id_col: Column) -> Column:
    """48 hash bits of an id as a string of 0 and 1: the first 12 hexadecimal digits of its MD5."""
    digits = F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")), 1, ID_BITS // 4)
    return F.lpad(F.conv(digits, 16, 2), ID_BITS, "0")


def _small(kept: Written, *columns: str) -> DataFrame:
    """Broadcast if it has few entries; beyond it, both sides are shuffled."""
    frame = kept.frame.select(*columns) if columns else kept.frame
    return F.broadcast(frame) if kept.rows <= BROADCAST_ENTRIES else frame


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes): shard is the bucket's prefix as a string of bits."""
    place = F.lpad(F.substring(F.conv(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, 2), -PLACE_BITS, PLACE_BITS), PLACE_BITS, "0")
    sized = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"), F.concat(_bits(F.col(id_col)), place).alias("bits"))
    # written once, so that places stay as they are and texts aren't read again
    stored = Written(sized, "sized")
    open_rows = stored.frame
    found: list[DataFrame] = []
    for used in range(0, BITS, STEP):
        to = min(used + STEP, BITS)
        fine = open_rows.groupBy(F.substring("bits", 1, to).alias("prefix")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        depths = F.explode(F.sequence(F.lit(used + (used > 0)), F.lit(to))).alias("depth")
        each = fine.select("prefix", "b", "n", depths).select("prefix", "b", "n", "depth", F.expr("substring(prefix, 1, depth)").alias("shard"))
        sums = each.groupBy("depth", "shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("rows"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("rows") == 1) | ((F.lit(to) == BITS) & (F.col("depth") == BITS))
        buckets = Written(sums.where(fits).drop("rows"), "buckets")
        leaf = each.join(_small(buckets), ["depth", "shard"]).groupBy("prefix").agg(F.min(F.struct("depth", "shard", "shard_bytes")).alias("leaf"))
        entries = Written(leaf.select("prefix", "leaf.*"), "directory")
        keyed = open_rows.withColumn("prefix", F.substring("bits", 1, to))
        placed = keyed.join(_small(entries), "prefix").select("id", "bytes", "shard", "depth", "shard_bytes")
        found.append(placed)
        rest = keyed.join(_small(entries, "prefix"), "prefix", "left_anti").select("id", "bytes", "bits")
        if rest.isEmpty():
            break
        open_rows = rest
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id_col), "bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes")


#: The directory's rule in SQL: the shallowest prefix that fits. Sound while no bucket needs over 32 bits.
def oracle(limit: int, bits: int = 32) -> str:
    binary = " || ".join(f"substr('0000000100100011010001010110011110001001101010111100110111101111', 1 + 4 * (position(substr(h, {i}, 1) in '0123456789abcdef') - 1), 4)" for i in range(1, bits // 4 + 1))
    return f"""
    with sized as (select doc_id, coalesce(strlen(text), 0) as bytes, md5(coalesce(cast(doc_id as varchar), 'null')) as h from documents),
    keyed as (select doc_id, bytes, {binary} as bits from sized),
    each as (select doc_id, bytes, d as depth, substr(bits, 1, d) as shard from keyed, (select unnest(range(0, {bits + 1})) as d)),
    sums as (select depth, shard, sum(bytes) as shard_bytes, count(*) as n from each group by depth, shard),
    fits as (select doc_id, bytes, shard, depth, shard_bytes, row_number() over (partition by doc_id order by depth) as r
             from each join sums using (depth, shard) where shard_bytes <= {limit} or n = 1)
    select doc_id, cast(bytes as bigint) as bytes, shard, cast(depth as integer) as depth, cast(shard_bytes as bigint) as shard_bytes from fits where r = 1
    """
