"""The corpus pipeline: five stages, each over all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's result as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm import bpe, credentials, mixing, neardup, toxicity
from larder.llm.common import Written, scratch, table

#: Near duplicates in the pipeline: shingles of five words, a similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80
#: Text in a block of the encoder.
ENCODED_BYTES = 12 << 20
#: Of a row's place, so many bits are its number in its file.
ROW_BITS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the cut; the classifier learns from the labels of ``sf_dir``. Null and empty texts are judged by
    the rate of label 1 alone; repeated rows are judged alike, and each stays or goes; an empty table gives no rows."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id. Rows without an id, and null and empty texts, stay; rows that repeat
    an id are judged text by text, and of rows that repeat both one stays; an empty table gives no rows."""
    return neardup.kept_rows(docs, SHINGLE, PERCENT)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts. Null and empty texts stay as they are; so do rows that repeat."""
    return credentials.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: sources interleaved to their target weights. A null source is a source; repeated rows
    each have a place; an empty table gives no rows."""
    return mixing.mixed(docs, mixing.tempered(docs))


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with the place ``at`` of each row: the number in its file's name, and its number in that file. Rows that aren't read from files are written first."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = Written(docs, "placed").frame
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"(\d+)", 1).try_cast("long"), F.lit(0))
    return docs.select("doc_id", "source", "text", (part * (1 << ROW_BITS) + F.col("_metadata.row_index")).alias("at"))


def _positions(rows: DataFrame) -> DataFrame:
    """(part, start): how many of the rows stand in the files before each file; a row a file."""
    counts = rows.groupBy(F.shiftright("at", ROW_BITS).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, slot, place, position) of each document, decoded from its ids again.

    Position, from 0, is where a row stands among all that the mixing stage wrote, in the order of files and of rows in them; rows in another order have others.
    Slot and place are the schedule's. They follow from ids and sources of the rows
    kept, so they are found again from these alone, by a schedule that no text goes through, and join the encoded rows by where each row stands in its file.
    Null and empty texts have no ids; null ids stay null; repeated rows each get a row and a place; an empty table gives no rows.
    """
    rows = _placed(docs)
    found = bpe.round_trip(rows, public_tokenizers.path("byte_bpe_50k.json"), id_col=("doc_id", "at"), block_bytes=ENCODED_BYTES)
    slots = mixing.schedule(rows.select("doc_id", "source", "at"), mixing.tempered(rows), whole=True)
    placed = found.join(slots.select(F.col("row.at").alias("at"), "slot", "place"), "at").withColumn("part", F.shiftright("at", ROW_BITS))
    position = F.col("start") + F.col("at").bitwiseAND((1 << ROW_BITS) - 1)
    return placed.join(F.broadcast(_positions(rows)), "part").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "slot", "place", position.alias("position"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express MinHash, Viterbi decoding or BPE; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and read again for the next; what a stage wrote on the way, and its predecessor's rows, are deleted then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            after = Written(stage(spark, docs, sf_dir), name).keep()
        if before is not None:
            before.drop()
        docs, before = after.frame, after
    return STAGES[-1][1](spark, docs, sf_dir)
