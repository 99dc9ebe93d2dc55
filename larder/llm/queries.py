"""The ``opN_`` queries with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bpe, credentials, fim, media, mixing, neardup, negatives, records, sharding, topk, toxicity, unigram, urlrules
from larder.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

NEIGHBOURS, EVERY = 20, 20
SHARD_BYTES = 1 << 20
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.media_column(table(spark, sf_dir, "documents")), offsets=True)


def op2_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0, NEIGHBOURS)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.schedule(docs, mixing.tempered(docs))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan(table(spark, sf_dir, "documents"))


#: Operator 11: ids that are multiples of the first are anchors; labels of rows whose ids are multiples of the second are moved on by one.
ANCHOR, OFF = 50, 7


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % OFF == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % ANCHOR == 0, label)


def op12_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mpeg_audio, op2_norm_sorted_topk, op3_toxicity, op4_bpe, op5_trie_token_counts, op6_extendible_shards, op7_minhash, op8_url_rules, op9_pfair_mix, op10_secrets, op11_hard_negatives, op12_token_records, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_norm_sorted_topk": topk.oracle(NEIGHBOURS, EVERY),
        "op6_extendible_shards": sharding.oracle(SHARD_BYTES),
        "op7_minhash": neardup.oracle(2, 80),
        "op8_url_rules": urlrules.oracle(RULES),
        "op9_pfair_mix": mixing.oracle(),
        "op11_hard_negatives": negatives.oracle(ANCHOR, f"case when vec_id % {OFF} = 0 then (label + 1) % 10 else label end"),
        "op13_fill_in_middle": fim.oracle(),
    }
