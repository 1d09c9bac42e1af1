"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import oracles
from touchline.llm.common import table
from touchline.llm.conversation_repair import damage, repair_conversations
from touchline.llm.decontamination import find_items
from touchline.llm.ngram_join import jaccard_components
from touchline.llm.packing import pack
from touchline.llm.periodic_runs import periodic_runs
from touchline.llm.pii_crf import pii_report, train_pii
from touchline.llm.quality_cnn import in_fold, score_quality, train_quality
from touchline.llm.quality_rules import quality_rules
from touchline.llm.sharding import shard_by_bytes
from touchline.llm.substring_dedup import remove_repeats
from touchline.llm.token_files import read_tokens, write_tokens
from touchline.llm.toxicity import score_toxicity, train_toxicity
from touchline.llm.url_filter import judge_urls

#: The contract's rules: host, path, action.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json").read())


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json").drop("ids")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_report(docs, train_pii(docs))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), damage=True, texts=False)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(*damage(table(spark, sf_dir, "conversations")))


_REGISTERED = [
    op1_quality_classifier,
    op2_sharding,
    op3_ngram_jaccard_join,
    op4_toxicity,
    op5_url_filters,
    op6_substring_dedup,
    op7_quality_rules,
    op8_token_ids,
    op9_packing,
    op10_decontamination,
    op11_pii,
    op12_periodic_runs,
    op13_conversation_repair,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _REGISTERED}
ORACLES: dict[str, str] = oracles.ORACLES
