"""The registered queries of this subpackage, and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.llm import bpe, decontaminate, language, licenses, quality_classifier, quality_rules, sharding, simhash, sql, token_files, urls
from loomtab.llm.common import id_crc, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document counted, scored and judged."""
    documents = table(spark, sf_dir, "documents")
    return quality_rules.judge(documents, quality_rules.fit(documents, table(spark, sf_dir, "labels")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and place in it."""
    placed = sharding.documents_by_curve(spark, sf_dir)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest, the licence it is and those it refers to."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its probability of quality label 1."""
    scored = quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(id_crc(F.col("doc_id")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to files, and what the files hold."""
    path = token_files.scratch(spark)
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_digests(spark, path)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, and the item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three quarters of them."""
    documents = table(spark, sf_dir, "documents")
    held_out = language.held_out(F.col("doc_id"))
    found = language.identify(documents, language.learn(documents.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its group of near copies."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The rules that op10 applies: host and path prefix, and verdict.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rules and trees."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {"op1_quality_rules": op1_quality_rules, "op2_byte_bpe": op2_byte_bpe, "op3_hilbert_shards": op3_hilbert_shards, "op4_license_scan": op4_license_scan, "op5_quality_classifier": op5_quality_classifier, "op6_token_files": op6_token_files, "op7_decontaminate": op7_decontaminate, "op8_language": op8_language, "op9_simhash": op9_simhash, "op10_urls": op10_urls, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op3_hilbert_shards": sharding.oracle(), "op4_license_scan": licenses.oracle(), "op7_decontaminate": sql.DECONTAMINATE}
