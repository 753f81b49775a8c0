"""One query for each training-data operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trackline.llm import decontaminate, fill_middle, language_id, line_dedup, lm_score, near_dedup, piece_sampling, secret_scan, spelling, token_counts, topk_search, toxicity, url_filter
from trackline.llm.common import table

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.report(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.report(table(spark, sf_dir, "embeddings"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_sentencepiece, op3_decontaminate, op4_url_filter, op5_language_id, op6_token_counts, op7_toxicity, op8_secret_scan, op9_topk_search, op10_lm_score, op11_spelling_variants, op12_line_dedup, op13_fill_in_middle)
}
ORACLE_SQL = {"op9_topk_search": topk_search.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op12_line_dedup": line_dedup.ORACLE, "op13_fill_in_middle": fill_middle.ORACLE}
