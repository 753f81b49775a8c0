"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet and reads it again as the
next stage's input. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trackline.llm import decontaminate, near_dedup, piece_sampling, secret_scan, toxicity
from trackline.llm.common import stored, table

PIECES = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; the score is learned from the labelled documents of the stage."""
    return toxicity.remove(docs, docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return near_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no document goes."""
    return secret_scan.mask(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its sampled piece ids, their number, and whether decoding gives the text back."""
    return piece_sampling.pieces(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("pieces", to_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
