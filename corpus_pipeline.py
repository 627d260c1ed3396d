"""From documents to token ids: quality rules, one document of each group of
near duplicates, secrets masked, sources mixed to their weights, BPE.

Every stage takes (spark, docs, sf_dir), docs having the columns of
``documents`` (and any others), and returns such a table; the last one returns
doc_id, ``ids`` and ``decoded``, the text that the ids stand for.

Null and empty texts fail the quality rules; given to a later stage they are
linked with nothing, hold no secret, have size 0 and are never taken by the
mix, and have no ids.  Rows equal in every column are one document's copies and
one stays; null ids are larger than all others.  Null sources are a source of
their own.  Texts of any length are handled whole; an empty table gives an
empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from papersieve.config import scratch_path
from papersieve.llm import bpe_codec, mixing, ngram_join, quality, secret_scan
from papersieve.llm.frames import read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the rules reject go."""
    return quality.passing(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each component stays."""
    return ngram_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: secrets in the texts are replaced; n_chars stays that of the
    document as it came."""
    return secret_scan.redact(docs, secret_scan.scan(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document as often as the mix takes it."""
    return mixing.taken_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token ids of every document, and the text they stand for."""
    return bpe_codec.encode_decode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: No SQL: fitted models, a 64-bit hashed join and seeded sampling decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the
    shared folder and read again, so a lost executor costs no earlier stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
