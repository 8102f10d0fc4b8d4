"""The corpus pipeline: each stage works on all that the one before it kept.

1. language ID: documents in no recognisable language go;
2. near-dedup: one document of each group stays;
3. decontamination: documents that quote a benchmark item go;
4. mixing: each document as often as its source's target takes it;
5. token output: ORC files of token ids, read back as an index.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loam.llm import decontaminate, langid, minhash, mixing, tokens
from loam.llm.common import saved, table

#: The stages before leave less of an executor's memory than a job of its own has.
TOKEN_CACHE, TOKENS_TOGETHER = 100_000, 1_000_000
#: Rows that a task reads, or hands to Python, at once: with texts of some kilobytes Spark's own numbers come to tens of megabytes each time.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.orc.columnarReaderBatchSize": "512"}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def in_batches(stage):
    """A stage whose session reads and hands on rows as BATCHES says, from then on: its result is worked out later."""

    @wraps(stage)
    def wrapped(spark, docs, sf_dir):
        for key, value in BATCHES.items():
            spark.conf.set(key, value)
        return stage(spark, docs, sf_dir)

    return wrapped


@in_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.recognised(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))


@in_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


@in_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@in_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@in_batches
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.encode_table(docs, public_tokenizers.path("byte_bpe_50k.json"), TOKEN_CACHE, TOKENS_TOGETHER)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mix_sources", mix_sources), ("token_output", token_output)]

#: Language ID, shingle sets and tokens are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), {key: spark.conf.get(key) for key in BATCHES}
    try:
        for name, stage in STAGES:
            docs = saved(stage(spark, docs, sf_dir), name)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return docs
