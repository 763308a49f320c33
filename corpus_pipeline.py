"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import bpe, decontaminate, jaccard_join, language, pii


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is told. The model is learnt from the rows whose language is given; null and empty texts and those without letters go,
    as do all where no language is given. Long texts are read whole, repeated rows stay; an empty table gives one."""
    return language.keep(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts at a Jaccard similarity of 0.8 or more on five words: the one of the least id, null last, then of the
    least hash of the text; of rows equal in both, one. Texts without words, null and empty ones included, are grouped with their copies only."""
    return jaccard_join.keep_one(docs)


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no window of ten words of a benchmark item occurs, long ones looked through to their end; repeated rows stay or go together.
    Null and empty texts stay, and all do where the benchmark is empty."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts, with placeholders for personal data, for secrets and for the terms that reveal it. Null and empty texts and repeated rows stay as they are."""
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids (little-endian unsigned 32-bit integers) and the hash of the bytes that they decode to, one row for each document;
    a null or empty text has no ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN)
    return bpe.decode(ids, path).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_texts),
    ("personal_data", hide_personal_data),
    ("encoding", encode),
]

#: SQL can't express the learnt language model nor the encoding; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows go to a folder of this run's own below the shared checkpoint folder."""
    from nearfield.llm.common import shared_folder

    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
