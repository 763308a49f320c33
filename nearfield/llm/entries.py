"""The registered queries of the corpus operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import bpe, decontaminate, edit_fingerprint, jaccard_join, language, licenses, pii, repeats, shard, toxicity
from nearfield.llm.common import documents
from nearfield.llm.oracle import ORACLE_SQL as ORACLE_SQL


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return bpe.decode(ids, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.assign(documents(spark, sf_dir), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.get("starts", F.lit(0)).cast("long").alias("first_word"),
        F.get("starts", F.size("starts") - 1).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def _remainder(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op2_word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where(_remainder(4) != 2))
    return language.predict(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(_remainder(5) != 0))
    found = toxicity.predict(docs, model)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("hits").alias("n_hits"))


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove(documents(spark, sf_dir), passage=repeats.PASSAGE)
    covered = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", covered("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        covered("passages").alias("n_passage"),
    )


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.analyse(documents(spark, sf_dir))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long) as n_{k}") for k in pii.KINDS[:4]]
    return found.select(
        "doc_id", *counts, F.sha2(pii.spans_text("base"), 256).alias("base_sha256"), pii.spans_text("base", "secrets", "terms").alias("spans"),
        (F.size("base") + F.size("secrets")).cast("long").alias("n_entities"), F.size("terms").cast("long").alias("n_terms"),
    )


def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.links(documents(spark, sf_dir))


def op8_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.edited_copies(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_word_first_language, op3_byte_shards, op4_toxicity, op5_repeated_bytes, op6_personal_data, op7_chosen_path_join, op8_edit_fingerprint, op9_license_scan, op10_decontaminate)
}
