"""run() against plain Python, stage by stage over the whole small table, and odd rows."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = [(i, t) for i, t in docs if t and re.search(r"[^\W\d_]", t)]
    docs = [d for d, (i, c, _) in zip(docs, brute.jaccard(docs)) if i == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [d for d, r in zip(docs, brute.decontaminate(docs, items)) if not r[5]]

    hidden = brute.sanitised([t for _, t in docs])
    assert sum("[TERM]" in t for t in hidden) > 0
    expected = brute.bpe([(i, t) for (i, _), t in zip(docs, hidden)], public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", F.sha2("ids", 256), "decoded_sha256")
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected) and len(expected) > 50


def test_odd_rows(spark, tmp_path):
    rows = [(1, "the cat sat on the mat", "en", "s", 1), (1, "the cat sat on the mat", "en", "s", 1), (None, None, None, None, None), (2, "", "fr", None, 0), (3, "le chat noir ici", "fr", "s", 3), (4, "*** 12", None, "s", 3), (5, "x " * 30000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", F.lit(1)).withColumn("name", F.lit(2)).withColumn("terms", F.lit(3))
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        if name != "encoding":
            assert docs.columns == columns
    assert {r.doc_id for r in docs.collect()} == {1, 3, 5} and docs.count() == 3
