"""The registered queries against plain Python, over whole small tables and odd rows."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

import os, sys
sys.path.insert(0, os.path.dirname(__file__))
import brute
from nearfield.llm import bpe, decontaminate, entries, licenses, shard

SF = "/root/testdata/sf0.001"

ODD = [
    (1, "Hello world, it's  two\tspaces \n\n and more 12ab ½ \x1c x"),
    (1, "Hello world, it's  two\tspaces \n\n and more 12ab ½ \x1c x"),
    (None, "no id MIT License"),
    (2, None),
    (3, ""),
    (4, " "),
    (5, "一二 \U0001f600\U0001f600 été 'S don't DON'T"),
    (6, "word " * 3000),
    (7, "x" * 3000),
    (8, "GNU General  Public-License mit license MIT license"),
    (9, "Kelvin k İstanbul"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    for name in ("id", "row", "w", "hs", "block", "number", "part", "h", "size", "shard", "key", "words"):
        df = df.withColumn(name, F.lit("x"))
    return df


def rows(df, n=None):
    return sorted((tuple(r)[:n] for r in df.collect()), key=repr)


def same(df, expected, n=None):
    assert rows(df, n) == sorted(expected, key=repr)


def test_bpe(spark, docs, odd):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    same(entries.op1_byte_bpe(spark, SF), brute.bpe(docs, path, public_tokenizers.PATTERN))
    out = bpe.decode(bpe.encode(odd, path, public_tokenizers.PATTERN), path)
    assert out.columns == ["doc_id", "ids", "decoded"]
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in out.collect()), key=repr) == sorted(((i, (t or "").encode()) for i, t in ODD), key=repr)
    got = out.select("doc_id", (F.octet_length("ids") / 4).cast("long"), F.sha2("ids", 256), F.sha2("decoded", 256))
    same(got, brute.bpe(ODD, path, public_tokenizers.PATTERN))
    assert bpe.decode(bpe.encode(odd.limit(0), path, public_tokenizers.PATTERN), path).count() == 0


def test_bpe_blocks(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode(spark.read.parquet(f"{SF}/documents.parquet"), path, public_tokenizers.PATTERN, block_chars=20_000)
    same(out.select("doc_id", (F.octet_length("ids") / 4).cast("long"), F.sha2("ids", 256)), [r[:3] for r in brute.bpe(docs, path, public_tokenizers.PATTERN)])


def test_shards(spark, docs, odd, tmp_path):
    df = entries.op3_byte_shards(spark, SF)
    same(df.select("doc_id", "size", "text_crc32", "shard", "slot"), brute.shards(docs))
    sizes = [r[0] for r in df.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * max(r.size for r in df.collect())
    same(shard.assign(odd, 4).select("doc_id", "size", "text_crc32", "shard", "slot"), brute.shards(ODD, 4))
    assert shard.assign(odd.limit(0)).count() == 0
    shard.write(spark.read.parquet(f"{SF}/documents.parquet"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(docs)


def test_decontaminate(spark, docs, odd):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    same(entries.op10_decontaminate(spark, SF), brute.decontaminate(docs, items))
    few = [(1, "hello WORLD it"), (None, "a b"), (3, None), (4, ""), (5, "word " * 12), (10, "License mit"), (11, "mit license mit")]
    table = spark.createDataFrame(few, "item_id long, text string")
    for limit in (decontaminate.SET_LIMIT, 0):
        out = decontaminate.scan(odd, table, set_limit=limit)
        got = out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256), F.col("n_hit") > 0)
        same(got, brute.decontaminate(ODD, few))
    assert decontaminate.scan(odd.limit(0), table).count() == 0
    assert decontaminate.scan(odd, table.limit(0)).where("n_hit > 0").count() == 0
    kept = decontaminate.remove(odd, table)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for (i, t), r in zip(ODD, brute.decontaminate(ODD, few)) if not r[5]), key=repr)


def test_licenses(spark, docs, odd):
    df = entries.op9_license_scan(spark, SF)
    same(df, brute.licenses(docs), 6)
    same(licenses.scan(odd).select("doc_id", "n_words", F.size("starts"), F.get("starts", F.lit(0)), F.get("starts", F.size("starts") - 1), F.array_join("base_labels", ",")), brute.licenses(ODD))
    assert licenses.scan(odd.limit(0)).count() == 0
    text = "x y Permission is hereby granted, free of charge, to any nice person obtaining a copy of this software and associated documentation files to deal in the Software"
    one = licenses.scan(spark.createDataFrame([(1, text), (2, "permission is hereby granted to no one")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert one[0].labels == ["mit-text"] and 0.6 <= one[0].score <= 1 and one[0].spans[0]["first"] == 2
    assert one[1].labels == [] and one[1].score == 0
    # Labels given by hand.
    cases = [
        ("Licensed under CC BY-NC 4.0", ["cc-by-nc-notice"]), ("licensed under cc by 4.0.", ["cc-by-notice"]), ("Licensed under CC BY-SA 4.0 and more", ["cc-by-sa-notice"]), ("Licensed under CC BY-ND 4.0", []),
        ("redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["agpl-text", "gpl"]),
        ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ["bsd-text"]),
    ]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(cases[r.doc_id][0], r.labels) for r in got] == cases


@pytest.mark.parametrize("name", list(entries.ORACLE_SQL))
def test_sql(spark, name):
    import glob

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = entries.QUERIES[name](spark, SF)
    expected = c.sql(entries.ORACLE_SQL[name])
    order = sorted(found.columns)
    assert sorted(expected.columns) == order
    plain = lambda rows, names: sorted((tuple(r[names.index(n)] for n in order) for r in rows), key=repr)
    assert plain(found.collect(), found.columns) == plain(expected.fetchall(), expected.columns)
