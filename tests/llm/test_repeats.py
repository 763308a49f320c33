import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import entries, repeats


def digest(df):
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", removed, F.size("removed"), F.sha2("kept", 256)).collect()), key=repr)


def texts(seed, alphabet, n):
    """Texts with copies, copied parts, parts within themselves, runs of one letter and edits."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.randrange(7)
        if kind == 0 and out:
            out.append(rng.choice(out))
        elif kind in (1, 2) and out:
            other = rng.choice(out)
            a = rng.randrange(len(other) + 1)
            out.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) + other[a : a + rng.randrange(200)] + "".join(rng.choice(alphabet) for _ in range(rng.randrange(60))))
        elif kind == 3 and out:
            other = list(rng.choice(out))
            for _ in range(rng.randrange(4)):
                other.insert(rng.randrange(len(other) + 1), rng.choice(alphabet))
            out.append("".join(other))
        elif kind == 4:
            out.append(rng.choice(alphabet) * rng.randrange(150) + "".join(rng.choice(alphabet) for _ in range(30)))
        else:
            out.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(300))))
    return list(enumerate(out))


@pytest.mark.parametrize("seed, alphabet, length", [(1, "abcdefghijklmnop", 40), (2, "ab", 40), (3, "aéß\U0001f600\0", 33), (4, "abc", 9)])
def test_random(spark, seed, alphabet, length):
    docs = texts(seed, alphabet, 150)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert digest(repeats.remove(df, length)) == sorted(brute.repeats(docs, length), key=repr)
    if seed == 1:
        assert digest(repeats.remove(df, length, hot=3)) == sorted(brute.repeats(docs, length), key=repr)


def test_chunks_and_parts(spark):
    docs = texts(7, "abcdef", 150)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert digest(repeats.remove(df, 40, chunk=64, together=8)) == sorted(brute.repeats(docs, 40), key=repr)


def test_merge():
    """Two sorted shards, merged, against a sort of all strings."""
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"\0ab") for _ in range(rng.randrange(30))) for _ in range(400)]
    group = np.array([rng.randrange(5) for _ in strings])
    shard = np.array([rng.randrange(3) for _ in strings])
    rank, common = np.zeros(400, np.int64), np.zeros(400, np.int64)
    for k in range(3):
        at = np.flatnonzero(shard == k)
        rank[at], common[at] = repeats.shard_order(group[at], [strings[i] for i in at], 32)
    order, lcp = repeats.merge(group, shard, rank, common, strings, 32)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group, strings))
    for k in range(1, 400):
        a, b = order[k - 1], order[k]
        if group[a] == group[b]:
            assert lcp[k] == len(os.path.commonprefix([strings[a], strings[b]]))


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = entries.op5_repeated_bytes(spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(brute.repeats(docs, 400))
    assert sorted((r.doc_id, r.n_passage) for r in got) == sorted((r[0], r[2]) for r in brute.repeats(docs, 256))


@pytest.mark.parametrize("options", [{}, {"hot": 3}, {"chunk": 64, "together": 8}])
def test_two_lengths(spark, options):
    docs = texts(11, "abcdefgh", 150)
    found = repeats.remove(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 60, passage=33, **options)
    assert digest(found) == sorted(brute.repeats(docs, 60), key=repr)
    short = found.select("doc_id", F.expr("aggregate(passages, 0, (n, s) -> n + s.end - s.start)"))
    assert sorted(tuple(r) for r in short.collect()) == sorted((r[0], r[2]) for r in brute.repeats(docs, 33))


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "x" * 1000), (3, "y" * 399), (3, "y" * 399), (4, "z" * 400), (4, "z" * 400), (5, "w" * 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for name in ("id", "k1", "k2", "spans", "anchor", "n", "kept"):
        df = df.withColumn(name, F.lit("x"))
    assert digest(repeats.remove(df)) == sorted(brute.repeats(docs, 400), key=repr)
    assert repeats.remove(df.limit(0)).count() == 0
