import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import entries, jaccard_join

SF = "/root/testdata/sf0.01"
ODD = [(1, "a b c d e f g"), (2, "A b,c D e f g!"), (2, "A b,c D e f g!"), (None, "a b c d e f g"), (3, None), (4, ""), (5, "***"), (6, "***"), (7, "one two"), (8, "one two"), (9, "one two three"), (10, "w " * 9000), (None, None), (None, "quite alone here")]


def same(df, expected):
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=repr) == sorted(expected, key=repr)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(entries.op7_chosen_path_join(spark, SF), brute.jaccard(docs))


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    for name in ("id", "s", "k1", "n", "path", "label", "sketch", "class_id", "__text"):
        df = df.withColumn(name, F.lit("x"))
    same(jaccard_join.links(df), brute.jaccard(ODD))
    assert jaccard_join.links(df.limit(0)).count() == 0
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, (r.text or "")[:20]) for r in kept.collect()), key=repr) == sorted(
        [(1, "a b c d e f g"), (3, ""), (5, "***"), (7, "one two"), (9, "one two three"), (10, ("w " * 10)), (None, "quite alone here")], key=repr
    )


@pytest.fixture
def hot():
    """A group of 300 near copies, a passage that 200 other texts share, and plain texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    out = []
    for _ in range(300):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [" ".join([word() for _ in range(40)] + passage + [word() for _ in range(rng.randrange(4, 40))]) for _ in range(200)]
    out += [" ".join(word() for _ in range(50)) for _ in range(100)]
    rng.shuffle(out)
    return list(enumerate(out))


def test_hot_groups(spark, hot, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 20)
    monkeypatch.setattr(jaccard_join, "BLOCK", 50)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.links(spark.createDataFrame(hot, "doc_id long, text string")).collect()}
    expected = {i: (c, n) for i, c, n in brute.jaccard(hot)}
    found, there = sum(n for _, n in got.values()), sum(n for _, n in expected.values())
    assert all(got[i][1] <= expected[i][1] for i in expected) and found >= 0.99 * there > 10_000
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in expected.items()}


def test_widths():
    """Sets on both sides of a change of width share what they share, and few n-grams by chance."""
    assert [jaccard_join._width(n) for n in (0, 4_144, 4_145, 66_317, 66_318, 1 << 20, 1 << 24, 1 << 25)] == [4, 4, 5, 5, 6, 6, 7, 8]
    rng = np.random.default_rng(3)
    every = rng.integers(0, 1 << 64, 90_000, dtype=np.uint64)
    cuts = [(0, 4_000), (0, 4_500), (300, 5_000), (5_000, 70_000), (6_000, 72_000), (72_000, 76_000)]
    packed = [jaccard_join._packed(np.sort(every[a:b])) for a, b in cuts]
    sets = [jaccard_join._unpacked(x) for x in packed]
    sizes, todo = np.array([len(x) for x in sets]), ~np.tri(len(cuts), dtype=bool)
    assert sizes.tolist() == [b - a for a, b in cuts] and [x[0] for x in packed] == [4, 5, 5, 5, 5, 4]
    got = jaccard_join._shared_by_width(sets, np.array([x[0] for x in packed]), sizes, todo)
    for i, (a, b) in enumerate(cuts):
        for j, (c, d) in enumerate(cuts[:i]):
            assert abs(int(got[j, i]) - max(0, min(b, d) - max(a, c))) <= 2, (i, j)
            assert got[i, j] == 0


def test_runs():
    assert jaccard_join.runs_for(0.995, 0.8, 3) == 12
