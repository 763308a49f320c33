"""Fingerprints under a randomised embedding of edit distance.

A walk copies characters of a text to an output: at step j it writes the character under it and moves on by one
or stays, as a random bit shared by all texts says for that step and character. Texts at a small edit distance
fall into step again soon after an edit, so their outputs are at a small Hamming distance. The walk starts anew
every SEGMENT characters; so all segments of many texts walk side by side. A fingerprint samples the output at shared
random places: 4 bits of the character there, 0 past its end.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters after which the walk starts anew, steps for them, and places sampled.
SEGMENT, STEPS, PLACES = 1024, 3072, 256
#: Characters that walk side by side.
TOGETHER = 4_000_000


@lru_cache(1)
def _bits() -> np.ndarray:
    """bits[j, c]: whether step j moves on from a character of class c; class 0, the end, never does."""
    bits = np.random.default_rng(20240501).integers(0, 2, (STEPS, 256), dtype=np.uint8)
    bits[:, 0] = 0
    return bits


@lru_cache(4096)
def _places(n: int) -> np.ndarray:
    """The sampled places of an output of n steps: those with the least hash, so that outputs of nearly the same
    length share nearly all their places. Beyond 2^22 steps a coarser grid of them is hashed."""
    at = np.arange(0, n, _grid(n), dtype=np.uint64)
    return np.sort(at[np.argpartition(_hashes(at), PLACES - 1)[:PLACES]]).astype(np.int64)


def _grid(n: int) -> int:
    grid = 1
    while n // grid > 1 << 22:
        grid *= 2
    return grid


def _hashes(at: np.ndarray) -> np.ndarray:
    h = (at + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _steps(chars: int) -> int:
    """Steps of the output of so many characters; short texts have a half, a quarter or an eighth of STEPS."""
    if chars > SEGMENT:
        return -(-chars // SEGMENT) * STEPS
    n = STEPS
    while n > STEPS // 8 and chars * 3 <= n // 2:
        n //= 2
    return n


def classes(text: str) -> np.ndarray:
    """A class from 1 to 255 for each code point; lone surrogates count like any other."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return ((points * np.uint32(2654435761) >> np.uint32(16)) % 255 + 1).astype(np.uint8)


def _walk(segments: np.ndarray) -> np.ndarray:
    """segments: rows of SEGMENT classes and a final 0. Output classes by step and row."""
    n, width = segments.shape
    flat, at = np.ascontiguousarray(segments).ravel(), np.arange(n, dtype=np.int64) * width
    out, bits = np.zeros((STEPS, n), np.uint8), _bits()
    for j in range(STEPS):
        here = out[j]
        np.take(flat, at, out=here, mode="clip")
        at += bits[j][here]
        if j % 256 == 255 and not here.any():
            break
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """Each text's fingerprint: its output's steps in hex, a colon, and a hex digit for each sampled place."""
    out: list[str] = [""] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    while order:
        some, chars = [], 0
        while order and (not some or chars + len(texts[order[-1]]) <= TOGETHER):
            chars += max(SEGMENT, len(texts[order[-1]]))
            some.append(order.pop())
        counts = [max(1, -(-len(texts[i]) // SEGMENT)) for i in some]
        firsts = np.concatenate([[0], np.cumsum(counts)])
        total = int(firsts[-1])
        rows = np.zeros((total, SEGMENT + 1), np.uint8)
        for k, i in enumerate(some):
            c = classes(texts[i])
            padded = np.zeros(counts[k] * SEGMENT, np.uint8)
            padded[: len(c)] = c
            rows[firsts[k] : firsts[k + 1], :SEGMENT] = padded.reshape(-1, SEGMENT)
        steps = [_steps(len(texts[i])) for i in some]
        slots = [_places(n) for n in steps]
        given = [np.zeros(PLACES, np.uint8) for _ in some]
        step = TOGETHER // SEGMENT  # a text longer than TOGETHER goes in turns
        for start in range(0, total, step):
            walked = _walk(rows[start : start + step])
            for k in range(len(some)):
                seg, j = np.divmod(slots[k], STEPS)
                seg += firsts[k]
                here = (seg >= start) & (seg < start + step)
                given[k][here] = walked[j[here], seg[here] - start]
        for k, i in enumerate(some):
            nibbles = np.where(given[k] == 0, 0, given[k] % 15 + 1)
            out[i] = f"{steps[k]:x}:{''.join('0123456789abcdef'[x] for x in nibbles)}"
    return out


def likeness(a: str, b: str) -> float:
    """From 0 to 1: the share of like digits at places that either output reaches. Of outputs of unlike length,
    the places of the longer one are compared; those past the shorter one's end count as unlike."""
    if a == b:
        return 1.0
    (n, x), (m, y) = ((int(p[0], 16), p[1]) for p in (a.split(":"), b.split(":")))
    if n > m:
        n, x, m, y = m, y, n, x
    u, v = (np.frombuffer(s.encode(), np.uint8) for s in (x, y))
    if n != m:
        places, own = _places(m), _places(n)
        shared = np.searchsorted(own, places)
        known = (shared < PLACES) & (own[np.minimum(shared, PLACES - 1)] == places)
        u = np.where(known, u[np.minimum(shared, PLACES - 1)], ord("0"))
        comparable = known | (places >= n)
        u, v = u[comparable], v[comparable]
    both = (u != ord("0")) | (v != ord("0"))
    return float((u == v)[both].mean()) if both.any() else 0.0


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) for each row; a null text is empty, and an empty one has digits 0 alone."""

    def made(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(fingerprints(texts), pa.string())], [id_col, "n_chars", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(made, f"`{id_col}` {kind}, n_chars long, fingerprint string")


#: Sampled places in a band.
WIDTH = 6


def bands_for(least: float, recall: float) -> int:
    """Bands of which a pair alike by `least` shares one at the chance of `recall`."""
    return max(1, math.ceil(math.log1p(-recall) / math.log1p(-(least**WIDTH)))) if least < 1 else 1


@lru_cache(4096)
def _levels(n: int) -> list[tuple[int, int, np.ndarray]]:
    """(grid, level, which of the sampled places): the places that are multiples of the grid and whose hash is under
    2^-level, of which no output of n steps lacks one. Outputs whose lengths differ by less than half have a level in common."""
    at, grid = _places(n), _grid(n)
    h = _hashes(at.astype(np.uint64))
    # The largest hash sampled bounds what is complete; if all places are sampled, all hashes are.
    dense = 0 if n // grid <= PLACES else math.ceil(64 - math.log2(float(h.max())))
    levels = {(grid, dense), (grid, dense + 1)}
    if grid > 1:
        levels.add((grid, max(15, dense)))
    if n // grid > 1 << 21:
        levels.add((2 * grid, max(15, dense)))
    return [(g, j, np.flatnonzero((at % g == 0) & (h <= np.uint64(2 ** (64 - j) - 1)))) for g, j in sorted(levels)]


@lru_cache(64)
def _orders(n: int, bands: int) -> np.ndarray:
    """For each row of each band, a random order of the places that depends on the place alone."""
    seeds = np.random.default_rng(20240502).integers(1, 1 << 63, bands * WIDTH, dtype=np.uint64)
    return _hashes(_places(n).astype(np.uint64)[None, :] ^ seeds[:, None])


def band_keys(fingerprint: str, bands: int) -> set[int]:
    """Keys of bands: WIDTH times the place that comes first, in an order of the row's own, among those that the output
    reaches, and its digit. Two outputs have a row in common at the chance of their likeness."""
    n, digits = int(fingerprint.split(":")[0], 16), np.frombuffer(fingerprint.split(":")[1].encode(), np.uint8)
    places, orders, out = _places(n), _orders(n, bands), set()
    for grid, level, some in _levels(n):
        some = some[digits[some] != ord("0")]
        if not len(some):
            continue
        first = some[orders[:, some].argmin(axis=1)].reshape(bands, WIDTH)
        rows = np.concatenate([places[first], digits[first]], axis=1).astype(np.int64)
        out.update(xxhash.xxh64_intdigest(f"{grid},{level},{k},".encode() + r.tobytes()) - (1 << 63) for k, r in enumerate(rows))
    return out


def candidates(prints: DataFrame, least: float = 0.6, recall: float = 0.95, id_col: str = "doc_id", fingerprint_col: str = "fingerprint") -> DataFrame:
    """(a, b, likeness) for pairs of fingerprints that share a band and are alike by `least` or more when compared
    whole; of the pairs alike by `least`, about `recall` are found, and more of those more alike. Equal fingerprints are one: a and
    b are the least ids of theirs. Outputs of unlike length meet in the places that both sample."""
    bands = bands_for(least, recall)
    one = prints.groupBy(F.col(fingerprint_col).alias("f")).agg(F.min(id_col).alias("id")).where("id is not null").withColumn("h", F.xxhash64("f"))

    def banded(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                some = batch.slice(start, 512)
                keys = [band_keys(f, bands) for f in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some.column(0).to_numpy(), [len(k) for k in keys])), pa.array([k for ks in keys for k in ks], pa.int64())], ["h", "band"])

    rows = one.select("h", "f").mapInArrow(banded, "h long, band long")
    met = rows.withColumnRenamed("h", "x").join(rows.withColumnRenamed("h", "y"), "band").where("x < y").select("x", "y").distinct()
    x, y = (one.select(F.col("h").alias(c), F.col("id").alias(f"i{c}"), F.col("f").alias(f"f{c}")) for c in "xy")

    @F.pandas_udf("double")
    def alike(x, y):
        return pd.Series([likeness(a, b) for a, b in zip(x, y)], dtype="float64")

    pairs = met.join(x, "x").join(y, "y").withColumn("likeness", alike("fx", "fy")).where(F.col("likeness") >= least)
    return pairs.where("ix <> iy").select(F.least("ix", "iy").alias("a"), F.greatest("ix", "iy").alias("b"), "likeness")


def edited_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each text beside
    its edited one, whose last half is replaced by the start of the next text in descending order of id (after
    the last: the first).

    Rows go once to range buckets of nearly equal counts; the first row of a bucket also goes to the end of the
    bucket before it, so that every row meets its next. Among equal ids and among null ids, which come last, the
    order is descending by the text's hash, and a hot id is cut by that too. A table of one row has itself as next.
    Ids are integers.
    """
    from nearfield.llm.common import partitions

    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("k", F.xxhash64("text"))
    n = max(2, partitions(docs.sparkSession))
    cuts = docs.select(F.percentile_approx(id_col, [k / n for k in range(1, n)], 10_000)).first()[0] or []  # n values
    cuts = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series, missing: pd.Series, u: pd.Series) -> pd.Series:
        """From the last to the first in order: null ids below 0, the others by the cuts, of which an id that fills several
        gets as many buckets."""
        low, high, u = np.searchsorted(cuts, ids.to_numpy(), "left"), np.searchsorted(cuts, ids.to_numpy(), "right"), u.to_numpy()
        return pd.Series(-np.where(missing.to_numpy(), np.floor(u * n) - n, low + np.floor(u * (high - low + 1))).astype(np.int32))

    # How far the hash is through its range, from 0 to 1.
    source = source.withColumn("u", F.expr("least(0.999999D, (k + 9223372036854775808D) / 18446744073709551616D)"))
    dealt = source.withColumn("bucket", bucket_of(F.coalesce("id", F.lit(0)).cast("long"), F.col("id").isNull(), "u"))
    # The head of each bucket, its row that comes first: one for each bucket, of which there are 2 n at most.
    heads = dealt.groupBy("bucket").agg(F.max(F.struct("id", "k")).alias("head")).orderBy("bucket").collect()
    ends = docs.sparkSession.createDataFrame([(h.bucket, h.head.id, h.head.k, heads[i - 1].bucket) for i, h in enumerate(heads)], "b int, i long, h long, to int")
    place = lambda bucket, extra: F.struct(bucket.alias("bucket"), F.lit(extra).alias("extra"))
    own = place(F.col("bucket"), 0)
    met = (F.col("b") == F.col("bucket")) & F.col("i").eqNullSafe(F.col("id")) & (F.col("h") == F.col("k"))
    copies = dealt.join(F.broadcast(ends), met, "left").select(
        "id", "text", "k", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, place(F.col("to"), 1)))).alias("place")
    )
    ordered = copies.select("id", "text", "k", "place.*").repartition(n, "bucket").sortWithinPartitions("bucket", "extra", F.desc_nulls_last("id"), F.desc("k"))
    ordered = ordered.drop("k")

    def made(batches):
        last = None  # (bucket, id, text), which waits for its next
        rows: list[tuple] = []
        chars = 0
        for batch in batches:
            for i, text, bucket, extra in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and last[0] == bucket:
                    rows.append((last[1], last[2], text))
                    chars += len(last[2]) * 2 + len(text)
                    last = None
                if not extra:
                    last = (bucket, i, text)
                if chars > 2 * TOGETHER:
                    yield _compared(rows, kind)
                    rows, chars = [], 0
        if rows:
            yield _compared(rows, kind)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(source.schema["id"].dataType)
    name = source.schema["id"].dataType.simpleString()
    out = ordered.mapInArrow(made, f"id {name}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


def _compared(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    edited = [text[: len(text) - len(text) // 2] + after[: len(text) // 2] for _, text, after in rows]
    distinct = list(dict.fromkeys([*(r[1] for r in rows), *(r[2] for r in rows), *edited]))
    found = dict(zip(distinct, fingerprints(distinct)))
    own, theirs = [found[r[1]] for r in rows], [found[e] for e in edited]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], kind),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
            pa.array(own, pa.string()),
            pa.array(theirs, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, theirs)], pa.float64()),
            pa.array([likeness(a, found[r[2]]) for a, r in zip(own, rows)], pa.float64()),
        ],
        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
