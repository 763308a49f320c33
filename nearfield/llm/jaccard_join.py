"""Self-join of texts on the Jaccard similarity of their word n-grams, by chosen paths.

Texts with the same n-grams are one set. A set has T minwise tokens. A run starts at a root that holds all sets;
a node draws each of the T tokens with chance 1 / (T * similarity) by a hash of its path, and sends each set to a
child for each drawn token's value: sets that share tokens go the same way. Nodes of one set end; small ones are
compared pair by pair; large ones are split further, and what is still large at the greatest depth (sets that are
all alike) is compared in blocks. Runs are repeated until a pair just at the similarity is met with the target recall.

A pair that meets in several nodes is compared in the first of them only, so pairs are never written out: a
node gives each set's number of links and the least set of its linked ones, and the classes are put together
from those.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import MAP_BITS, bit_map, lean, partitions, private, slices, stable

N, SIMILARITY = 5, 0.8
#: Minwise tokens of a set, greatest depth of a path, sets in a node that is compared at once, sets in a block.
T, DEPTH, SMALL, BLOCK = 64, 3, 200, 1000
#: Tokens in a block, about: 12 MB as they are sent.
BLOCK_TOKENS = 2_000_000
RECALL = 0.995

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(64)]


#: Fixed random values of the bytes of words; of bytes together, so many are looked at.
_VALUES = np.random.default_rng(20240503).integers(1, 1 << 64, 256, dtype=np.uint64)
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15

#: For each byte of UTF-8: 0 if it stands between words, else the byte, A-Z in lower case.
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[ord("A") : ord("Z") + 1] += 32
_LOWERED[[c for c in range(128) if not re.match("[0-9a-z]", chr(_LOWERED[c]))]] = 0


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers))
    return out[0], out[1]


def word_hashes(data: np.ndarray, cuts: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte's place) of each word of texts that stand one after another: text i is data[cuts[i] : cuts[i + 1]].

    A word's hash is a polynomial of its bytes, which differences of running sums give for all words at once. Data goes in pieces;
    a word over an edge adds up.
    """
    hashes, places = [], []
    open_: tuple[int, int, int] | None = None  # hash, length and place of the word that reaches the last piece's end
    for start in range(int(cuts[0]), int(cuts[-1]), piece):
        end = min(start + piece, int(cuts[-1]))
        up, down = _powers(piece)
        low = _LOWERED[data[start:end]]
        inside = np.concatenate([[False], low != 0, [False]])
        edges = cuts[np.searchsorted(cuts, start) : np.searchsorted(cuts, end, "right")] - start
        fresh = np.zeros(len(inside), bool)
        fresh[edges] = True  # whether a text starts before this place of the piece
        first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | fresh[:-2]))
        last = np.flatnonzero(inside[1:-1] & (~inside[2:] | fresh[1:-1])) + 1
        sums = np.zeros(end - start + 1, np.uint64)
        np.cumsum(_VALUES[low] * up[: end - start], out=sums[1:])
        h = (sums[last] - sums[first]) * down[first]
        length, at = last - first, first + start
        if open_ is not None:
            if len(first) and first[0] == 0 and not fresh[0]:
                h[0] = (open_[0] + int(h[0]) * pow(_BASE, open_[1], 1 << 64)) & (1 << 64) - 1
                length[0], at[0] = length[0] + open_[1], open_[2]
            else:
                h, length, at = (np.concatenate([np.array([x], y.dtype), y]) for x, y in zip(open_, (h, length, at)))
            open_ = None
        if len(last) and last[-1] == end - start and end < cuts[-1]:
            open_ = int(h[-1]), int(length[-1]), int(at[-1])
            h, length, at = h[:-1], length[:-1], at[:-1]
        hashes.append(_mix(h + length.astype(np.uint64)))
        places.append(at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column, without copying them, and where its texts start and end there; null texts are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), cuts


def shingles(texts: pa.Array, n: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets of 64-bit hashes of word n-grams, sorted and one after another, and where each one starts and ends;
    a text of fewer words has one n-gram, of all its words."""
    data, cuts = text_bytes(texts)
    h, places = word_hashes(data, cuts, piece)
    first = np.searchsorted(places, cuts)
    n_words = np.diff(first)
    n_grams = np.where(n_words < n, np.minimum(n_words, 1), n_words - n + 1)
    starts = np.concatenate([[0], np.cumsum(n_grams)])
    grams = np.zeros(starts[-1], np.uint64)
    if len(h) >= n:
        every = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            every += h[i : len(h) - n + 1 + i] * _POWERS[i]
        left = np.repeat(first[1:], n_words)[: len(every)] - np.arange(len(every))  # words to the text's end
        grams[np.repeat(n_words >= n, n_grams)] = _mix(every[left >= n] + np.uint64(n))
    for i in np.flatnonzero((n_words > 0) & (n_words < n)):
        some = h[first[i] : first[i + 1]]
        grams[starts[i]] = _mix((some * np.array(_POWERS[: len(some)], np.uint64)).sum(keepdims=True) + np.uint64(len(some)))[0]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[starts[:-1][n_grams > 0]] = True
    return grams[new], np.concatenate([[0], np.cumsum(new)])[starts]


def _sketches(tokens: np.ndarray, ends: np.ndarray, together: int = 1 << 16) -> list[bytes | None]:
    """The high halves of each set's minwise hashes; sets that share one by chance are told apart when they are compared."""
    out = np.zeros((len(ends) - 1, T), np.uint32)
    filled = np.flatnonzero(np.diff(ends))
    at = 0
    while at < len(filled):
        start = ends[filled[at]]
        stop = max(at + 1, int(np.searchsorted(ends[filled], start + together)))
        some = filled[at:stop]
        part = tokens[start : ends[some[-1] + 1]]
        for i in range(T):
            out[some, i] = np.minimum.reduceat((part ^ _SEEDS[i]) * _M1, ends[some] - start) >> np.uint64(32)
        at = stop
    sizes = np.diff(ends)
    return [row.tobytes() if n else None for row, n in zip(out, sizes)]


def _keys(texts: pa.Array, tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sets' names, two longs each; a text without words is named by itself."""
    digests = [
        xxhash.xxh3_128_digest(tokens[a:b].tobytes() if b > a else b"text" + (texts[i].as_py() or "").encode()) for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist()))
    ]
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


#: Bytes of a hash that are sent to be compared: as many as two sets of this size or less can be told by, with 0.004 false
#: shared n-grams expected, whatever the size.
FALSE = 0.004


def _width(n: int) -> int:
    """4 up to 4,144 n-grams, 5 up to 66,317, 6 up to 1.06 million, 7 up to 17 million."""
    return next((w for w in range(4, 8) if n * n <= FALSE * 256**w), 8)


def _packed(tokens: np.ndarray) -> bytes:
    """The high bytes of the hashes, in planes, and how many bytes they have."""
    width = _width(len(tokens))
    return bytes([width]) + np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, 8 - width :] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<u8").ravel()


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """Runs after which a pair at the similarity has met with this chance at the depth: each token is drawn and shared
    with Poisson mean 1, so a pair goes on with chance 1 - exp(-p), where p is that of the levels below."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def _children(paths: np.ndarray, sketches: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child paths: of each path and sketch side by side, the drawn tokens."""
    drawn = _mix(paths[:, None] ^ (_SEEDS + np.uint64(1))[None, :]) < np.uint64(int(2**64 / (similarity * T)))
    row, i = np.nonzero(drawn)
    return row, _mix(paths[row] * _M2 + _mix(sketches[row, i] ^ _SEEDS[i]))


def links(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """(id, class_id, n_links, n_copies, n_shingles) for each row: class_id is the least id among all rows that are linked to it
    directly or through others; n_links counts the other rows at this similarity or more, n_copies those among them with
    the same n-grams (or, without words, the same text).

    Texts without words are linked to their copies only. A null text is an empty one. Ids need not be unique; a
    class of null ids alone has a null one. Pairs of equal sets are always found; a pair below that is missed with chance
    1 - recall at the similarity and far less above it.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def sketched(batches):
        for batch in slices(batches):
            tokens, ends = shingles(batch.column(1), n)
            keys = _keys(batch.column(1), tokens, ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.diff(ends), pa.int64()), pa.array(_sketches(tokens, ends), pa.binary())], ["id", "k1", "k2", "n", "sketch"]
            )

    rows = stable(source.mapInArrow(lean(sketched), f"id {id_type}, k1 long, k2 long, n long, sketch binary"))
    sets = rows.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = stable(sets.withColumn("s", F.monotonically_increasing_id()))
    nodes = _nodes(sets, similarity, runs_for(recall, similarity, DEPTH))
    counted = stable(_compared(source, sets, nodes, n, similarity))
    classes = _components(counted.where("s <> other").select("s", "other"))
    n_linked = counted.groupBy("s").agg(F.sum("links").alias("linked"))
    named = sets.drop("sketch").join(classes, "s", "left").join(n_linked, "s", "left").withColumn("label", F.coalesce("label", "s"))
    least = named.groupBy("label").agg(F.min("least").alias("class_id"))
    named = named.join(least, "label").select("k1", "k2", "class_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies"))
    return rows.select("id", "k1", "k2", "n").join(named, ["k1", "k2"]).select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies", F.col("n").alias("n_shingles"))


def _nodes(sets: DataFrame, similarity: float, runs: int) -> DataFrame:
    """(path, s, blocks) of the nodes to compare: each has two sets or more, and no two have the same sets."""
    roots = _mix(np.arange(1, runs + 1, dtype=np.uint64) * _M2)
    depth_paths = "path long, s long, n long"

    def from_roots(batches):
        for batch in batches:
            sketches = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, T).astype(np.uint64)
            s, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for root in roots:
                row, path = _children(np.full(len(s), root), sketches, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(s[row]), pa.array(n[row])], ["path", "s", "n"])

    def from_paths(batches):
        for batch in batches:
            sketches = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, T).astype(np.uint64)
            row, path = _children(batch.column(0).to_numpy().view(np.uint64), sketches, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), *(pa.array(batch.column(c).to_numpy()[row]) for c in (1, 2))], ["path", "s", "n"])

    tokens = sets.where("sketch is not null").select("s", "n", "sketch")
    level = tokens.mapInArrow(lean(from_roots), depth_paths)
    ends: DataFrame | None = None
    for depth in range(1, DEPTH + 1):
        level = stable(level)
        sizes = level.groupBy("path").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("s")).alias("x"), F.bit_xor(F.xxhash64("s", F.lit(7))).alias("y")).where("size > 1")
        last = depth == DEPTH
        # Nodes of the same sets are one.
        ended = (sizes if last else sizes.where(F.col("size") <= SMALL)).groupBy("size", "weight", "x", "y").agg(F.min("path").alias("path"))
        found = level.join(ended, "path")
        ends = found if ends is None else ends.unionByName(found)
        if last:
            break
        large = sizes.where(F.col("size") > SMALL).select("path")
        split = level.join(large, "path")
        if split.isEmpty():
            break
        level = split.join(tokens.select("s", "sketch"), "s").select("path", "s", "n", "sketch").mapInArrow(lean(from_paths), depth_paths)
    ends = stable(ends)
    first = ends.groupBy("size", "x", "y").agg(F.min("path").alias("path")).select("path")
    return ends.join(first, "path", "left_semi").select("path", "s", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_TOKENS)).cast("int").alias("blocks"))


def _compared(source: DataFrame, sets: DataFrame, nodes: DataFrame, n: int, similarity: float) -> DataFrame:
    """(s, other, links): a set's rows linked in a node, and the least set that it is linked to there or s itself."""
    nodes = stable(nodes)
    places = F.expr("transform(nodes, p -> struct(p.path as path, p.blocks as blocks, cast(pmod(xxhash64(p.path, s), p.blocks) as int) as block))")
    members = (
        nodes.groupBy("s").agg(F.collect_set(F.struct("path", "blocks")).alias("nodes"))
        .withColumn("places", places)
        .join(sets.drop("sketch", "least"), "s")
        .select("s", "k1", "k2", "copies", F.expr("transform(places, p -> p.path)").alias("paths"), F.expr("flatten(transform(places, p -> transform(sequence(0, p.blocks - 1), o -> struct(p.path as path, least(o, p.block) as a, greatest(o, p.block) as b, p.block as block))))").alias("groups"))
    )
    members = stable(members)
    chosen = source.sparkSession.sparkContext.broadcast(bit_map(members.select("k1")))

    def tokens(batches):
        """The sets that may be members: the map has a fixed size, the join by key is exact."""
        data = np.frombuffer(chosen.value, np.uint8)
        for batch in slices(batches):
            found, ends = shingles(batch.column(0), n)
            keys = _keys(batch.column(0), found, ends)
            bit = keys[:, 0] % MAP_BITS
            some = np.flatnonzero((data[bit >> 3] >> (bit & 7) & 1 > 0) & (np.diff(ends) > 0)) if len(data) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[some, 0]), pa.array(keys[some, 1]), pa.array([_packed(found[ends[i] : ends[i + 1]]) for i in some], pa.binary())], ["k1", "k2", "tokens"])

    texts = source.select("text").mapInArrow(lean(tokens), "k1 long, k2 long, tokens binary").groupBy("k1", "k2").agg(F.first("tokens").alias("tokens"))
    dealt = members.join(texts, ["k1", "k2"]).select("s", "copies", "paths", "tokens", F.explode("groups").alias("g")).select("g.*", "s", "copies", "paths", "tokens")
    dealt = dealt.repartition(partitions(source.sparkSession), "path", "a", "b").sortWithinPartitions("path", "a", "b", "s")

    def compared(batches):
        group, key = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != key:
                    yield from _compare(key, group, similarity)
                    group, key = [], row[:3]
                group.append(row[3:])
        yield from _compare(key, group, similarity)

    return dealt.mapInArrow(lean(compared), "s long, other long, links long")


def _shared(sets: list[np.ndarray], sizes: np.ndarray, todo: np.ndarray, columns: int = 1 << 16) -> np.ndarray:
    """m rows by m columns: how many tokens two sets share, where this is to do. Tokens are counted some columns at a time, as bits,
    so that memory is bounded whatever the sets' sizes."""
    m = len(sets)
    out = np.zeros((m, m), np.uint32)
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = counts[where] > 1
    column = (np.cumsum(counts > 1) - 1)[where[held]]
    owner = np.repeat(np.arange(m), sizes)[held]
    del values, where, counts, held
    order = np.argsort(column // columns, kind="stable")
    owner, column = owner[order], column[order]
    ends = np.searchsorted(column // columns, np.arange(1, (int(column[-1]) // columns if len(column) else -1) + 2))
    busy = np.flatnonzero(todo.any(axis=1))
    start = 0
    for k, end in enumerate(ends.tolist()):
        some = column[start:end] - k * columns
        width = (int(some.max()) // 64 + 1) * 64
        bits = np.zeros((m, width), bool)
        bits[owner[start:end], some] = True
        bits = np.packbits(bits, axis=1).view(np.uint64)
        for i in busy:
            js = np.flatnonzero(todo[i])
            out[i, js] += np.bitwise_count(bits[js] & bits[i]).sum(axis=1, dtype=np.uint32)
        start = end
    return out


def _shared_by_width(sets: list[np.ndarray], widths: np.ndarray, sizes: np.ndarray, todo: np.ndarray) -> np.ndarray:
    """As _shared, of sets whose hashes have unlike numbers of bytes: a pair is compared by the fewer of its two."""
    if (widths == widths[0]).all():
        return _shared(sets, sizes, todo)
    out = np.zeros(todo.shape, np.uint32)
    for width in np.unique(widths):
        now = todo & (np.minimum(widths[:, None], widths[None, :]) == width)
        some = np.flatnonzero(now.any(axis=0) | now.any(axis=1))
        if len(some):
            mask = np.uint64((1 << 64) - (1 << 64 - 8 * int(width)))
            at = np.ix_(some, some)
            out[at] += _shared([sets[i] & mask for i in some], sizes[some], now[at])
    return out


def _compare(key, group: list[tuple], similarity: float) -> Iterator[pa.RecordBatch]:
    """group: rows of block, s, copies, paths and tokens of a node's two blocks (or one block)."""
    if len(group) < 2:
        return
    path, a, b = key
    m = len(group)
    block, s, copies = (np.array([r[i] for r in group], np.int64) for i in range(3))
    sets = [_unpacked(r[4]) for r in group]
    sizes = np.array([len(x) for x in sets])
    # Pairs that meet in a node before this one are compared there.
    seen = np.zeros((m, m), bool)
    before: dict[int, list[int]] = {}
    for i, r in enumerate(group):
        for p in r[3]:
            if p < path:
                before.setdefault(p, []).append(i)
    for some in before.values():
        if len(some) > 1:
            seen[np.ix_(some, some)] = True
    if a != b:
        seen |= block[:, None] == block[None, :]
    seen |= np.tri(m, dtype=bool)
    short = np.minimum(sizes[:, None], sizes[None, :]) < similarity * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9
    todo = ~(seen | short)
    if not todo.any():
        return
    shared = _shared_by_width(sets, np.array([r[4][0] for r in group]), sizes, todo)
    linked, parent = np.zeros(m, np.int64), np.arange(m)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in np.flatnonzero(todo.any(axis=1)):
        js = np.flatnonzero(todo[i])
        both = shared[i, js].astype(np.int64)
        near = js[both >= similarity * (sizes[i] + sizes[js] - both) - 1e-9]
        linked[i] += copies[near].sum()
        linked[near] += copies[i]
        for j in near:
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)  # rows are in order of s
    at = np.flatnonzero(linked)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(s[at]), pa.array(s[[root(i) for i in at]]), pa.array(linked[at])], ["s", "other", "links"])


def _components(edges: DataFrame) -> DataFrame:
    """(s, label): the least set of each set's component. Labels go to neighbours and then jump to their own labels,
    so the rounds grow with the logarithm of a component's width."""
    both = stable(edges.unionByName(edges.select(F.col("other").alias("s"), F.col("s").alias("other"))).distinct())
    labels = stable(both.groupBy("s").agg(F.min("other").alias("o")).select("s", F.least("s", "o").alias("label")))
    while True:
        told = both.join(labels.select(F.col("s").alias("other"), F.col("label").alias("theirs")), "other").groupBy("s").agg(F.min("theirs").alias("theirs"))
        near = labels.join(told, "s").select("s", "label", F.least("label", "theirs").alias("now"))
        jumped = near.join(labels.select(F.col("s").alias("now"), F.col("label").alias("far")), "now", "left").select("s", "label", F.least("now", F.coalesce("far", "now")).alias("now"))
        jumped = stable(jumped)
        changed = not jumped.where("now <> label").isEmpty()
        labels = jumped.select("s", F.col("now").alias("label"))
        if not changed:
            return labels


def keep_one(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """One row of each class, with all its columns: that of the least id (null last), then of the least hash of the text. Of
    rows equal in both, one stays. Null and empty texts are alike; texts without words are in a class with their copies only.

    A row without links stays whatever the others do: a bit map of the linked rows' names, of a fixed size, lets those go
    straight through, and only the others meet the names to keep. Two names of one bit cost a shuffle of a row, no more.
    """
    name = private(docs, "name")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))
    named = docs.withColumn(name, key)
    classes = stable(links(named.select(F.col(name).alias("name"), F.col(text_col).alias("text")), n, similarity, "name", "text", recall).select("name", "class_id", "n_links").where("n_links > 0"))
    linked = docs.sparkSession.sparkContext.broadcast(bit_map(classes.select(F.xxhash64("name"))))

    @F.pandas_udf("boolean")
    def may_be_linked(h: pd.Series) -> pd.Series:
        data, bit = np.frombuffer(linked.value, np.uint8), h.to_numpy() % MAP_BITS
        return pd.Series(data[bit >> 3] >> (bit & 7) & 1 > 0) if len(data) else pd.Series(np.zeros(len(bit), bool))

    met = may_be_linked(F.xxhash64(name))
    kept = classes.where("name = class_id").select(F.col("name").alias(name)).distinct()
    # Of rows with a bit but without links none is among the classes; names tell them from those that go.
    gone = classes.select(F.col("name").alias(name)).distinct().join(kept, name, "left_anti")
    some = named.where(met).join(gone, name, "left_anti").dropDuplicates([name])
    return named.where(~met).unionByName(some).drop(name)
