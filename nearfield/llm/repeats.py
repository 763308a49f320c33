"""Removal of repeated byte strings of a given length, by merging Burrows-Wheeler orders of shards.

Suffixes are indexed where the text itself says: the least hash of a short gram within each window of LENGTH
bytes is that window's anchor, so equal windows have anchors at the same offset, and all windows of an anchor are one
stretch of text around it. Only stretches whose anchor occurs elsewhere can hold a repeat, and those that are equal as a
whole are counted, not compared.

The rest go through the index. Each shard (a task of the scan) sorts its anchored suffixes, by anchor and then by the
bytes that follow; what precedes each suffix in that order is its Burrows-Wheeler symbol, and as windows begin before
their anchor, the stretches are put in order by their preceding bytes, backwards, in the same way. Shards are merged by
refining their interleave: suffixes alike in k symbols form a block, the next symbol deals each block's
suffixes out again stably, and a split tells the common prefix of the neighbours there. Blocks that come from one shard
are in order already, with known common prefixes, and are left alone. In the merged orders the suffixes with a common prefix of e bytes
are intervals, and a window with d bytes before its anchor is repeated if another stretch is in its interval for
LENGTH - d bytes after the anchor and in its interval for d bytes before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import MAP_BITS, bit_map, partitions, slices, stable

#: Length of what is removed, and of a repeated passage: 50 words of five letters have 300 bytes.
LENGTH, PASSAGE = 400, 256
#: Bytes of a text that are looked at together; distinct stretches of an anchor up to which it is merged in one task
#: (an anchor with more has its windows counted by hash); stretches that are merged together.
CHUNK, HOT, TOGETHER = 4_000_000, 20_000, 20_000

_BYTES = np.random.default_rng(20240502).integers(1, 2**63, 256, dtype=np.uint64)
_LOW = np.uint64(0xFFFFFFFF)


def _gram(length: int) -> int:
    k = 1
    while k * 2 <= min(32, length // 4):
        k *= 2
    return k


def _hashed(data: np.ndarray, k_most: int) -> np.ndarray:
    """The hash of each gram of k_most bytes."""
    k, h = 1, _BYTES[data]
    while k < k_most:
        h = h[:-k] * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) + h[k:]
        k *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _anchored(h: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """The anchors of windows of span grams: each one's place, and the first and last start of its windows. Among equal hashes the last
    place of a window is its anchor."""
    least, w = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64)), 1
    while w * 2 <= span:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if span > w:
        least = np.minimum(least[: w - span], least[span - w :])
    at = (_LOW - (least & _LOW)).astype(np.int64)
    cut = np.flatnonzero(np.diff(at)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
    return at[first], first, last


#: (hash, place, then the first and last start of the windows of each length, which is after the last where there are none)
Stretch = tuple[int, ...]


def stretches(data: bytes, lengths: tuple[int, ...], chunk: int = CHUNK) -> Iterator[Stretch]:
    """The anchors of a text's windows of one or two lengths, the longer one first, with all their windows. An anchor of a long window
    is also that of the short ones around it. A long text goes in chunks, which overlap so that each sees all windows of its anchors."""
    k, whole = _gram(lengths[-1]), np.frombuffer(data, np.uint8)
    for start in range(0, max(1, len(data)), chunk):
        base = max(0, start - lengths[0])
        part = whole[base : start + chunk + lengths[0]]
        if len(part) < lengths[-1]:
            continue
        h = _hashed(part, k)
        found: dict[int, list[int]] = {}
        for i, length in enumerate(lengths):
            if len(part) >= length:
                for place, first, last in zip(*(x.tolist() for x in _anchored(h, length - k + 1))):
                    if start <= place + base < start + chunk:
                        found.setdefault(place, [0, -1] * len(lengths))[2 * i : 2 * i + 2] = first + base, last + base
        hashes = h.view(np.int64)
        for place, ranges in found.items():
            yield (int(hashes[place]), place + base, *ranges)


def _region(stretch: Stretch, lengths: tuple[int, ...]) -> tuple[int, int]:
    """Where the windows of all lengths start and end."""
    some = [(stretch[2 + 2 * i], stretch[3 + 2 * i] + length) for i, length in enumerate(lengths) if stretch[2 + 2 * i] <= stretch[3 + 2 * i]]
    return min(a for a, _ in some), max(b for _, b in some)


def _context(data: bytes, stretch: Stretch, lengths: tuple[int, ...]) -> int:
    """Names a stretch's bytes and, with two lengths, which windows of each it has."""
    start, end = _region(stretch, lengths)
    if len(lengths) == 1:
        return xxhash.xxh3_64_intdigest(data[start:end]) - (1 << 63)
    place = stretch[1]
    shape = [x for i in range(len(lengths)) for x in ((stretch[2 + 2 * i] - place, stretch[3 + 2 * i] - place) if stretch[2 + 2 * i] <= stretch[3 + 2 * i] else (0, 0))]
    return xxhash.xxh3_64_intdigest(b"%d,%d,%d,%d," % tuple(shape) + data[start:end]) - (1 << 63)


def _set(data: bytes, h: int) -> int:
    bit = h % MAP_BITS
    return data[bit >> 3] >> (bit & 7) & 1


def symbols(strings: list[bytes], width: int) -> np.ndarray:
    """Rows of big-endian 8-byte symbols, filled up with zeros to `width` bytes."""
    width = -(-width // 8) * 8
    joined = b"".join([s.ljust(width, b"\0") for s in strings])
    return np.frombuffer(joined, ">u8").astype(np.uint64).reshape(len(strings), width // 8)


def merge(group: np.ndarray, shard: np.ndarray, rank: np.ndarray, common: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings by group and then by bytes, and each one's common prefix with the one before (0 between groups).

    rank and common are the place of a string in its shard's own order and its common prefix with the one before
    there; they are used where a block holds one shard's strings alone.
    """
    m = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, m)
    order = np.lexsort((rank, shard, group))
    new = np.ones(m, bool)  # whether a block starts here
    new[1:] = group[order[1:]] != group[order[:-1]]
    lcp = np.zeros(m, np.int64)
    table = symbols(strings, width)
    open_ = np.ones(m, bool)
    for k in range(table.shape[1] + 1):
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, m))
        of = shard[order]
        mixed = np.maximum.reduceat(of, starts) != np.minimum.reduceat(of, starts)
        now = np.repeat(mixed, lengths) & open_
        # A block of one shard, just closed: its order is the shard's, and so are the common prefixes within it.
        closing = np.flatnonzero(open_ & ~now & ~new)
        lcp[closing] = common[order[closing]]
        open_ &= now
        active = np.flatnonzero(open_)
        if not len(active):
            break
        block = np.cumsum(new)[active]
        own = order[active]
        symbol = table[own, k] if k < table.shape[1] else sizes[own].astype(np.uint64)  # equal to the end: the shorter one first
        turned = np.lexsort((rank[own], shard[own], symbol, block))
        own, symbol = own[turned], symbol[turned]
        order[active] = own
        split = np.zeros(len(active), bool)
        split[1:] = (symbol[1:] != symbol[:-1]) & (block[1:] == block[:-1])
        at = np.flatnonzero(split)
        if k < table.shape[1]:
            differ = symbol[at] ^ symbol[at - 1]
            same = np.zeros(len(at), np.int64)
            for byte in range(1, 8):
                same += differ < np.uint64(1) << np.uint64(64 - 8 * byte)
            lcp[active[at]] = 8 * k + same
        else:
            lcp[active[1:]] = np.where(block[1:] == block[:-1], sizes[own[:-1]], lcp[active[1:]])
            break
        new[active[at]] = True
    lcp[1:] = np.minimum(lcp[1:], np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    return order, lcp


def shard_order(group: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each string's place in the order of its shard, and its common prefix with the one before."""
    m = len(strings)
    order, lcp = merge(group, np.arange(m), np.zeros(m, np.int64), np.zeros(m, np.int64), strings, width)
    rank, common = np.empty(m, np.int64), np.empty(m, np.int64)
    rank[order] = np.arange(m)
    common[order] = lcp
    return rank, common


def repeated_windows(group: np.ndarray, after: tuple, before: tuple, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """m rows by length + 1 columns: whether the window with d bytes before the anchor occurs in another stretch.
    after and before are the merged orders and common prefixes of the bytes on either side of the anchor."""
    m = len(left)
    out = np.zeros((m, length + 1), bool)
    follow, precede = np.empty(m, np.int64), np.empty(m, np.int64)
    starts = starts_of(group, after[0]), starts_of(group, before[0])
    for d in range(min(int(left.max()), length) + 1):
        valid = (left >= d) & (right >= length - d)
        if valid.sum() < 2:
            continue
        follow[after[0]] = np.cumsum(starts[0] | (after[1] < length - d))
        precede[before[0]] = np.cumsum(starts[1] | (before[1] < d))
        at = np.flatnonzero(valid)
        both = follow[at] * (m + 1) + precede[at]
        turn = np.argsort(both, kind="stable")
        equal = both[turn][1:] == both[turn][:-1]
        out[at[turn[1:][equal]], d] = True
        out[at[turn[:-1][equal]], d] = True
    return out


def starts_of(group: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.ones(len(order), bool)
    out[1:] = group[order[1:]] != group[order[:-1]]
    return out


def _runs(flags: np.ndarray) -> list[list[dict]]:
    padded = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    change = np.diff(padded, axis=1)
    out: list[list[dict]] = [[] for _ in range(len(flags))]
    for (i, a), (_, b) in zip(np.argwhere(change == 1).tolist(), np.argwhere(change == -1).tolist()):
        out[i].append({"least": a, "most": b - 1})
    return out


RUNS = pa.list_(pa.struct([("least", pa.int32()), ("most", pa.int32())]))
RUNS_SQL = "array<struct<least: int, most: int>>"


def repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", hot: int = HOT, chunk: int = CHUNK, together: int = TOGETHER, passage: int | None = None) -> DataFrame:
    """(k1, k2, spans, passages): for each distinct text with bytes that a repeated string covers, by the text's two hashes, the sorted spans of
    (start, end) in bytes; passages are those of the shorter length, if one is asked for. Texts shorter than a length have none of it."""
    spark = docs.sparkSession
    lengths = (length,) if passage is None else (length, passage)
    if passage is not None and not (0 < passage <= length and _gram(passage) == _gram(length)):
        raise ValueError("a passage must be shorter than the length and have grams of the same size")
    ranges = [name for i in range(len(lengths)) for name in (f"first{i}", f"last{i}")]
    runs = [f"runs{i}" for i in range(len(lengths))]
    no_runs = [F.lit(None).cast(RUNS_SQL).alias(r) for r in runs]
    texts = keyed(docs, text_col).select("k1", "k2", "text")

    def contexts(batches):
        for batch in batches:
            anchors, found = [], []
            for text in batch.column(0):
                data = (text.as_py() or "").encode()
                for stretch in stretches(data, lengths, chunk):
                    anchors.append(stretch[0])
                    found.append(_context(data, stretch, lengths))
            yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(found, pa.int64())], ["anchor", "context"])

    counts = stable(texts.select("text").mapInArrow(contexts, "anchor long, context long").groupBy("anchor", "context").agg(F.count("*").alias("n")))
    by_anchor = counts.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum((F.col("n") == 1).cast("int")).alias("single")).where("total > 1")
    by_anchor = stable(by_anchor)
    whole = counts.where("n > 1").select("anchor", "context", F.lit(True).alias("all"), *no_runs)
    unequal = by_anchor.where("distinct > 1 and single > 0")
    maps = spark.sparkContext.broadcast((bit_map(by_anchor.select("anchor")), bit_map(unequal.select("anchor")), bit_map(unequal.where(F.col("distinct") > hot).select("anchor"))))

    def occurrences(batches):
        again = maps.value[0]
        for batch in batches:
            rows: list[list[int]] = [[] for _ in range(5 + len(ranges))]
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = (text.as_py() or "").encode()
                for stretch in stretches(data, lengths, chunk) if again else ():
                    if _set(again, stretch[0]):
                        for column, value in zip(rows, (k1, k2, stretch[0], _context(data, stretch, lengths), *stretch[1:])):
                            column.append(value)
            kinds = [pa.int64()] * 4 + [pa.int32()] * (1 + len(ranges))
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], ["k1", "k2", "anchor", "context", "place", *ranges])

    def shards(batches):
        """A shard is what a task reads, in parts of bounded size; its stretches come sorted in both directions."""
        some = maps.value[1]
        part, number = TaskContext.get().partitionId(), 0
        rows: dict[tuple[int, int], tuple[bytes, bytes]] = {}
        for batch in batches:
            for text in batch.column(0):
                data = (text.as_py() or "").encode()
                for stretch in stretches(data, lengths, chunk) if some else ():
                    h, place = stretch[:2]
                    if _set(some, h) and not (maps.value[2] and _set(maps.value[2], h)):
                        start, end = _region(stretch, lengths)
                        rows[h, _context(data, stretch, lengths)] = data[start:place][::-1], data[place:end]
                if len(rows) >= together:
                    yield shard_of(rows, (part << 24) + number)
                    rows, number = {}, number + 1
        if rows:
            yield shard_of(rows, (part << 24) + number)

    def shard_of(rows: dict, shard: int) -> pa.RecordBatch:
        keys = list(rows)
        before, after = [rows[k][0] for k in keys], [rows[k][1] for k in keys]
        _, group = np.unique(np.array([k[0] for k in keys], np.int64), return_inverse=True)
        numbers = [*shard_order(group, before, length), *shard_order(group, after, length)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([shard] * len(keys), pa.int64()),
                *(pa.array(x, pa.int32()) for x in numbers), pa.array(before, pa.binary()), pa.array(after, pa.binary()),
            ],
            ["anchor", "context", "shard", "rank_before", "common_before", "rank_after", "common_after", "before", "after"],
        )

    def merged(batches):
        """Stretches come in order of anchor: whole anchors are merged together up to a number of stretches."""
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(rows) >= together and row[0] != rows[-1][0]:
                    yield merge_of(rows)
                    rows = []
                if not rows or row[:2] != rows[-1][:2]:  # shards may have equal stretches
                    rows.append(row)
        if rows:
            yield merge_of(rows)

    def merge_of(rows: list[tuple]) -> pa.RecordBatch:
        anchor, _, shard, *numbers = (np.array([r[i] for r in rows], np.int64) for i in range(7))
        before, after = [r[7] for r in rows], [r[8] for r in rows]
        # Left-out equal stretches leave gaps in a shard's order; a common prefix over a gap is the least on the way, which
        # merge() is told by making such shards' strings new ones.
        _, group = np.unique(anchor, return_inverse=True)
        gapless = lambda rank: _without_gaps(shard, rank, group)
        one = merge(group, gapless(numbers[0]), numbers[0], numbers[1], before, length)
        two = merge(group, gapless(numbers[2]), numbers[2], numbers[3], after, length)
        left, right = (np.fromiter(map(len, x), np.int64, len(rows)) for x in (before, after))
        flags = [repeated_windows(group, two, one, left, right, n) for n in lengths]
        at = np.flatnonzero(np.any([f.any(axis=1) for f in flags], axis=0))
        return pa.RecordBatch.from_arrays([pa.array(anchor[at]), pa.array([rows[i][1] for i in at], pa.int64()), *(pa.array(_runs(f[at]), RUNS) for f in flags)], ["anchor", "context", *runs])

    def windows(batches):
        """Of anchors with too many stretches for one task: each window's hash, a row each."""
        hot_map = maps.value[2]
        for batch in batches:
            rows: set[tuple[int, ...]] = set()
            for text in batch.column(0):
                data = (text.as_py() or "").encode()
                for stretch in stretches(data, lengths, chunk):
                    if _set(hot_map, stretch[0]):
                        context = _context(data, stretch, lengths)
                        for i, n in enumerate(lengths):
                            rows.update((stretch[0], context, i, stretch[1] - s, xxhash.xxh3_64_intdigest(data[s : s + n]) - (1 << 63)) for s in range(stretch[2 + 2 * i], stretch[3 + 2 * i] + 1))
            listed = list(rows)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in listed], t) for i, t in enumerate(kinds)], ["anchor", "context", "kind", "d", "window"])

    tasks = partitions(spark)
    shipped = texts.select("text").mapInArrow(shards, "anchor long, context long, shard long, rank_before int, common_before int, rank_after int, common_after int, before binary, after binary")
    ordered = shipped.repartition(tasks, "anchor").sortWithinPartitions("anchor", "context", "shard")
    schema = ", ".join(f"{r} {RUNS_SQL}" for r in runs)
    found = whole.unionByName(ordered.mapInArrow(merged, f"anchor long, context long, {schema}").withColumn("all", F.lit(False)))
    if maps.value[2]:
        each = stable(texts.select("text").mapInArrow(windows, "anchor long, context long, kind int, d int, window long").distinct())
        twice = each.groupBy("anchor", "kind", "d", "window").count().where("count > 1").drop("count")
        run = lambda i: F.collect_list(F.when(F.col("kind") == i, F.struct(F.col("d").alias("least"), F.col("d").alias("most")))).alias(f"runs{i}")
        found = found.unionByName(each.join(twice, ["anchor", "kind", "d", "window"]).groupBy("anchor", "context").agg(F.lit(False).alias("all"), *map(run, range(len(lengths)))))
    # A stretch that is equal to another as a whole needs no runs.
    found = found.groupBy("anchor", "context").agg(F.max("all").alias("all"), *(F.first(r, ignorenulls=True).alias(r) for r in runs))
    met = texts.mapInArrow(occurrences, "k1 long, k2 long, anchor long, context long, place int, " + ", ".join(f"{r} int" for r in ranges)).distinct()
    spans = [
        F.expr(f"if(all, if(first{i} <= last{i}, array(struct(first{i} as start, last{i} + {n} as end)), null), transform(runs{i}, r -> struct(place - r.most as start, place - r.least + {n} as end)))").alias(f"spans{i}")
        for i, n in enumerate(lengths)
    ]
    covered = met.join(found, ["anchor", "context"]).select("k1", "k2", *spans)
    gathered = [F.array_sort(F.flatten(F.collect_list(f"spans{i}"))).alias(name) for i, name in zip(range(len(lengths)), ("spans", "passages"))]
    none = [F.expr("cast(null as array<struct<start: int, end: int>>)").alias("passages")] if passage is None else []
    return covered.groupBy("k1", "k2").agg(*gathered).select("*", *none)


def _without_gaps(shard: np.ndarray, rank: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Names of runs of strings that follow one another in a shard's order within a group."""
    order = np.lexsort((rank, shard))
    s, r, g = shard[order], rank[order], group[order]
    new = np.ones(len(order), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1] + 1) | (g[1:] != g[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """With the text, null as empty, and two hashes that name it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select("*", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), *([] if text_col == "text" else [text.alias("text")]))


def remove(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, chunk: int = CHUNK, together: int = TOGETHER, passage: int | None = None) -> DataFrame:
    """(id, n_bytes, removed, kept, passages) for each row: the maximal spans of (start, end) in bytes that strings of the length
    cover which also start elsewhere, in any text or the same one, and the bytes that are left. passages are the spans of strings of a
    shorter length, which are told but not removed; without one there are none.

    A null text is empty. Copies count as elsewhere, so a text of enough bytes with a copy is removed whole, in both.
    Rows with equal or null ids stay rows of their own. A text of any length is read whole, in chunks.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = repeats(source, length, "text", hot, chunk, together, passage)
    id_type = source.schema["id"].dataType.simpleString()

    def cut(batches):
        for batch in slices(batches):
            sizes, removed, kept, passages = [], [], [], []
            for text, some, shorter in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data, joined = (text.as_py() or "").encode(), _joined(some)
                edges = [0, *(x for s in joined for x in (s["start"], s["end"])), len(data)]
                sizes.append(len(data))
                removed.append(joined)
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                passages.append(_joined(shorter))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, SPANS), pa.array(kept, pa.binary()), pa.array(passages, SPANS)], [id_col, "n_bytes", "removed", "kept", "passages"]
            )

    joined = keyed(source, "text").join(spans, ["k1", "k2"], "left").select("id", "text", "spans", "passages")
    span = "array<struct<start: int, end: int>>"
    return joined.mapInArrow(cut, f"`{id_col}` {id_type}, n_bytes long, removed {span}, kept binary, passages {span}")


def _joined(spans: list[dict] | None) -> list[dict]:
    """Sorted spans as the maximal ones that they cover."""
    out: list[dict] = []
    for s in spans or ():
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
