"""Benchmark decontamination, with DataFrame operations only.

The windows of all benchmark items form a hash set that is broadcast, in blocks of at most `SET_LIMIT` windows. Each
rolling window's hash of a text is looked up in it and the window's words are compared with the item's there and then, so
that only the places of real hits leave the scan; the words that they cover and the items are put together by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import private, stable, word_array

#: Distinct windows that are broadcast together, with their words and items (some 50 MB); more take a scan for each block.
SET_LIMIT = 100_000


def windows_of(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(item, size, window, h) for each distinct window of an item: n consecutive words, or all of a shorter
    item's words. Items without words have none."""
    words = benchmark.select(F.col(id_col).cast("string").alias("item"), word_array(F.col(text_col)).alias("w")).where("size(w) > 0")
    spans = words.withColumn("size", F.least(F.size("w"), F.lit(n)))
    each = spans.select("item", "size", F.explode(F.expr("transform(sequence(0, size(w) - size), i -> slice(w, i + 1, size))")).alias("window"))
    return each.distinct().withColumn("h", _array_hash("window", "size", n))


def _hash_at(hashes: str, at: str, size: int) -> str:
    """SQL for the hash of `size` words from `at` on; an element past the end is null and is skipped."""
    return f"xxhash64({', '.join(f'get({hashes}, {at} + {k})' for k in range(size))})"


def _array_hash(window: str, size: str, n: int) -> Column:
    cases = " ".join(f"when {k} then {_hash_at('hs', '0', k)}" for k in range(1, n + 1))
    return F.expr(f"transform(array(transform({window}, x -> xxhash64(x))), hs -> case {size} {cases} end)[0]")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", set_limit: int = SET_LIMIT) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside an occurring window), n_items and items (sorted array
    of item ids as strings).

    Null and empty texts have no words and no hits; null item ids count as the item 'null'; rows with equal ids
    stay apart; items without words never occur; repeated items and windows count once. A text of any length is one row's
    array of words. An empty benchmark hits nothing, an empty table gives no rows.
    """
    found = windows_of(benchmark.withColumn(item_id, F.coalesce(F.col(item_id).cast("string"), F.lit("null"))), n, item_id, item_text)
    found = stable(found.groupBy("h", "size", "window").agg(F.array_sort(F.collect_set("item")).alias("items")))
    sizes = sorted(r[0] for r in found.select("size").distinct().collect())  # at most n values
    n_blocks = -(-found.count() // max(1, set_limit)) or 1
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if n_blocks > 1:
        texts = stable(texts)  # each block's scan must name the rows alike
    words = texts.select("row", "id", word_array(F.col("text")).alias("w"))
    windows = words.select("row", "id", "w", F.size("w").alias("n_words"), F.expr(_window_hashes(sizes)).alias("hashes"))
    # Outer, as Spark would else hash all windows once more to leave out texts without any; each has its first element.
    each = windows.select("row", "id", "w", "n_words", F.posexplode_outer("hashes").alias("pos", "h"))
    hits: DataFrame | None = None
    for block in range(n_blocks):
        some = found.where(F.pmod("h", F.lit(n_blocks)) == block) if n_blocks > 1 else found
        # Bounded by set_limit windows.
        some = F.broadcast(some.select(F.col("h").alias("set_h"), "size", "window", "items"))
        at = F.expr(_place(sizes))
        real = (F.col("pos") > 0) & (F.col("h") == F.col("set_h")) & (F.slice("w", at + 1, F.col("size")) == F.col("window"))
        met = each.join(some, real, "left")
        met = met.where((F.col("pos") == 0) | F.col("size").isNotNull()) if not block else met.where("pos > 0 and size is not null")
        first = F.col("pos") == 0
        met = met.select("row", F.when(first, F.col("id")).alias("id"), F.when(first, F.col("n_words")).alias("n_words"), F.when(~first, F.struct(at.alias("at"), "size")).alias("hit"), "items")
        hits = met if hits is None else hits.unionByName(met)
    # A document's rows come together, and only hits with its words' places, bounded by its length.
    rows = hits.groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_list("hit")).alias("hits"), F.collect_set("items").alias("items"))
    # Places in order: each adds the words that those before it haven't reached.
    covered = "aggregate(hits, struct(0L as n, 0 as till), (a, x) -> struct(a.n + greatest(0, x.at + x.size - greatest(a.till, x.at)) as n, greatest(a.till, x.at + x.size) as till), a -> a.n)"
    out = rows.select("id", "n_words", F.expr(covered).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items")


def _window_hashes(sizes: list[int]) -> str:
    """SQL for the hashes of all windows of `w`, size by size, after one element that stands for the text itself."""
    parts = [f"transform(if(size(w) >= {k}, sequence(0, size(w) - {k}), cast(array() as array<int>)), i -> {_hash_at('hs', 'i', k)})" for k in sizes]
    return f"transform(array(transform(w, x -> xxhash64(x))), hs -> concat({', '.join(['array(0L)', *parts])}))[0]"


def _place(sizes: list[int]) -> str:
    """SQL for the first word of the window at `pos`, whose size is known."""
    cases, before = "", "1"
    for k in sizes:
        cases += f" when {k} then pos - ({before})"
        before += f" + greatest(0, n_words - {k - 1})"
    return f"case size{cases} end" if cases else "pos"


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The documents in which no item's window occurs, with all their columns. Decisions are by text, so rows
    that share an id but not a text are told apart."""
    key, name = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), private(docs, "key")
    texts = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    hit = scan(texts, benchmark, n, "key", "text", **names).where("n_hit > 0").select(F.col("key").alias(name)).distinct()
    return docs.withColumn(name, key).join(hit, name, "left_anti").drop(name)
