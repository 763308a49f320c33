"""Personal data, and the terms that give it away.

Patterns find the protected entities, and values that are assigned to a name and hold much information are secrets. The corpus then says which terms reveal them: of the texts with a term,
how many have the entity near it, against the entity's share of all texts. Terms past both disclosure
thresholds are found wherever they stand. Candidate terms come from the entities' surroundings; bit maps of
fixed size let further scans count the texts that have them, a part of the texts first, and a last one find those past the thresholds,
and joins by term settle which are real, so that nothing that grows with the corpus is sent to all tasks.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import MAP_BITS, bit_map, lean, private, slices, stable

KINDS = ["email", "ip", "card", "phone", "secret", "term"]
#: Words on either side of an entity whose relation to it is measured, and the letters that they have at least.
NEAR, LETTERS = 8, 4
#: Disclosure thresholds: share of a term's texts that have the entity, and bits of evidence that this is no chance.
SHARE, BITS = 0.5, 6.0
#: Bits that an assigned value holds at least to be a secret: its length times the entropy of its characters.
SECRET_BITS = 64.0
#: Of a pair in fewer distinct texts than FEW, the share is smoothed: PRIOR of a text with the term but not the entity is added.
FEW, PRIOR = 5, 0.5
#: One of so many parts of the texts, by their hash, is counted first.
PARTS = 16

_domain = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+").match
_ip = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}").finditer
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_digit = re.compile(r"[0-9]").search
_assigned = re.compile(r"[=:]\s{0,8}[\"']?([A-Za-z0-9+/_-]{16,}+)").finditer
_word = re.compile(r"[^\W\d_]+").finditer
_words = re.compile(r"[^\W\d_]+").findall
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches, found from their @: before it stands the run of local characters, as far back as the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _domain(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by start and then kind as listed; code points, end exclusive."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _digit(text):
        out += [("ip", m.start(), m.end()) for m in _ip(text) if all(_small(p) for p in m[0].split("."))]
        for m in _card(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _phone(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=_order)


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    """Values after = or : that are too random to be words: letters and digits whose own information reaches SECRET_BITS."""
    if not text or ("=" not in text and ":" not in text):
        return []
    return [("secret", m.start(1), m.end(1)) for m in _assigned(text) if _digit(m[1]) and not m[1].isdigit() and _bits(m[1]) >= SECRET_BITS]


def _bits(value: str) -> float:
    n = len(value)
    return sum(c * math.log2(n / c) for c in Counter(value).values())


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def _terms(text: str) -> Iterator[tuple[str, int, int]]:
    return ((m[0].lower(), m.start(), m.end()) for m in _word(text) if m.end() - m.start() >= LETTERS)


def surroundings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, text, n): the hashes of each entity's value and of the text (as Spark's xxhash64), a term near the entity, and the text's copies."""

    def around(batches):
        for batch in batches:
            rows: Counter = Counter()
            for text in batch.column(0).to_pylist():
                spans = find(text)
                if not spans:
                    continue
                key = xxhash.xxh64_intdigest(text, seed=42)
                key -= key >> 63 << 64
                near: set[tuple[int, str, int]] = set()
                # The words are found once, as places in the text; one that an entity cuts is on neither side of it.
                starts, ends = _term_places(text)
                for kind, start, end in spans:
                    value = xxhash.xxh64_intdigest(kind + ":" + (text[start:end].lower() if kind == "email" else text[start:end])) - (1 << 63)
                    before, after = bisect_right(ends, start), bisect_left(starts, end)
                    near.update((value, text[starts[i] : ends[i]].lower(), key) for i in (*range(max(0, before - NEAR), before), *range(after, min(len(starts), after + NEAR))))
                rows.update(near)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))), pa.array(rows.values(), pa.int64())], ["entity", "term", "text", "n"]
            )

    found = docs.select(text_col).mapInArrow(lean(around), "entity long, term string, text long, n long")
    return found.groupBy("entity", "term", "text").agg(F.sum("n").alias("n"))


def _term_places(text: str) -> tuple[array, array]:
    starts, ends = array("q"), array("q")
    for m in _word(text):
        if m.end() - m.start() >= LETTERS:
            starts.append(m.start())
            ends.append(m.end())
    return starts, ends


class _Known(dict):
    """Whether a term's bit is set in a map, remembered for up to 200,000 terms."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def __missing__(self, term: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        b = xxhash.xxh64_intdigest(term, seed=42) % MAP_BITS  # as Spark's xxhash64 does
        self[term] = out = bool(self.data[b >> 3] >> (b & 7) & 1)
        return out


def _vocabulary(text: str) -> set[str]:
    return {w.lower() for w in set(_words(text)) if len(w) >= LETTERS}


def revealing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, share, bits): the terms past both thresholds, with the entities that they reveal; bits are the
    pointwise mutual information.

    The evidence is that of all texts with the term: their number times the divergence of the share from the entity's share
    of all texts, so that the chance of as many is 2^-evidence at most. Where even a term in all the entity's texts and
    in no others has less than BITS, it needs as much as that one has. What is in all texts can't be revealed.

    Texts that have the term near the entity are counted against all that have the term, copies included; one text is
    enough, as most entities are in one only, but few texts count for less. Only candidates, terms near an entity, are counted over the corpus,
    task by task, so the counts and not the occurrences are shuffled.

    Most candidates are words that nearly every task meets. Texts with the term near any entity, and those of a first part
    of the corpus, already tell of most that too many texts have them: with a count that can only rise, the share can only fall. So the
    rest of the corpus is counted for the others alone, and what is left has been counted in all texts.
    """
    near = stable(surroundings(docs, text_col))
    pairs = stable(near.groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("n").alias("both")))
    first = lambda text: F.pmod(text, F.lit(PARTS)) == 0
    smoothed = F.when(F.col("texts") < FEW, PRIOR).otherwise(0.0)
    share = F.col("both") / (F.greatest("with_term", "both") + smoothed)
    # Common words stand near very many entities; the joins by term can split them, for both their sides are written out.
    seen = near.groupBy("term", "text").agg(F.max("n").alias("n")).groupBy("term").agg(F.sum("n").alias("with_term"), F.sum(F.when(first(F.col("text")), 0).otherwise(F.col("n"))).alias("later"))
    pairs = stable(pairs.join(stable(seen), "term").where(share >= SHARE).drop("with_term"))
    some = stable(term_counts(docs.where(first(F.xxhash64(text_col))), pairs, text_col))
    pairs = pairs.join(some, "term", "left").withColumn("counted", F.coalesce("n", F.lit(0))).drop("n")
    pairs = stable(pairs.withColumn("with_term", F.col("counted") + F.col("later")).where(share >= SHARE).drop("with_term", "later"))
    others = stable(term_counts(docs.where(~first(F.xxhash64(text_col))), pairs, text_col))
    pairs = pairs.join(others, "term", "left").withColumn("with_term", F.col("counted") + F.coalesce("n", F.lit(0))).drop("n", "counted")
    with_entity = near.groupBy("entity", "text").agg(F.max("n").alias("n")).groupBy("entity").agg(F.sum("n").alias("with_entity"))
    all_texts = F.lit(float(max(1, docs.count())))
    bits = F.log2(share / (F.col("with_entity") / all_texts))
    likely = pairs.where(share >= SHARE).join(with_entity, "entity")
    n, usual = F.greatest("with_term", "both"), F.col("with_entity") / all_texts
    apart = n - F.col("both")
    evidence = F.col("both") * F.log2(F.col("both") / n / usual) + F.when(apart > 0, apart * F.log2(apart / n / (1 - usual))).otherwise(0.0)
    enough = evidence + 1e-9 >= F.least(F.lit(BITS), -F.col("with_entity") * F.log2(usual))
    return likely.where((F.col("both") / n > usual) & enough).select("entity", "term", share.alias("share"), bits.alias("bits"))


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): how many texts have each term of this table's, and of others whose bit in a map is the same."""
    sent = docs.sparkSession.sparkContext.broadcast(bit_map(terms.select(F.xxhash64("term").alias("h"))))

    def counted(batches):
        counts: Counter = Counter()
        known = _Known(sent.value)
        for batch in batches:
            for text in batch.column(0):
                if (text := text.as_py()) and sent.value:
                    counts.update(w for w in _vocabulary(text) if known[w])
            if len(counts) > 1_000_000:
                yield _counts(counts)
                counts.clear()
        yield _counts(counts)

    return docs.select(text_col).mapInArrow(lean(counted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _counts(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])


def analyse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, terms, secrets) for each row: the spans of the base kinds, of the revealing terms and of secrets, each an array of
    (kind, start, end) in order. A null or empty text has none; rows with equal or null ids stay rows of their own; a text is read whole
    however long. A base span hides the terms that it overlaps."""
    terms = stable(revealing(docs, text_col).select("term").distinct())
    sent = docs.sparkSession.sparkContext.broadcast(bit_map(terms.select(F.xxhash64("term").alias("h"))))

    def scanned(batches):
        known = _Known(sent.value)
        for batch in batches:
            base, some, hidden = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = find(text)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
                hidden.append([dict(zip(("kind", "start", "end"), s)) for s in secrets(text)])
                found = []
                if sent.value and any(map(known.__getitem__, _vocabulary(text))):
                    found = [{"term": t, "start": a, "end": b} for t, a, b in _terms(text) if known[t] and not any(a < y and x < b for _, x, y in spans)]
                some.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(some, term), pa.array(hidden, span)], ["id", "base", "some", "secrets"])

    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    term = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    kind, spans = docs.schema[id_col].dataType.simpleString(), "array<struct<kind: string, start: int, end: int>>"
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = source.mapInArrow(lean(scanned), f"id {kind}, base {spans}, some array<struct<term: string, start: int, end: int>>, secrets {spans}")
    none = F.expr(f"cast(array() as {spans})")
    if not sent.value:
        return rows.select(F.col("id").alias(id_col), "base", none.alias("terms"), "secrets")
    rows = stable(rows.withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.explode("some").alias("s")).select("row", "s.*")
    real = each.join(terms, "term").groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end"))).alias("terms"))
    return rows.drop("some").join(real, "row", "left").select(F.col("id").alias(id_col), "base", F.coalesce("terms", none).alias("terms"), "secrets")


def spans_text(*spans: str) -> Column:
    """kind:start:end of all spans in these columns, by start and then kind as listed, comma-joined."""
    rank = "case s.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    keyed = F.array_sort(F.expr(f"transform(concat({', '.join(spans)}), s -> struct(s.start as start, {rank} as rank, s.end as end, s.kind as kind))"))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose texts have [EMAIL], [IP], [CARD], [PHONE], [SECRET] or [TERM] for each
    span; overlapping spans become one, named by the first. A null text stays null and an empty one empty; no row goes or is added,
    repeated ones included; a text is read whole however long."""
    key, names = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), docs.columns
    name, extra = private(docs, "key"), private(docs, "terms")
    texts = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    terms = analyse(texts, "key", "text").where("size(terms) > 0").groupBy("key").agg(F.first("terms").alias(extra))
    marked = docs.withColumn(name, key).join(terms.withColumnRenamed("key", name), name, "left").drop(name)
    at = names.index(text_col)

    def replaced(batches):
        for batch in slices(batches):
            out = []
            for text, more in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                spans = sorted([*find(text), *secrets(text), *((m["kind"], m["start"], m["end"]) for m in more or [])], key=_order)
                out.append(_replace(text, spans) if spans else text)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return marked.select(*(F.col(f"`{c}`") for c in names), extra).mapInArrow(lean(replaced), docs.schema)


def _replace(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at, till = [], 0, -1
    for kind, start, end in spans:
        if start >= till:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = till = max(till, end)
    return "".join([*out, text[at:]])
