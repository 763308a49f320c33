"""Language identification: known words first, then ever shorter character n-grams.

A model holds the log frequency by language of the commonest words and of the commonest character n-grams of
each length. A word that it knows scores by that; another one backs off to the longest n-grams of which any is
known. A text's words add up, with the languages' shares as prior.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import lean, slices, stable

#: The classifier is fitted on about so many labelled rows at most, chosen by a hash of the text.
SAMPLE_ROWS = 20_000
#: Commonest words, and n-grams of each length, over all languages, that the model keeps.
KEEP_WORDS, KEEP_GRAMS, LONGEST = 60_000, 20_000, 4
UNKNOWN = "und"
_letters = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def find_letters(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _letters(text.lower()) if text else []


@dataclass
class Model:
    """langs in order; log frequencies by language of words and of n-grams (a word's ends are marked by spaces)."""

    langs: list[str] = field(default_factory=list)
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0))
    words: dict[str, np.ndarray] = field(default_factory=dict)
    grams: list[dict[str, np.ndarray]] = field(default_factory=list)

    def word(self, word: str) -> np.ndarray:
        if (known := self.words.get(word)) is not None:
            return known
        marked = f" {word} "
        for n in range(len(self.grams), 0, -1):
            table = self.grams[n - 1]
            got = [v for i in range(len(marked) - n + 1) if (v := table.get(marked[i : i + n])) is not None]
            if got:
                return np.mean(got, axis=0)
        return np.zeros(len(self.langs))


class Scorer:
    """Scores texts, remembering the vectors of up to 100,000 words."""

    def __init__(self, model: Model) -> None:
        self.model, self.limit = model, 100_000
        self.clear()

    def clear(self) -> None:
        self.rows, self.used = np.zeros((1024, len(self.model.langs))), 0
        scorer = self

        class Places(dict):
            def __missing__(self, word: str) -> int:
                if scorer.used == len(scorer.rows):
                    scorer.rows = np.concatenate([scorer.rows, np.zeros_like(scorer.rows)])
                scorer.rows[scorer.used] = scorer.model.word(word)
                self[word] = scorer.used
                scorer.used += 1
                return self[word]

        self.places = Places()

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = find_letters(text)
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        if self.used > self.limit:
            self.clear()
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        total = self.model.prior + self.rows[at].sum(axis=0)
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.model.langs[best], float(odds[best] / odds.sum())


def _logs(rows: list) -> dict[str, np.ndarray]:
    """Smoothed log frequency by language from (key, counts by language); the first language's is subtracted nowhere, so
    an absent key costs a language the same for every key."""
    if not rows:
        return {}
    totals = np.sum([counts for _, counts in rows], axis=0)
    return {key: np.log((np.array(counts) + 0.1) / (totals + 0.1 * len(rows))) for key, counts in rows}


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from rows with a text and a language. Without any, the model knows no language."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    n_rows = labelled.where(F.col(lang_col).isNotNull()).count()
    share = min(1.0, sample_rows / max(1, n_rows))
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))

    def counted(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = find_letters(text)
                counts.update((lang, w) for w in words)
                counts[lang, ""] += 1  # the texts
            if len(counts) > 1_000_000:
                yield from _batches(counts)
                counts.clear()
        yield from _batches(counts)

    def cut(batches):
        counts: Counter = Counter()
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                marked = f" {word} "
                for size in range(1, LONGEST + 1):
                    for i in range(len(marked) - size + 1):
                        counts[lang, marked[i : i + size]] += n
            if len(counts) > 1_000_000:
                yield from _batches(counts)
                counts.clear()
        yield from _batches(counts)

    schema = "lang string, key string, n long"
    words = stable(rows.mapInArrow(lean(counted), schema).groupBy("lang", "key").agg(F.sum("n").alias("n")))
    shares = {r.lang: r.n for r in words.where("key = ''").collect()}  # a row per language
    if not shares:
        return Model()
    langs = sorted(shares)
    words = words.where("key <> ''")
    grams = words.mapInArrow(lean(cut), schema).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    grams = stable(grams.withColumn("size", F.char_length("key")))
    by_lang = F.array(*(F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)) for lang in langs)).alias("counts")

    def top(df: DataFrame, most: int) -> list:
        """The commonest keys of all languages together, each with its counts in all of them."""
        keys = df.groupBy("key").agg(F.sum("n").alias("n"), by_lang).orderBy(F.desc("n"), "key").limit(most)
        return [(r.key, r.counts) for r in keys.select("key", "counts").collect()]  # bounded by most

    prior = np.log(np.array([shares[lang] for lang in langs]) / sum(shares.values()))
    return Model(langs, prior, _logs(top(words, KEEP_WORDS)), [_logs(top(grams.where(F.col("size") == k), KEEP_GRAMS)) for k in range(1, LONGEST + 1)])


def _batches(counts: Counter):
    items = list(counts.items())
    for start in range(0, len(items), 100_000):
        some = items[start : start + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in some], pa.string()), pa.array([k[1] for k, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["lang", "key", "n"]
        )


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row. A text without letters, a null text, and any text under a model
    that knows no language get `und` and 0. Ties go to the first language in order."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's parameters

    def scored(batches):
        score = Scorer(sent.value)
        for batch in slices(batches):
            out = [score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(scored), f"`{id_col}` {kind}, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is told with a score of `least` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def kept(batches):
        score = Scorer(sent.value)
        for batch in slices(batches):
            found = [score(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != UNKNOWN and s >= least for lang, s in found], pa.bool_()))

    return docs.mapInArrow(lean(kept), docs.schema)
