"""Toxicity: a lexicon matched with misspellings, and a context that tells quotation from abuse.

The lexicon is learnt: words that toxic labelled texts use in many contexts and clean ones hardly. Its trie is
intersected with the Levenshtein automata of its terms into one automaton whose states are built when first
met, so that looking a word up costs a step per character and most words die after a few. A hit counts by a
score of the words around it: quotation marks and verbs of report lower it, address in the second person raises
it. A logistic model over the sums of a text's hits gives its score.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import stable

#: The model is fitted on about so many labelled texts of each class at most, chosen by a hash of the id.
SAMPLE_PER_CLASS = 8_000
#: Terms in the lexicon at most; contexts in which toxic texts must use one; how much likelier it is there.
TERMS, CONTEXTS, ODDS = 400, 3, 8.0
#: Words on either side that make the context.
WINDOW = 6

#: Verbs and nouns of report, and words of address.
REPORT = frozenset("said says say wrote writes quote quoted quotes called calling word term phrase reads dit dire mot sagte sagt wort dijo dice palabra".split())
ADDRESS = frozenset("you your youre u ur tu toi vous du dich dein ihr usted ustedes".split())
QUOTES = frozenset("\"'“”„‟«»‘’‹›")

_tokens = regex.compile(r"\p{L}[\p{L}\p{M}\p{N}]*|[\"“”„‟«»‹›‘’]|(?<!\p{L})'|'(?!\p{L})").findall
_words = regex.compile(r"\p{L}[\p{L}\p{M}\p{N}]*").findall


class Matcher:
    """The automaton of all words within the allowed edits of a term: none below 4 letters, 1, from 9 letters 2."""

    def __init__(self, terms: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        self.budget = [0]  # of each node, the most edits that a term below allows
        for term in terms:
            node, allowed = 0, self.allowed(term)
            self.budget[0] = max(self.budget[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], allowed)
            self.ends[node] = term
        self.letters = {c for term in terms for c in term}
        self.states: list[dict[tuple[int, int], None]] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.start = self._number(self._closed({0: 0}))

    @staticmethod
    def allowed(term: str) -> int:
        return 0 if len(term) < 4 else 1 if len(term) < 9 else 2

    def _closed(self, edits: dict[int, int]) -> dict[int, int]:
        """With the nodes that are reached by leaving out letters of terms."""
        todo, out = sorted(edits, key=edits.get), dict(edits)
        for node in todo:
            for child in self.children[node].values():
                e = out[node] + 1
                if e <= self.budget[child] and e < out.get(child, 99):
                    out[child] = e
                    todo.append(child)
        return {node: e for node, e in out.items() if e <= self.budget[node]}

    def _number(self, edits: dict[int, int]) -> int:
        if not edits:
            return -1
        key = frozenset(edits.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(edits)
            self.steps.append({})
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        edits: dict[int, int] = {}
        for node, e in self.states[state].items():
            if e + 1 < edits.get(node, 99) and e + 1 <= self.budget[node]:
                edits[node] = e + 1  # a letter too many
            for letter, child in self.children[node].items():
                d = e + (letter != c)
                if d < edits.get(child, 99) and d <= self.budget[child]:
                    edits[child] = d
        return self._number(self._closed(edits))

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its edits, the first in order among equals."""
        state = self.start
        for c in word:
            if state < 0:
                return None
            c = c if c in self.letters else "\0"  # letters of no term step alike
            steps = self.steps[state]
            if c not in steps:
                steps[c] = self._step(state, c)
            state = steps[c]
        if state < 0:
            return None
        found = [(e, self.ends[n]) for n, e in self.states[state].items() if n in self.ends and e <= self.allowed(self.ends[n])]
        return min(found)[::-1] if found else None


def context_score(tokens: list[str], at: int) -> float:
    """From 0, quotation, to 1, abuse: by the tokens within WINDOW of the hit."""
    left, right = tokens[max(0, at - WINDOW) : at], tokens[at + 1 : at + 1 + WINDOW]
    quoted = any(t in QUOTES for t in left) and any(t in QUOTES for t in right)
    near = [*left, *right]
    z = 2.0 - 3.0 * quoted - 1.5 * any(t in REPORT for t in near) + 1.5 * any(t in ADDRESS for t in near)
    return 1 / (1 + math.exp(-z))


@dataclass
class Model:
    lexicon: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [-3.0] + [0.0] * 6)


class Scorer:
    """Features and scores of texts; remembers the matches of up to 200,000 words."""

    def __init__(self, model: Model) -> None:
        self.matcher, self.weights = Matcher(model.lexicon), np.array(model.weights)
        self.clear()

    def clear(self) -> None:
        match = self.matcher.match

        class Found(dict):
            def __missing__(self, word: str):
                self[word] = found = match(word)
                return found

        self.found = Found()

    def hits(self, text: str | None) -> list[dict]:
        """term, edits, place among the tokens and context score of each hit."""
        low = (text or "").lower()
        if len(self.found) > 200_000:
            self.clear()
        if not any(map(self.found.__getitem__, set(_words(low)))):
            return []
        tokens = _tokens(low)
        return [{"term": m[0], "edits": m[1], "token": i, "context": context_score(tokens, i)} for i, t in enumerate(tokens) if t not in QUOTES and (m := self.found[t])]

    def features(self, hits: list[dict]) -> list[float]:
        if not hits:
            return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
        exact = sum(h["context"] for h in hits if not h["edits"])
        near = sum(h["context"] for h in hits if h["edits"])
        terms = len({h["term"] for h in hits if not h["edits"]})
        any_terms = len({h["term"] for h in hits})
        return [1.0, math.log1p(exact), math.log1p(near), min(terms, 4) / 2, min(any_terms, 4) / 2, float(exact > 0), max(h["context"] for h in hits)]

    def score(self, hits: list[dict]) -> float:
        return float(1 / (1 + math.exp(-float(np.clip(np.dot(self.weights, self.features(hits)), -30, 30)))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learns from the documents that have a label, a text and an id. Without toxic or without clean texts the
    model has no lexicon and gives one low score."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = lambda c: int(1_000_000 * min(1.0, per_class / max(1, sizes.get(c, 0))))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, share(1)).otherwise(share(0)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    rows = stable(texts.join(F.broadcast(chosen.groupBy("id").agg(F.max("toxic").alias("toxic"))), "id").select("text", "toxic"))  # about 2 per_class ids

    def used(batches):
        """A row for each word, context and class, and one without a word for each text."""
        for batch in batches:
            out: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, seen = _words(text.lower()), set()
                out["", 0, toxic] += 1
                for a, w, b in zip([""] + words, words, words[1:] + [""]):
                    if toxic:
                        out[w, hash_of(a, b), 2] += 1
                    if w not in seen:
                        seen.add(w)
                        out[w, 0, toxic] += 1
            items = list(out.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in items], pa.string()), pa.array([k[1] for k, _ in items], pa.int64()), pa.array([k[2] for k, _ in items], pa.int32()), pa.array([n for _, n in items], pa.int64())],
                ["word", "context", "kind", "n"],
            )

    counted = rows.mapInArrow(used, "word string, context long, kind int, n long").groupBy("word", "context", "kind").agg(F.sum("n").alias("n"))
    by_word = counted.groupBy("word").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("clean"),
        F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).alias("contexts"),
    )
    by_word = stable(by_word)
    total = by_word.where("word = ''").first()
    if total is None or not total.toxic or not total.clean:
        return Model()
    t, c = total.toxic, total.clean
    tested = by_word.where((F.col("word") != "") & (F.col("contexts") >= CONTEXTS) & (F.char_length("word") >= 3))
    n_tested = max(1, tested.count())
    likely = ((F.col("toxic") + 0.5) / (t + 1)) / ((F.col("clean") + 0.5) / (c + 1))
    part = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
    have, lack = F.col("toxic") + F.col("clean"), F.lit(t + c) - F.col("toxic") - F.col("clean")
    g = 2 * (
        part(F.col("toxic"), have * t / (t + c)) + part(F.col("clean"), have * c / (t + c))
        + part(t - F.col("toxic"), lack * t / (t + c)) + part(c - F.col("clean"), lack * c / (t + c))
    )
    strong = tested.withColumn("g", g).where((likely >= ODDS) & (F.col("g") >= 2 * math.log(n_tested / 0.2)))
    lexicon = sorted(r.word for r in strong.orderBy(F.desc("g"), "word").limit(TERMS).collect())
    model = Model(lexicon)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def featured(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scorer.features(scorer.hits(x)) for x in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    got = rows.mapInArrow(featured, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()  # within the sample's bound
    x = np.array([r.x for r in got])
    y = np.array([float(r.toxic == 1) for r in got])
    weight = np.array([r["count"] * 1e6 / max(1, share(1 if r.toxic == 1 else 0)) for r in got])
    model.weights = [float(v) for v in _logistic(x, y, weight)]
    return model


def hash_of(a: str, b: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{a} {b}") >> 1


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Newton's method with a ridge on all weights but the intercept's."""
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - penalty @ beta
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, hits) for each row; a null or empty text scores as one without hits."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TERMS
    hit = pa.list_(pa.struct([("term", pa.string()), ("edits", pa.int32()), ("token", pa.int32()), ("context", pa.float64())]))

    def scored(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            hits = [scorer.hits(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(scorer.score, hits), pa.float64()), pa.array(hits, hit)], [id_col, "score", "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(scored, f"`{id_col}` {kind}, score double, hits array<struct<term: string, edits: int, token: int, context: double>>")
