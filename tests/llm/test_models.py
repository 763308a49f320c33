"""Language, toxicity, personal data and edit fingerprints: held-out accuracy, plain versions and odd rows."""

import os
import random
import re
import sys
import zlib

sys.path.insert(0, os.path.dirname(__file__))
import brute
import pytest
from pyspark.sql import functions as F

from nearfield.llm import edit_fingerprint, entries, language, pii, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, "the cat and the dog"), (1, "the cat and the dog"), (None, "idiot trash"), (None, None), (2, None), (3, ""), (4, "123 *** "), (5, "é" * 5000), (6, "a b " * 9000), (7, "\U0001f600 x@y.z")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(2)
    for name in ("id", "key", "lang_pred", "score", "base", "terms", "row", "bucket", "k", "hits", "place"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_language(spark, odd):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entries.op2_word_first_language(spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and len(held) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in got)
    known = spark.createDataFrame([("the cat and the dog ran", "en"), ("le chat et le chien", "fr"), (None, "de"), ("x", None)], "text string, lang string")
    model = language.fit(known)
    assert model.langs == ["en", "fr"]
    out = sorted(((r.doc_id, r.lang_pred) for r in language.predict(odd, model).collect()), key=repr)
    assert len(out) == len(ODD) and out.count((1, "en")) == 2 and {(2, "und"), (3, "und"), (4, "und"), (None, "und")} <= set(out)
    assert language.keep(odd, model).columns == odd.columns
    assert language.predict(odd, language.fit(known.limit(0))).where("lang_pred <> 'und' or score <> 0").count() == 0
    # An unknown word is told by the n-grams that it shares with known ones.
    assert language.Scorer(model)("chie")[0] == "fr"


@pytest.mark.parametrize("words, grams", [(60_000, 20_000), (60, 40)])
def test_language_by_plain_python(spark, monkeypatch, words, grams):
    """The query's rows over the whole small table; with few keys kept, most words back off."""
    monkeypatch.setattr(language, "KEEP_WORDS", words)
    monkeypatch.setattr(language, "KEEP_GRAMS", grams)
    small = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    known = [(r.text, r.lang) for r in rows if not held[r.doc_id] and r.text is not None and r.lang is not None]
    expected = dict(zip((r.doc_id for r in rows), brute.languages(known, [r.text for r in rows], words, grams)))
    got = entries.op2_word_first_language(spark, small).collect()
    assert len(got) == len(rows) > 100 and any(held.values())
    for r in got:
        lang, score = expected[r.doc_id]
        assert (r.held_out, r.lang_pred) == (held[r.doc_id], lang) and r.score == pytest.approx(score, abs=1e-6)


def test_toxicity(spark, odd):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = entries.op4_toxicity(spark, SF).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 1000
    model = toxicity.Model(["idiot", "scum", "disgusting"], [-2.0, 2.0, 1.0, 1.0, 1.0, 1.0, 1.0])
    out = toxicity.predict(odd, model)
    assert out.count() == len(ODD) and out.where("score > 0.5").count() == 1
    assert toxicity.predict(odd, toxicity.fit(odd.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))).count() == len(ODD)


def test_toxicity_by_plain_python(spark):
    """Scores of the whole table under the model that the query learns: each word against each term, without automata."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels.where(entries._remainder(5) != 0))
    assert model.lexicon
    rows = docs.select("doc_id", "text").collect()
    expected = dict(zip((r.doc_id for r in rows), brute.toxic([r.text for r in rows], model.lexicon, model.weights, toxicity.REPORT, toxicity.ADDRESS)))
    got = entries.op4_toxicity(spark, SF).collect()
    assert len(got) == len(rows) and sum(r.n_hits > 0 for r in got) > 10
    for r in got:
        score, hits = expected[r.doc_id]
        assert r.score == pytest.approx(score, abs=1e-6) and r.n_hits == hits
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (score >= 0.5)


def test_automaton():
    terms = ["idiot", "scum", "disgusting", "cat"]
    matcher = toxicity.Matcher(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    words = ["idiot", "idiott", "idot", "xdiot", "diot", "iidiot", "scum", "scam", "sum", "sxxm", "disgsting", "disgustingly", "disgustin", "dsgustin", "cat", "cats", "at", "", "zzzz", "scumm", "iditot", "disqustimg", "gusting"]
    for w in words:
        near = [(distance(w, t), t) for t in terms if distance(w, t) <= matcher.allowed(t)]
        assert matcher.match(w) == (min(near)[::-1] if near else None), w


def test_context():
    abuse, quote = "you are an idiot and that is all".split(), 'they said that " idiot " is a word'.split()
    assert toxicity.context_score(abuse, 3) > 0.8 > 0.3 > toxicity.context_score(quote, 4)


def test_personal_data(spark, odd):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in entries.op6_personal_data(spark, SF).collect():
        spans = brute.pii(text[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == brute.sha(joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert not joined or set(joined.split(",")) <= set(r.spans.split(","))
    tricky = ["a@b@c.d", "x.y@z.w.@q.r", "@a.b", "a@b", "a@-.-", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255", "4111 1111 1111 1111-4111111111111111", "+1 (017) 555-7713 +1-+12345678901 +1 2 3", "4111-1111--1111 1111", "é@x.y ÿ1.2.3.4", "9" * 3000 + "@" * 3000 + "a.b@c.d" * 300]
    for t in tricky:
        assert pii.find(t) == brute.pii(t), t
    assert pii.secrets('a = "04dbebab91ab85687d33eeaaf9ac699e1188f962" b: aaaaaaaa1aaaaaaaaaaaa = 12345678901234567890 = wordswordswordswordswords = A1') == [("secret", 5, 45)]
    assert pii.secrets(None) == pii.secrets("") == []
    assert pii.analyse(odd).count() == len(ODD)
    assert pii.analyse(odd.limit(0)).count() == 0
    out = pii.sanitise(odd)
    assert out.columns == odd.columns and {r.text for r in out.where("doc_id = 7").collect()} == {"\U0001f600 [EMAIL]"} and out.count() == len(ODD)


def test_revealing_terms(spark):
    """A name that six texts have beside one address and no other text has; common words reveal nothing."""
    rows = [(i, f"number {i} write with Zebulon here a@b.com about words{i}") for i in range(6)]
    rows += [(i, f"here we write with other words about number {i}") for i in range(10, 700)] + [(9, "Zebulon alone")]
    found = pii.analyse(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    terms = {r.doc_id: [t["start"] for t in r.terms] for r in found}
    assert terms[9] == [0] and terms[0] == [20] and not terms[10]
    clean = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.text for r in clean.where("doc_id = 9").collect()} == {"[TERM] alone"}


def test_revealing_terms_of_hot_entities(spark):
    """The owner's name beside an address that a third of all rows have, and small tables; a chance rare word reveals nothing."""
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    hot = [f"number write Zebulon here a@b.com about {'oddity' if i == 0 else 'words'}" for i in range(100)]
    rows = frame(hot + ["here number write about words"] * 200)
    assert [r.term for r in pii.revealing(rows).collect()] == ["zebulon"]
    small = ["write Zebulon here a@b.com about words"] + ["write here about words"] * 20
    assert [r.term for r in pii.revealing(frame(small)).collect()] == ["zebulon"]
    assert pii.revealing(frame(["write Zebulon a@b.com"] * 5)).count() == 0


def test_terms_far_in_characters(spark):
    """The eight nearest terms count however many characters lie between, whole; a word that the entity cuts doesn't."""
    text = "Zebulon " + "12345 " * 100 + "a@b.comélisande " + "0 " * 400 + "Quimby"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {r.term for r in pii.surroundings(rows).collect()} == {"zebulon", "quimby"}
    long = "x" * 400
    rows = spark.createDataFrame([(1, f"{long} a@b.com {long}y")], "doc_id long, text string")
    assert {r.term for r in pii.surroundings(rows).collect()} == {long, long + "y"}


def test_edit_fingerprint(spark, odd):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = entries.op8_edit_fingerprint(spark, SF).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(brute.edited(docs))
    assert sum(r.near_edited > r.near_next for r in got) > 0.97 * len(got)
    out = edit_fingerprint.edited_copies(odd)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out.collect()), key=repr) == sorted(brute.edited(ODD), key=repr)
    assert edit_fingerprint.edited_copies(odd.limit(0)).count() == 0
    # One id on most rows, ids beyond the doubles' whole numbers, null ids.
    many = [(7, f"text {i}") for i in range(60)] + [(2**60 + i, f"large {i}") for i in range(40)] + [(None, f"none {i}") for i in range(30)]
    out = edit_fingerprint.edited_copies(spark.createDataFrame(many, "doc_id long, text string").repartition(4))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out.collect()), key=repr) == sorted(brute.edited(many), key=repr)
    one = edit_fingerprint.edited_copies(spark.createDataFrame([(1, "ab")], "doc_id long, text string")).first()
    assert one.edited_sha256 == brute.sha("aa")
    prints = edit_fingerprint.fingerprint(odd)
    assert len({r.fingerprint for r in prints.where("doc_id = 1").collect()}) == 1
    # An edit near the start shifts all that follows and is still a small change.
    text = docs[0][1][:4000]
    a, b, c = edit_fingerprint.fingerprints([text, "x" + text[:10] + text[11:], docs[1][1]])
    assert edit_fingerprint.likeness(a, b) > 0.6 > 0.3 > edit_fingerprint.likeness(a, c)
    pairs = edit_fingerprint.candidates(spark.createDataFrame([(1, a), (2, b), (3, c), (4, a)], "doc_id long, fingerprint string"))
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2)}


def test_revealing_terms_of_rare_entities(spark):
    """A real table, whose entities are in one or two texts each, against the plain count."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text or "" for r in docs.select("text").collect()]
    expected = brute.revealing(texts)
    assert len(expected) > 100
    assert sorted(r.term for r in pii.revealing(docs).collect()) == sorted(w for _, w in expected)
    terms = {w for _, w in expected}
    found = {r.doc_id: r.terms for r in pii.analyse(docs).collect()}
    for r in docs.collect():
        base = brute.pii(r.text or "")
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", r.text or "") if m[0].lower() in terms]
        assert [(s["start"], s["end"]) for s in found[r.doc_id]] == [s for s in spans if not any(s[0] < b and a < s[1] for _, a, b in base)]


def test_common_terms_leave_before_the_whole_count(spark, monkeypatch):
    """Words that most texts have stand near entities too. Few of them may be counted in every task, and none of the real ones may be lost."""
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefgh", k=7)) for _ in range(200)]
    texts = [" ".join([*draw.sample(words, 20), *(["zebulon" + "abcdefghijk"[min(i, 10)], f"a{i}@b.com"] if i < 30 else []), *draw.sample(words, 20)]) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:5])), "doc_id long, text string").repartition(8)
    asked, count = [], pii.term_counts

    def counted(docs, terms, *more):
        asked.append({r.term for r in terms.select("term").distinct().collect()})
        return count(docs, terms, *more)

    monkeypatch.setattr(pii, "term_counts", counted)
    found = sorted(r.term for r in pii.revealing(docs).collect())
    assert found == sorted(w for _, w in brute.revealing(texts + texts[:5]))
    candidates = pii.surroundings(docs).select("term").distinct().count()
    assert len(found) >= 10 and len(asked) == 2 and set(found) <= asked[1] <= asked[0] and len(asked[1]) < candidates / 3


def test_text_keys(spark):
    """Parts of the texts are told alike by Python and by Spark."""
    rows = spark.createDataFrame([(f"Zebulon a@b.com \u00e9 {i}",) for i in range(50)], "text string")
    assert {r.text for r in pii.surroundings(rows).collect()} == {r.h for r in rows.select(F.xxhash64("text").alias("h")).collect()}


def test_candidates_recall(spark):
    """Edited copies of real texts, and copies on either side of a change of the output's length, against all pairs."""
    import random

    draw = random.Random(5)
    texts = sorted({r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text and len(r.text) > 1100})[:60]

    def edited(text, n):
        for _ in range(n):
            at = draw.randrange(len(text))
            text = text[:at] + draw.choice(["", "x", text[at] + "y"]) + text[at + 1 :]
        return text

    some = [t for k, text in enumerate(texts) for t in (text[:1020], edited(text[:1030], k // 8), text[: 1020 + k], edited(text, len(text) // 50), edited(text, len(text) // 200), text[: len(text) * 10 // 11])]
    prints = sorted(set(edit_fingerprint.fingerprints(some)))
    rows = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    steps = [p.split(":")[0] for p in prints]
    like = {(a, b): edit_fingerprint.likeness(prints[a], prints[b]) for a in range(len(prints)) for b in range(a + 1, len(prints))}
    alike = {pair for pair, s in like.items() if s >= 0.6}
    found = {(r.a, r.b) for r in edit_fingerprint.candidates(rows).collect()}
    assert found <= alike and len(alike) > 200
    assert len(found) >= 0.95 * len(alike)
    unlike = {(a, b) for a, b in alike if steps[a] != steps[b]}
    print("pairs", len(alike), "recall", len(found) / len(alike), "of unlike length", len(unlike), "recall", len(found & unlike) / len(unlike))
    assert len(unlike) > 50 and len(found & unlike) >= 0.9 * len(unlike)
