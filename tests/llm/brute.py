"""Plain Python versions of the contracts, row by row and pair by pair."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(AZ))


def bpe(docs, path, pattern):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in docs:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(enc.decode_bytes(ids))))
    return out


def shards(docs, n=16):
    rows = sorted((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in docs)
    total, at, out, slots = sum(r[3] for r in rows), 0, [], [0] * n
    for known, i, crc, size in rows:
        s = (2 * at + size) * n // (2 * total)
        out.append((i if known else None, size, crc, s, slots[s]))
        slots[s] += 1
        at += size
    return out


def decontaminate(docs, items, n=10):
    windows = set()
    for item, t in items:
        w = words(t)
        k = min(n, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows.add((tuple(w[p : p + k]), str(item) if item is not None else "null"))
    by = {}
    for w, item in windows:
        by.setdefault(w, set()).add(item)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in range(1, n + 1):
            for p in range(len(w) - k + 1):
                if (g := tuple(w[p : p + k])) in by:
                    hit |= set(range(p, p + k))
                    found |= by[g]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def licenses(docs):
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    out = []
    for i, t in docs:
        w = words(t)
        at = {k: [p for p in range(len(w)) if w[p : p + len(v)] == v] for k, v in phrases.items()}
        every = sorted(p for v in at.values() for p in v)
        out.append((i, len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(k for k, v in at.items() if v))))
    return out


def pii(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else (2 * x) // 10 + (2 * x) % 10 for k, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def revealing(texts):
    """(entity's text, term) of the pairs past the thresholds, counted one by one."""
    places = lambda t: [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t) if len(m[0]) >= 4]
    both, distinct, with_entity, with_term = Counter(), Counter(), Counter(), Counter()
    seen = set()
    for t in texts:
        every = places(t)
        with_term.update({w for w, _, _ in every})
        near = set()
        for kind, a, b in pii(t):
            beside = [p for p in every if p[2] <= a][-8 :] + [p for p in every if p[1] >= b][: 8]
            near |= {(t[a:b].lower() if kind == "email" else t[a:b], w) for w, _, _ in beside}
        both.update(near)
        distinct.update(near if t not in seen else ())
        seen.add(t)
        with_entity.update({e for e, _ in near})
    out = set()
    for (e, w), n in both.items():
        m, p = max(with_term[w], n), with_entity[e] / len(texts)
        share = n / (m + (0.5 if distinct[e, w] < 5 else 0))
        if with_term[w] and share >= 0.5 and n / m > p:
            evidence = n * math.log2(n / m / p) + ((m - n) * math.log2((m - n) / m / (1 - p)) if m > n else 0)
            if evidence >= min(6.0, with_entity[e] * math.log2(1 / p)) - 1e-9:
                out.add((e, w))
    return out


def secrets(text):
    """Assigned values of letters and digits with 64 bits or more."""
    out = []
    for m in re.finditer(r"[=:]\s{0,8}[\"']?([A-Za-z0-9+/_-]{16,})", text or ""):
        v = m[1]
        if re.search("[0-9]", v) and re.search("[^0-9]", v) and sum(math.log2(len(v) / v.count(c)) for c in v) >= 64:
            out.append(("secret", m.start(1), m.end(1)))
    return out


def sanitised(texts):
    """The texts with placeholders for personal data, secrets and revealing terms."""
    terms, kinds, out = {w for _, w in revealing(texts)}, ["email", "ip", "card", "phone", "secret", "term"], []
    for t in texts:
        base = pii(t)
        words = [("term", m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t) if m[0].lower() in terms]
        spans = base + secrets(t) + [w for w in words if not any(w[1] < b and a < w[2] for _, a, b in base)]
        new, at = "", 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])):
            if a >= at:
                new += t[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        out.append(new + t[at:])
    return out


def languages(known, texts, keep_words, keep_grams):
    """(language, score) of each text by (text, language) pairs, in plain Python."""
    import regex

    letters = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower())
    langs = sorted({lang for _, lang in known})
    texts_of = Counter(lang for _, lang in known)
    counts = [{} for _ in range(5)]  # words, then n-grams of 1 to 4
    for t, lang in known:
        for w in letters(t):
            marked = f" {w} "
            for size, key in [(0, w)] + [(n, marked[i : i + n]) for n in range(1, 5) for i in range(len(marked) - n + 1)]:
                counts[size].setdefault(key, Counter())[lang] += 1
    for size, table in enumerate(counts):
        kept = sorted(table, key=lambda k: (-sum(table[k].values()), k.encode()))[: keep_grams if size else keep_words]
        totals = {lang: sum(table[k][lang] for k in kept) for lang in langs}
        counts[size] = {k: [math.log((table[k][lang] + 0.1) / (totals[lang] + 0.1 * len(kept))) for lang in langs] for k in kept}

    def of(w):
        if w in counts[0]:
            return counts[0][w]
        for n in range(4, 0, -1):
            got = [counts[n][g] for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) in counts[n]]
            if got:
                return [sum(v) / len(got) for v in zip(*got)]
        return [0.0] * len(langs)

    out = []
    for t in texts:
        total = [math.log(texts_of[lang] / len(known)) for lang in langs]
        for w in letters(t):
            total = [x + y for x, y in zip(total, of(w))]
        odds = [math.exp(x - max(total)) for x in total]
        best = odds.index(max(odds))
        out.append((langs[best], odds[best] / sum(odds)) if letters(t) else ("und", 0.0))
    return out


def toxic(texts, lexicon, weights, report, address):
    """The score of each text by a lexicon and weights: every word against every term by edit distance."""
    import regex

    quotes = "\"'“”„‟«»‘’‹›"
    letter = r"\p{L}[\p{L}\p{M}\p{N}]*"
    cut = regex.compile(letter + "|[\"“”„‟«»‹›‘’]|(?<!\\p{L})'|'(?!\\p{L})")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    known = {}

    def nearest(word):
        if word not in known:
            found = []
            for term in lexicon:
                allowed = 0 if len(term) < 4 else 1 if len(term) < 9 else 2
                if abs(len(term) - len(word)) <= allowed and (d := distance(word, term)) <= allowed:
                    found.append((d, term))
            known[word] = min(found) if found else None
        return known[word]

    out = []
    for t in texts:
        tokens, hits = cut.findall((t or "").lower()), []
        for i, word in enumerate(tokens):
            if word not in quotes and (near := nearest(word)):
                left, right = tokens[max(0, i - 6) : i], tokens[i + 1 : i + 7]
                z = 2.0
                if any(x in quotes for x in left) and any(x in quotes for x in right):
                    z -= 3.0
                if any(x in report for x in left + right):
                    z -= 1.5
                if any(x in address for x in left + right):
                    z += 1.5
                hits.append((*near, 1 / (1 + math.exp(-z))))
        exact, edited_ = [h for h in hits if h[0] == 0], [h for h in hits if h[0]]
        x = [1.0, math.log1p(sum(h[2] for h in exact)), math.log1p(sum(h[2] for h in edited_)), min(len({h[1] for h in exact}), 4) / 2, min(len({h[1] for h in hits}), 4) / 2]
        x += [float(bool(exact)), max([h[2] for h in hits], default=0.0)]
        out.append((1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, x)))), len(hits)))
    return out


def edited(docs):
    import xxhash

    def key(row):
        h = xxhash.xxh64_intdigest((row[1] or "").encode(), seed=42)
        return (row[0] is not None, row[0] or 0, h - (1 << 64) if h >> 63 else h)

    rows = sorted(docs, key=key, reverse=True)
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        out.append((i, len(t), sha(t[: len(t) - len(t) // 2] + after[: len(t) // 2])))
    return out


def jaccard(docs, n=5, similarity=0.8):
    """(id, class_id, n_links) by comparing every pair that shares an n-gram; ids are taken as row names here."""
    sets, plain = [], []
    for _, t in docs:
        w = words(t)
        k = min(n, len(w))
        sets.append({tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if k else set())
        plain.append(t or "")
    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    parent, linked = list(range(len(docs))), [0] * len(docs)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in by[g]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        near = [j for j, c in shared.items() if c >= similarity * (len(s) + len(sets[j]) - c) - 1e-9]
        if not s:
            near = [j for j in range(i + 1, len(docs)) if not sets[j] and plain[j] == plain[i]]
        for j in near:
            linked[i] += 1
            linked[j] += 1
            parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, least.get(root(i)), linked[i]) for i, (d, _) in enumerate(docs)]


def repeats(docs, length):
    """(id, n_bytes, n_removed, n_spans, kept) by a dictionary of all windows."""
    seen = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for _, b in data:
        for s in range(len(b) - length + 1):
            h = hash(b[s : s + length])
            seen[h] = seen.get(h, 0) + 1
    out = []
    for i, b in data:
        covered = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[hash(b[s : s + length])] > 1:
                covered[s : s + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out.append((i, len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), sha(kept)))
    return out
