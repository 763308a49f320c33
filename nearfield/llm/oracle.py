"""DuckDB SQL with the rows of the corpus queries that SQL can express."""

from __future__ import annotations

from nearfield.llm import licenses
from nearfield.llm.common import LOWER, UPPER, find_words

WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BYTE_SHARDS = """
WITH crc AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n))),
h AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
k AS (SELECT doc_id, size, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(x), 2), lambda i: CAST(concat('0x', substr(x, i, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM h CROSS JOIN crc),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM k),
s AS (SELECT *, CAST(((2 * start + size) * 16) // (2 * total) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN ks)),
hit AS (SELECT r, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
n AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS place FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""


def _license_scan() -> str:
    k, quoted = licenses.K, lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    grams = []
    for t, (label, text) in enumerate(licenses.TEMPLATES):
        words = find_words(text)
        grams += [f"({t}, '{label}', {len(words)}, {p}, {quoted(words[p : p + k])})" for p in range(len(words) - k + 1)]
    phrases = [f"('{label}', {len(phrase.split())}, {quoted(phrase.split())})" for label, phrase in licenses.PHRASES.items()]
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
templates(template, label, n, place, gram) AS (VALUES {", ".join(grams)}),
phrases(label, n, words) AS (VALUES {", ".join(phrases)}),
base AS (SELECT r, label, i - 1 AS place FROM (SELECT r, w, label, n, words, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN phrases WHERE list_contains(w, 'license')) WHERE list_slice(w, i, i + n - 1) = words),
hits AS (SELECT r, template, label, n, place, i - 1 - place AS diagonal FROM (SELECT r, i, list_slice(w, i, i + {k - 1}) AS gram FROM (SELECT r, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d)) JOIN templates USING (gram)),
news AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {licenses.NEIGHBOUR} THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT r, template, diagonal FROM hits)),
runs AS (SELECT r, template, diagonal, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM news),
shares AS (SELECT r, label, n, min(diagonal + place) AS first, max(diagonal + place) + {k - 1} AS last, count(DISTINCT place + j) / n AS share FROM hits JOIN runs USING (r, template, diagonal) CROSS JOIN range({k}) places(j) GROUP BY r, template, label, n, run),
enough AS (SELECT * FROM shares WHERE share >= CASE WHEN n < {licenses.SHORT} THEN 1.0 ELSE {licenses.COVERED} END),
found AS (SELECT r, label, share FROM enough s WHERE NOT EXISTS (SELECT 1 FROM enough t WHERE t.r = s.r AND t.label <> s.label AND t.first <= s.last AND s.first <= t.last AND (t.share > s.share OR t.share = s.share AND t.n > s.n))),
b AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION SELECT r, label FROM found) GROUP BY r),
s AS (SELECT r, max(share) AS share FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)
"""


ORACLE_SQL = {"op3_byte_shards": BYTE_SHARDS, "op9_license_scan": _license_scan(), "op10_decontaminate": DECONTAMINATE}
