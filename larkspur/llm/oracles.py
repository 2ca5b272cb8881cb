"""DuckDB SQL of the queries that SQL can express, over whole tables and texts."""

from __future__ import annotations

from .quality import LEAST_WORDS, MOST_REPEATED_PERCENT, RULES, STOP_WORDS

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def suffix_dedup() -> str:
    return """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, unnest(range(1, octet_length(b) - 48)) AS i FROM d WHERE octet_length(b) >= 50),
w AS (SELECT p.doc_id, i, array_slice(b, i, i + 49) AS g FROM p JOIN d ON p.doc_id = d.doc_id),
m AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
s AS (SELECT doc_id, i, i + 50 AS e FROM w JOIN m ON w.g = m.g AND doc_id > first),
r AS (SELECT doc_id, i, e, CASE WHEN i > lag(e) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS fresh FROM s),
q AS (SELECT doc_id, i, e, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM r),
t AS (SELECT doc_id, min(i) AS a, max(e) AS z FROM q GROUP BY doc_id, island),
k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS a, a AS z FROM t UNION ALL SELECT doc_id, max(z), NULL FROM t GROUP BY doc_id),
h AS (SELECT d.doc_id, string_agg(hex(array_slice(b, k.a, coalesce(k.z, octet_length(b) + 1) - 1)), '' ORDER BY k.a) AS h FROM k JOIN d ON k.doc_id = d.doc_id WHERE coalesce(k.z, octet_length(b) + 1) > k.a GROUP BY d.doc_id),
c AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM t GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN c.doc_id IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN h ON d.doc_id = h.doc_id"""


def quality_rules() -> str:
    bounds = []
    for r in RULES:
        ratio = f"{r.numerator} / nullif({r.denominator}, 0)"
        bounds += [f"coalesce({ratio} >= {r.least}, true)"] * (r.least is not None) + [f"coalesce({ratio} <= {r.most}, true)"] * (r.most is not None)
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t WHERE n > 1) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations,
  len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
f AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       base_failed, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM f"""


def exact_top_k() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def ngram_jaccard() -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""
