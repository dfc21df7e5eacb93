"""DuckDB SQL for the results of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

#: All pairs that share a shingle are counted, so links are exact; components by repeated least labels.
NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d
JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1) c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

#: Every 100-byte string by its hexadecimal digits; runs of removed bytes from the starts.
REPEATS = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, i, x[2 * i + 1:2 * i + 200] AS w FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM h WHERE len(x) >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM
  (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS before FROM r)),
z AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
keep AS (SELECT doc_id, a AS stop, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS start, b - a AS gone FROM z),
t AS (SELECT doc_id, max(b) AS last, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS n FROM z GROUP BY 1),
k AS (SELECT k.doc_id, string_agg(x[2 * start + 1:2 * stop], '' ORDER BY start) AS x FROM keep k JOIN h ON h.doc_id = k.doc_id GROUP BY 1)
SELECT h.doc_id, CAST(len(h.x) // 2 AS BIGINT) AS n_bytes, coalesce(t.gone, 0) AS n_removed, coalesce(t.n, 0) AS n_spans,
  sha256(unhex(CASE WHEN t.n IS NULL THEN h.x ELSE k.x || h.x[2 * t.last + 1:] END)) AS kept_sha256
FROM h LEFT JOIN t ON t.doc_id = h.doc_id LEFT JOIN k ON k.doc_id = h.doc_id"""


#: Written out, so that they don't follow the operator's own rules: the bits of the rules that failed.
FAILURES = """CASE WHEN n_words < 50 THEN 1 ELSE 0 END
  + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 4 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 8 ELSE 0 END
  + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END
  + CASE WHEN n_upper > n_lower THEN 32 ELSE 0 END"""

RULE_LEDGER = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(text='text')} AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
t AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM t) WHERE k > 1),
m AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM d, (SELECT unnest([0, 1, 2]) AS j) GROUP BY 1),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(m.n, 0) AS n_repeat_words,
  len(text) - len(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, len(text) - len(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower
  FROM w LEFT JOIN m ON m.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed,
  failures & 63 = 0 AS kept, failures FROM (SELECT *, CAST({FAILURES} AS BIGINT) AS failures FROM f)"""

_LETTERS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = rf"""WITH d AS (SELECT doc_id, {_LETTERS} AS ws FROM documents), b AS (SELECT item_id, {_LETTERS} AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
s AS (SELECT DISTINCT n FROM p),
x AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, s WHERE len(ws) >= n)),
h AS (SELECT x.doc_id, p.item_id, x.i, x.n FROM x JOIN p ON p.g = x.g AND p.n = x.n),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS k FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.k, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

#: Three rounds written out; the remainder is made positive first, so that division is by floor.
CLUSTERS = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS id
  FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 16)),
""" + "".join(
    f"""a{k} AS (SELECT id, any_value(v) AS v, min(d * 16 + c) AS dc FROM (SELECT id, v, c, CAST(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM v, c{k}) GROUP BY id),
s{k} AS (SELECT dc % 16 AS c, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT v, dc, unnest(range(1, 65)) AS i FROM a{k}) GROUP BY 1, 2),
c{k + 1} AS (SELECT c.c, coalesce(n.m, c.m) AS m FROM c{k} c LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{k} GROUP BY c) n ON n.c = c.c),
"""
    for k in range(3)
) + """a3 AS (SELECT id, min(d * 16 + c) AS dc FROM (SELECT id, c, CAST(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c3) GROUP BY id)
SELECT vec_id, CAST(dc % 16 AS INTEGER) AS cluster, CAST(dc // 16 AS BIGINT) AS distance, CAST(sum(dc // 16) OVER (PARTITION BY dc % 16) AS BIGINT) AS cluster_inertia,
  CAST(sum(dc // 16) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a3 JOIN v ON v.id = a3.id JOIN c3 ON c3.c = dc % 16"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_APART = "CAST(((p - q) * (p - q)) // (p + q) AS BIGINT)"

#: Every group has every kept term of its language, written out.
DIVERGENCE = rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(ts)) AS t FROM d) GROUP BY 1, 2 HAVING count(*) >= 10),
n AS (SELECT lang, source, t, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS t FROM d) SEMI JOIN k USING (lang, t) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
gn AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY 1, 2),
ln AS (SELECT lang, t, sum(n) AS n FROM n GROUP BY 1, 2),
lt AS (SELECT lang, sum(n) AS total FROM ln GROUP BY 1),
p AS (SELECT g.lang, g.source, k.t, coalesce(n.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 2)) // (coalesce(gn.total, 0) + 2 * v.v) AS BIGINT) AS p
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.t = k.t),
q AS (SELECT ln.lang, ln.t, CAST(1 + (1000000000::HUGEINT * (ln.n + 2)) // (lt.total + 2 * v.v) AS BIGINT) AS q FROM ln JOIN lt USING (lang) JOIN v USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tops AS (SELECT lang, source, 'term' AS part, t AS item, {_APART} AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops)) WHERE part = 'pair' OR rank <= 10"""

ORACLES: dict[str, str] = {"op1_near_duplicates": NEAR, "op2_repeats": REPEATS, "op4_rules": RULE_LEDGER, "op9_decontaminate": DECONTAMINATE, "op11_ball_clusters": CLUSTERS, "op13_source_divergence": DIVERGENCE}
