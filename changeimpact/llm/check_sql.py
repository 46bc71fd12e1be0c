"""DuckDB SQL of the registered queries that SQL can express, written apart from the operators.

The others (seeded shuffles, learned patterns, tree scoring, quotation links, piece merging) are held against plain
versions in the tests.
"""

from changeimpact.llm import quality_rules as q

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ITEM_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS.format(_LOW)} AS ws FROM documents),
i AS (SELECT item_id, {_ITEM_WORDS.format(_LOW)} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, ws[k:k + 12] AS win FROM (SELECT *, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
n AS (SELECT DISTINCT len(win) AS n FROM w),
p AS (SELECT doc_id, k, ws[k:k + n - 1] AS win FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM d), n WHERE k + n - 1 <= len(ws)),
h AS (SELECT doc_id, k, len(w.win) AS n, item_id FROM p JOIN w ON p.win = w.win),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOW)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[k:k + 1] AS sh FROM (SELECT *, unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS k FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM m JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node WHERE r.root < u.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN c ON node = doc_id LEFT JOIN n USING (doc_id)"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS b FROM pages),
g AS (SELECT *, sha1(h) AS g, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, b AS payload_bytes, g AS payload_digest, CASE WHEN b >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= 1000 AND page_id <> top THEN top END AS refers_to FROM g"""

OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, k, sha256(array_to_string(ws[k:k + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS k FROM d WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY 1),
x AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS pos FROM w JOIN f ON w.h = f.h WHERE doc_id > first),
r AS (SELECT doc_id, count(*) AS n_removed FROM x GROUP BY 1),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.pos) AS kept FROM a LEFT JOIN x ON x.doc_id = a.doc_id AND x.pos = a.pos WHERE x.pos IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""


def _op6() -> str:
    cuts = ", ".join(f"('{r}', {i}, {c})" for r, cs in q.CUTOFFS.items() for i, c in enumerate(cs))
    p = q.RISK
    term = f"exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
tri AS (SELECT doc_id, k, ws[k:k + 2] AS g FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS k FROM d WHERE len(ws) >= 3)),
two AS (SELECT doc_id, g FROM tri GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT x) AS r FROM (SELECT tri.doc_id, unnest(range(k, k + 3)) AS x FROM tri JOIN two ON tri.doc_id = two.doc_id AND tri.g = two.g) GROUP BY 1),
b AS (SELECT d.doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(regexp_extract_all(t, '[!?]')) AS marks, len(regexp_extract_all(t, '\\p{{Lu}}')) AS caps,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls, coalesce(r, 0) AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
m AS (SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines FROM b),
v AS (SELECT doc_id, lang, unnest(['symbols', 'marks', 'repeats', 'same_lines', 'capitals']) AS rule, unnest([n_symbols / greatest(n_words, 1), marks / greatest(n_words, 1),
  n_repeat_words / greatest(n_words, 1), n_dup_lines / greatest(len(ls), 1), caps / greatest(word_chars, 1)]) AS x FROM m),
cuts(rule, step, cutoff) AS (VALUES {cuts}),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
k AS (SELECT lang, step, count(DISTINCT v.doc_id) AS n, count(DISTINCT v.doc_id) FILTER (x > cutoff) AS k
  FROM v JOIN good ON good.doc_id = v.doc_id JOIN cuts ON cuts.rule = v.rule GROUP BY 1, 2),
z AS (SELECT lang, step, CASE WHEN k >= n * {p} THEN 1 ELSE (SELECT sum({term}) FROM (SELECT unnest(range(0, k + 1)) AS j)) END
  <= {q.DELTA} / (SELECT count(DISTINCT lang) FROM k) AS ok FROM k),
s AS (SELECT *, bool_and(ok) OVER (PARTITION BY lang ORDER BY step) AS sure FROM z),
c AS (SELECT lang, max(step) AS step FROM s WHERE sure GROUP BY 1),
bad AS (SELECT DISTINCT doc_id FROM v JOIN c ON v.lang = c.lang JOIN cuts ON cuts.rule = v.rule AND cuts.step = c.step WHERE x > cutoff)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND bad.doc_id IS NULL AS kept FROM m LEFT JOIN bad ON bad.doc_id = m.doc_id"""


OP11 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
  AND list_bool_and(list_transform(e, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.93),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY 1),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node WHERE r.root < p.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""


ORACLES = {
    "op1_decontaminate": OP1, "op2_minhash": OP2, "op4_warc": OP4, "op5_substrings": OP5, "op6_quality_rules": _op6(),
    "op11_embeddings": OP11,
}
