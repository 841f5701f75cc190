"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM x a JOIN x b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT i, j FROM p WHERE 100 * c >= 75 * (n + m - c)),
walk(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.j, w.root FROM walk w JOIN e ON e.i = w.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM walk GROUP BY doc_id)
SELECT s.doc_id, len(g) AS n_shingles, component_id, min(s.doc_id) OVER (PARTITION BY CASE WHEN len(g) = 0 THEN [CAST(s.doc_id AS VARCHAR)] ELSE list_sort(g) END) AS class_id FROM s JOIN c USING (doc_id)"""

MIXING = f"""
WITH RECURSIVE sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size, row_number() OVER () AS row FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
rk AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM src),
wt AS (SELECT *, [5, 2, 1][CAST(rank % 3 + 1 AS INT)] AS weight, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM rk),
rt AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM wt),
fl AS (SELECT a.*, (SELECT sum(least(CAST(b.cap AS DOUBLE), a.ratio * b.weight)) FROM rt b) <= a.total AS capped FROM rt a),
tg AS (SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * CAST(total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0) AS DOUBLE) / sum(weight) FILTER (WHERE NOT capped) OVER () END AS target FROM fl),
-- blocks of a source: of equal size but for one word, at most a 64th of the source; a source takes its first need blocks, again from the start after the last
b0 AS (SELECT *, greatest(1, least(greatest(1, least(1024, total // 65536)), source_size // 64)) AS most FROM tg),
b1 AS (SELECT *, greatest(1, CAST(ceil(source_size / CAST(most AS DOUBLE)) AS BIGINT)) AS blocks FROM b0),
bk AS (SELECT *, source_size // blocks AS words, source_size % blocks AS longer, CASE WHEN source_size > 0 THEN least(CAST(round(target / source_size * blocks) AS BIGINT), 3 * blocks) ELSE 0 END AS need FROM b1),
st AS (SELECT s.row, s.size, b.blocks, b.words, b.longer, b.need, CAST(coalesce(sum(s.size) OVER (PARTITION BY b.rank ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.size, s.row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM sized s JOIN bk b ON s.source IS NOT DISTINCT FROM b.source WHERE s.size > 0),
pt AS (SELECT *, unnest([start, start + size - 1]) AS word, unnest([0, 1]) AS side FROM st),
ib AS (SELECT *, CASE WHEN word < longer * (words + 1) THEN word // (words + 1) ELSE longer + (word - longer * (words + 1)) // greatest(words, 1) END AS block FROM pt),
ed AS (SELECT row, any_value(size) AS size, any_value(start) AS start, any_value(blocks) AS blocks, any_value(words) AS words, any_value(longer) AS longer, any_value(need) AS need, min(block) AS b, max(block) AS e FROM ib GROUP BY row),
pc AS (SELECT *, unnest(range(b, e + 1)) AS k FROM ed),
tk AS (SELECT row, sum((least(start + size, (k + 1) * words + least(k + 1, longer)) - greatest(start, k * words + least(k, longer))) * (need // blocks + CASE WHEN k < need % blocks THEN 1 ELSE 0 END)) AS taken FROM pc GROUP BY row)
SELECT s.doc_id, s.size, b.source_size, b.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken, s.source FROM sized s JOIN bk b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN tk t USING (row)"""

QUALITY = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line, t FROM d),
k AS (SELECT doc_id, source, t, line, {_FOLD.replace("coalesce(text, '')", f"array_to_string(regexp_extract_all(line, '{_WORD}'), ' ')")} AS key, len(regexp_extract_all(line, '{_WORD}')) AS n FROM l),
dup AS (SELECT doc_id, sum(c - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS c FROM k WHERE n > 0 GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT source, key, min(doc_id) AS keeper FROM k WHERE n > 0 GROUP BY 1, 2 HAVING count(DISTINCT t) > 20),
lost AS (SELECT doc_id, sum(n) AS lost FROM k JOIN f ON f.source IS NOT DISTINCT FROM k.source AND f.key = k.key WHERE n > 0 AND doc_id <> keeper GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
b AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_frequent_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN lost USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND 2 * n_frequent_words <= n_words AS kept FROM v"""

CHAT = r"""
WITH c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS chosen FROM conversations GROUP BY conv_id),
p AS (SELECT *, lag(conv_id) OVER (PARTITION BY chosen[1] ORDER BY conv_id) AS other_id FROM c),
j AS (SELECT p.conv_id, p.other_id, p.chosen, coalesce(o.chosen, list_concat(p.chosen[1:len(p.chosen) - 1], [{'role': p.chosen[-1].role, 'text': left(p.chosen[-1].text, length(p.chosen[-1].text) // 2)}])) AS rejected FROM p LEFT JOIN c o ON o.conv_id = p.other_id),
n AS (SELECT *, least(len(chosen), len(rejected)) AS m, list_position(list_transform(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i] = rejected[i]), false) AS d FROM j),
q AS (SELECT *, CAST(CASE WHEN d > 0 THEN d - 1 ELSE m END AS INT) AS k FROM n),
x AS (SELECT conv_id, other_id, k, chosen[1:k] AS a, chosen[k + 1:] AS b, rejected[k + 1:] AS r FROM q)
SELECT conv_id, other_id, k AS n_prompt_turns,
  array_to_string(list_transform(a, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS prompt,
  array_to_string(list_transform(b, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS chosen_text,
  array_to_string(list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS rejected_text,
  array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda i: b[i].role = 'assistant'), lambda i: (list_sum(list_transform(b[1:i], lambda t: length(t.role) + length(t.text) + 13)) - length(b[i].text) - 8) || ':' || list_sum(list_transform(b[1:i], lambda t: length(t.role) + length(t.text) + 13))), ',') AS chosen_mask,
  array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i: (list_sum(list_transform(r[1:i], lambda t: length(t.role) + length(t.text) + 13)) - length(r[i].text) - 8) || ':' || list_sum(list_transform(r[1:i], lambda t: length(t.role) + length(t.text) + 13))), ',') AS rejected_mask
FROM x"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first FROM s) WHERE doc_id > first),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM f),
p AS (SELECT doc_id, part, min(i) AS b, max(i) + 50 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM g) GROUP BY 1, 2),
k AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS since, row_number() OVER (PARTITION BY doc_id ORDER BY b DESC) = 1 AS last FROM p),
r AS (SELECT k.doc_id, CAST(sum(e - b) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (b - since)) || CASE WHEN last THEN substr(h, 2 * e + 1) ELSE '' END, '' ORDER BY b) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""

_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_FOLD}, '{_LETTERS}') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
f AS (SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n, v.v FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT *, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p, 1 + (1000000000 * (sum(n) OVER (PARTITION BY lang, term) + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM f),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INT) AS rank FROM o WHERE part = 'pair' OR r <= 50"""

PASSAGES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
s AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
f AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM s) WHERE c > 1),
p AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM f),
g AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM g ANTI JOIN p USING (r, i) GROUP BY r),
c AS (SELECT r, count(*) AS n_removed FROM p GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r) LEFT JOIN c USING (r)"""

_ALNUM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM documents),
g AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t GROUP BY 1, 2, 3, 4),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_FOLD}, '{_ALNUM}')) AS term FROM benchmark),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term), g GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM o WHERE rank <= 50"""

ORACLES = {
    "op2_ngram_jaccard_join": NGRAM_JOIN,
    "op3_mixing_sources": MIXING,
    "op4_quality_rules": QUALITY,
    "op7_chat_formatting": CHAT,
    "op10_suffix_array_dedup": SUBSTRINGS,
    "op11_source_divergence": DIVERGENCE,
    "op12_ranked_search": SEARCH,
    "op13_substring_dedup": PASSAGES,
}
