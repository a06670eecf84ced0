"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from folio.llm.syncmers import UNIT

OP2 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS gram
  FROM item_words, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS t(i) WHERE len(w) > 0),
grams AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM words, (SELECT DISTINCT n FROM wins) AS lens, unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
found AS (SELECT doc_id, i, n, item_id FROM grams JOIN wins USING (n, gram)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM found) AS f, unnest(generate_series(i, i + n - 1)) AS t(p)
  GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM found) AS f GROUP BY doc_id),
posts AS (SELECT doc_id, w[i] AS term, i FROM words, unnest(generate_series(1, len(w))) AS t(i)),
rare AS (
  SELECT item_id, w, term, count(*) OVER (PARTITION BY item_id, w) AS need FROM (
    SELECT item_id, w, term, row_number() OVER (PARTITION BY item_id, w ORDER BY coalesce(tf, 0), term) AS nth
    FROM (SELECT DISTINCT item_id, w, unnest(w) AS term FROM item_words) LEFT JOIN (SELECT term, count(*) AS tf FROM posts GROUP BY term) USING (term)) AS r WHERE nth <= 3),
placed AS (SELECT doc_id, item_id, w, need, term, i FROM posts JOIN rare USING (term)),
near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
    SELECT a.doc_id, a.item_id, a.w, a.i FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.w = b.w AND b.i BETWEEN a.i - 12 AND a.i
    GROUP BY a.doc_id, a.item_id, a.w, a.i, a.need HAVING count(DISTINCT b.term) = a.need) AS m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)"""

OP6 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
own AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS src FROM own),
weighed AS (
  SELECT *, CASE src % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         (2 * source_size)::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total FROM named),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
shared AS (SELECT *, max(CASE WHEN level <= cap / weight THEN level END) OVER () AS common FROM levels),
targets AS (
  SELECT source, src, source_size,
         least(CASE WHEN level > cap / weight THEN cap ELSE coalesce(common, 0) * weight END, cap) AS target FROM shared),
goals AS (SELECT *, floor(target + 0.5)::BIGINT AS goal FROM targets),
total AS (SELECT greatest(coalesce(sum(goal), 0), 1)::BIGINT AS t FROM goals),
sizes AS (SELECT t, least(length(bin(t - 1)), greatest(16, length(bin((t + 63) // 64 - 1)))) AS bits FROM total),
plan AS (SELECT bits, ((t + (1::BIGINT << bits) - 1) // (1::BIGINT << bits))::BIGINT AS block FROM sizes),
spans AS (
  SELECT src, (upto - goal + block - 1) // block AS lo, (upto + block - 1) // block AS hi
  FROM (SELECT src, goal, sum(goal) OVER (ORDER BY src)::BIGINT AS upto FROM goals) AS g, plan),
points AS (SELECT j AS slot, ('0b' || reverse(lpad(bin(j), bits::INTEGER, '0')))::BIGINT AS point FROM plan, unnest(range(1::BIGINT << bits)) AS t(j)),
slots AS (SELECT src, slot, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank FROM points JOIN spans ON point >= lo AND point < hi),
reach AS (SELECT src, count(*) * any_value(block) AS reach FROM slots, plan GROUP BY src),
streams AS (
  SELECT sized.doc_id, size, source_size, target, src, coalesce(reach, 0) AS reach,
         sum(size) OVER (PARTITION BY src ORDER BY md5(coalesce(doc_id::VARCHAR, '')), size, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - size AS place
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source LEFT JOIN reach USING (src)),
parts AS (
  SELECT doc_id, src, place + k * source_size AS lo, least(place + k * source_size + size, reach) AS hi FROM streams, (VALUES (0), (1)) AS r(k)),
blocks AS (
  SELECT doc_id, src, lo, hi, block, r AS rank FROM parts, plan, unnest(range(lo // block, (hi - 1) // block + 1)) AS t(r) WHERE hi > lo),
found AS (
  SELECT doc_id, sum(least(hi, (rank + 1) * block) - greatest(lo, rank * block))::BIGINT AS taken, min(slot) AS first_slot
  FROM blocks JOIN slots USING (src, rank) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot FROM streams LEFT JOIN found USING (doc_id)"""

OP7 = r"""
WITH followed AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS nx
  FROM documents WINDOW o AS (ORDER BY doc_id)),
edits AS (
  SELECT doc_id, t, substring(t, 1, length(t) - length(t) // 4) || substring(nx, 1, length(t) // 4) AS ed FROM followed),
bodies AS (SELECT doc_id, 0 AS kind, t AS b FROM edits UNION ALL SELECT doc_id, 1, ed FROM edits),
units AS (
  SELECT *, regexp_extract_all(b, 'UNIT') AS u FROM bodies),
chosen AS (
  SELECT *, list_filter(range(1, greatest(len(u) - 2, 1)), lambda i: least(u[i], u[i + 3]) <= least(u[i + 1], u[i + 2])) AS c FROM units),
prints AS (
  SELECT doc_id, kind, length(b) AS n_chars, sha256(b) AS digest,
         list_sort(list_distinct(CASE WHEN len(c) > 0 THEN list_transform(c, lambda i: substring(md5(array_to_string(u[i:i + 3], ' ')), 1, 7))
           WHEN len(u) > 0 THEN [substring(md5(array_to_string(u, ' ')), 1, 7)] ELSE []::VARCHAR[] END)) AS fp FROM chosen),
sides AS (
  SELECT a.doc_id, a.n_chars, e.digest, a.fp AS f, e.fp AS ef, coalesce(lead(a.fp) OVER o, first_value(a.fp) OVER o) AS xf
  FROM prints a JOIN prints e ON a.doc_id = e.doc_id AND a.kind = 0 AND e.kind = 1 WINDOW o AS (ORDER BY a.doc_id)),
shared AS (SELECT *, len(list_intersect(f, ef)) AS same_e, len(list_intersect(f, xf)) AS same_x FROM sides)
SELECT doc_id, n_chars::BIGINT AS n_chars, digest AS edited_sha256, array_to_string(f, ',') AS fingerprint, array_to_string(ef, ',') AS edited_fingerprint,
       CASE WHEN f = ef THEN 1.0::DOUBLE ELSE same_e::DOUBLE / (len(f) + len(ef) - same_e) END AS near_edited,
       CASE WHEN f = xf THEN 1.0::DOUBLE ELSE same_x::DOUBLE / (len(f) + len(xf) - same_x) END AS near_next
FROM shared"""

OP7 = OP7.replace("UNIT", UNIT)

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
bodies AS (SELECT min(doc_id) AS node, s FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
posts AS (SELECT node, len(s) AS n, hash(x) AS x FROM (SELECT node, s, unnest(s) AS x FROM bodies)),
shared AS (
  SELECT a.node AS u, b.node AS v, a.n AS nu, b.n AS nv, count(*) AS common FROM posts a JOIN posts b ON a.x = b.x AND a.node < b.node GROUP BY ALL),
links AS (SELECT u, v FROM shared WHERE 100 * common >= 85 * (nu + nv - common)),
sides AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT node, node AS far FROM bodies UNION SELECT reach.node, sides.v FROM reach JOIN sides ON reach.far = sides.u),
classes AS (SELECT node, min(far) AS component_id FROM reach GROUP BY node),
named AS (SELECT sets.doc_id, len(sets.s) AS n, coalesce(classes.component_id, sets.doc_id) AS component_id
  FROM sets LEFT JOIN bodies ON list_sort(sets.s) = bodies.s LEFT JOIN classes USING (node))
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM named"""

OP12 = r"""
WITH RECURSIVE steps AS (
  SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) AS r(i) UNION ALL SELECT i, xor(v >> 1, (v & 1) * 3988292384), k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS l FROM steps WHERE k = 8),
own AS (
  SELECT conv_id, list(md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) ORDER BY turn NULLS FIRST, md5(coalesce(role, '')), md5(coalesce(text, ''))) AS t,
         list(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) ORDER BY turn NULLS FIRST, md5(coalesce(role, '')), md5(coalesce(text, ''))) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT conv_id, t, w, conv_id - conv_id % 20 AS of, xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM own, crc),
made AS (
  SELECT a.conv_id, coalesce(b.t[1:h], []) || a.t[h + 1:] AS t, coalesce(b.w[1:h], []) || a.w[h + 1:] AS w FROM heads a LEFT JOIN own b ON a.of = b.conv_id),
members AS (SELECT conv_id, d, t[1:d] AS k, CASE WHEN d = 0 THEN 0 ELSE w[d] END AS words, len(t) = d AS ends FROM made, unnest(generate_series(0, len(t))) AS g(d)),
nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends FROM members GROUP BY k, d),
children AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (k)),
below AS (
  SELECT k[1:a] AS k, sum((n_convs - 1) * words)::BIGINT AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM full_nodes, unnest(generate_series(0, d)) AS g(a) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, below.leaves AS n_leaves, below.saved AS saved_tokens, f.ends AS ends_sha256
FROM full_nodes f JOIN below USING (k) LEFT JOIN nodes p ON f.d > 0 AND p.k = f.k[1:f.d - 1]"""

OP13 = rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOWER.format("coalesce(text, '')")} AS t FROM documents),
listed AS (SELECT row_number() OVER () AS doc, lang, source, regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM docs),
posts AS (SELECT doc, lang, source, unnest(w) AS term FROM listed),
kept AS (SELECT lang, term FROM posts GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM posts JOIN kept USING (lang, term) GROUP BY ALL),
full_counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang)
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
own AS (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM full_counts JOIN kinds USING (lang)),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM full_counts GROUP BY lang, term) JOIN kinds USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
silent AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0 AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.lang NOT IN (SELECT lang FROM kinds)),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (FROM pairs UNION ALL FROM silent UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

ORACLES: dict[str, str] = {
    "op2_decontamination": OP2,
    "op6_source_mixing": OP6,
    "op7_syncmer_fingerprints": OP7,
    "op11_minhash_forest": OP11,
    "op12_conversation_trie": OP12,
    "op13_source_divergence": OP13,
}
