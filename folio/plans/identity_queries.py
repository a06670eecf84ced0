"""Queries over typed mentions, users' decisions, and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import chunks, identity, linkage
from folio.plans.prefix import running_total
from folio.plans.registry import documents, query
from folio.sources.adapters import OCCURRENCES, adapted, plain

MENTIONS = """
SELECT concat('m', lpad(CAST(c_custkey AS STRING), 7, '0')) AS mention, c_custkey AS n, CASE c_custkey % 3 WHEN 0 THEN 'organization' WHEN 1 THEN 'person' ELSE 'project' END AS kind,
  concat('Grand Firm ', CAST(c_custkey % 10 AS STRING), CASE CAST(floor(c_custkey / 30) AS INT) % 4 WHEN 0 THEN ' SAS' WHEN 1 THEN ' sarl' WHEN 2 THEN ' s.a.s.' ELSE '' END) AS name
FROM {customer}"""
SIGNALS = """
SELECT mention, signal, CASE WHEN signal = 'domain' AND n % 2 = 0 THEN 'gmail.com' ELSE concat(substr(signal, 1, 2), CAST(n % span AS STRING)) END AS value
FROM (SELECT concat('m', lpad(CAST(c_custkey AS STRING), 7, '0')) AS mention, c_custkey AS n FROM {customer}) AS c
JOIN (VALUES ('company_identifier', 4, 90), ('email', 2, 60), ('phone', 3, 30), ('domain', 5, 30), ('project_reference', 7, 30), ('customer_identity', 3, 6), ('address', 2, 30)) AS k(signal, every, span) ON n % every <> 0"""
BASE_SQL = rf"""WITH RECURSIVE mentions AS ({plain(MENTIONS)}), signals AS ({plain(SIGNALS)}),
  pairs AS (SELECT x.mention AS a, y.mention AS b FROM mentions x JOIN mentions y ON y.n = x.n + 30 OR y.n = x.n + 60 OR y.n = x.n + 10),
  named AS (SELECT *, trim(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS exact FROM mentions),
  cut AS (SELECT *, CASE WHEN ends_with(exact, ' s a s') THEN 's a s' WHEN ends_with(exact, ' sas') THEN 'sas' WHEN ends_with(exact, ' sarl') THEN 'sarl' ELSE '' END AS f FROM named),
  parts AS (SELECT mention, kind, exact, trim(left(exact, length(exact) - length(f))) AS core, nullif(replace(f, ' ', ''), '') AS form FROM cut),
  met AS (SELECT a, b, x.signal, bool_or(x.value = y.value) AS shared, min(CASE WHEN x.value = y.value THEN x.value END) AS v FROM pairs JOIN signals x ON x.mention = a JOIN signals y ON y.mention = b AND y.signal = x.signal GROUP BY ALL),
  total AS (SELECT a, b, sum(CASE WHEN NOT shared THEN 0 WHEN signal = 'domain' AND v = 'gmail.com' THEN 0.03 ELSE CASE signal WHEN 'company_identifier' THEN 0.72 WHEN 'project_reference' THEN 0.62 WHEN 'email' THEN 0.7 WHEN 'phone' THEN 0.55 WHEN 'domain' THEN 0.24 WHEN 'address' THEN 0.14 ELSE 0.22 END END)::DOUBLE AS s,
    list_sort(list(signal) FILTER (shared)) AS held, bool_or(NOT shared AND signal IN ('company_identifier', 'project_reference')) AS blocked FROM met GROUP BY a, b),
  j AS (SELECT p.a, p.b, l.kind AS ka, r.kind AS kb, l.exact = r.exact AS ex, l.core = r.core AND l.exact <> r.exact AND coalesce(l.form <> r.form, false) AS forms, l.core = r.core AS core,
    len(list_intersect(string_split(l.exact, ' '), string_split(r.exact, ' '))) / len(list_distinct(list_concat(string_split(l.exact, ' '), string_split(r.exact, ' ')))) >= 0.82 AS near, coalesce(s, 0) AS s, coalesce(held, []) AS held, coalesce(blocked, false) AS blocked
    FROM pairs p JOIN parts l ON l.mention = p.a JOIN parts r ON r.mention = p.b LEFT JOIN total t ON t.a = p.a AND t.b = p.b),
  sc AS (SELECT *, least(CASE WHEN ex THEN 0.62 WHEN forms THEN 0 WHEN core THEN 0.54 WHEN near THEN 0.34 ELSE 0 END + s, 1)::DOUBLE AS score, ex OR (core AND NOT forms) AS fits FROM j),
  judged AS (SELECT a, b, CASE WHEN ka = kb THEN score ELSE 0 END AS score, CASE WHEN ka = kb THEN array_to_string(held, ',') ELSE '' END AS evidence, CASE WHEN ka <> kb THEN 'unknown' WHEN blocked THEN 'keep_separate'
    WHEN score >= 0.97 AND CASE ka WHEN 'organization' THEN fits AND list_contains(held, 'company_identifier') WHEN 'person' THEN ex AND list_contains(held, 'email') AND list_contains(held, 'phone')
      ELSE list_contains(held, 'project_reference') AND list_contains(held, 'customer_identity') AND (fits OR list_contains(held, 'address')) END THEN 'auto_link' WHEN score >= 0.5 OR forms THEN 'review' ELSE 'unknown' END AS decision FROM sc)"""


def _mentions(spark, sf_dir):
    return adapted(spark, sf_dir, MENTIONS)


def _judged(spark, sf_dir):
    rows = _mentions(spark, sf_dir)
    steps = rows.select(F.col("mention").alias("a"), F.explode(F.array(*[F.col("n") + k for k in (10, 30, 60)])).alias("n"))
    pairs = steps.join(rows.select(F.col("mention").alias("b"), "n"), "n").select("a", "b")
    return linkage.assessed(pairs, rows, adapted(spark, sf_dir, SIGNALS))


@query(f"{BASE_SQL} SELECT a, b, round(score, 6) AS score, decision, evidence FROM judged")
def identity_typed_assessment(spark, sf_dir):
    return _judged(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(r"""WITH o AS (SELECT concat('c', c_custkey) AS k, trim(regexp_replace(lower(concat('Firm ', c_custkey % 60, CASE c_custkey % 4 WHEN 0 THEN ' SAS' WHEN 1 THEN ' SARL' WHEN 2 THEN '' ELSE ' S.A.S' END)), '[^\p{L}\p{N}]+', ' ', 'g')) AS name,
    concat('firm', c_custkey % 60, '.example') AS domain, CASE WHEN c_custkey % 7 <> 0 THEN concat('FR', lpad((c_custkey % 45)::VARCHAR, 9, '7')) END AS cid FROM customer
    UNION ALL SELECT concat('s', s_suppkey), trim(regexp_replace(lower(upper(concat('Firm ', s_suppkey % 60))), '[^\p{L}\p{N}]+', ' ', 'g')), CASE WHEN s_suppkey % 2 <> 0 THEN concat('firm', s_suppkey % 60, '.example') END, concat('FR', lpad((s_suppkey % 45)::VARCHAR, 9, '7')) FROM supplier),
  keys AS (SELECT k, 'name:' || name AS block, 1 AS r, 16 AS reach FROM o UNION ALL SELECT k, 'core:' || regexp_replace(name, ' (s a s|s a|sas|sarl|sa|ltd|inc|llc|gmbh)$', ''), 2, 16 FROM o
    UNION ALL SELECT k, 'domain:' || domain, 3, 16 FROM o WHERE domain IS NOT NULL UNION ALL SELECT k, 'id:' || cid, 0, 32 FROM o WHERE cid IS NOT NULL),
  sized AS (SELECT *, count(*) OVER (PARTITION BY block) AS members, row_number() OVER (PARTITION BY block ORDER BY k) AS i FROM keys),
  pairs AS (SELECT x.k AS a, y.k AS b, min(x.r) AS priority, count(*) AS blocks FROM sized x JOIN sized y ON x.block = y.block AND y.i > x.i AND y.i <= x.i + x.reach WHERE x.reach = 32 OR x.members <= 512 GROUP BY ALL)
  SELECT a, b, priority::BIGINT AS priority, blocks FROM pairs""")
def identity_priorities(spark, sf_dir):
    return identity.prioritised_pairs(identity.blocking_keys(identity.prepared(adapted(spark, sf_dir, OCCURRENCES))))


STORED_SQL = f"""{BASE_SQL}, links AS (SELECT a AS u, b AS v FROM judged WHERE decision = 'auto_link' UNION ALL SELECT b, a FROM judged WHERE decision = 'auto_link'),
  reach AS (SELECT mention AS node, mention AS root FROM mentions UNION SELECT v, root FROM reach JOIN links ON node = u), auto AS (SELECT node AS mention, min(root) AS auto FROM reach GROUP BY node),
  i0 AS (SELECT mention, CASE WHEN auto LIKE '%7' THEN 'm0000001' ELSE auto END AS identity, mention LIKE '%4' AS own FROM auto),
  ids AS (SELECT mention, CASE WHEN own THEN 'own:' || mention ELSE identity END AS identity, own OR identity IN (SELECT identity FROM i0 WHERE own) AS locked FROM i0)"""


def _stored(spark, sf_dir):
    rows = _mentions(spark, sf_dir)
    merges = rows.where("mention LIKE '%7'").select(F.lit("m0000001").alias("kept"), F.col("mention").alias("other"))
    return linkage.stored_identities(rows, _judged(spark, sf_dir).where("decision = 'auto_link'"), merges, rows.where("mention LIKE '%4'"))


@query(f"{STORED_SQL} SELECT * FROM ids")
def identity_decisions(spark, sf_dir):
    return _stored(spark, sf_dir)


@query(f"""{STORED_SQL}, s AS (SELECT identity, string_agg(x, ';' ORDER BY x) AS signals FROM (SELECT DISTINCT identity, signal || '=' || value AS x FROM ids JOIN signals USING (mention)) AS d GROUP BY identity)
  SELECT identity, count(*) AS mentions, arg_min(name, length(name) || name) AS name, coalesce(any_value(signals), '') AS signals FROM ids JOIN mentions USING (mention) LEFT JOIN s USING (identity) GROUP BY identity""")
def identity_detail(spark, sf_dir):
    return linkage.identity_detail(_stored(spark, sf_dir), _mentions(spark, sf_dir), adapted(spark, sf_dir, SIGNALS))


@query(f"{STORED_SQL} SELECT n % 40 AS file_id, kind AS relation, identity, count(*) AS mentions FROM mentions JOIN ids USING (mention) GROUP BY ALL")
def identity_file_relations(spark, sf_dir):
    rows = _mentions(spark, sf_dir).withColumn("file_id", F.col("n") % 40)
    return linkage.file_relations(rows, _stored(spark, sf_dir), "file_id", F.col("kind"))


CHUNKS_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 0),
  halves(doc_id, chunk, a, b) AS (SELECT doc_id, -1::BIGINT, 0::BIGINT, 0::BIGINT FROM d UNION ALL
    SELECT doc_id, chunk + 1, s, CASE WHEN n <= 768 OR s + 768 >= n THEN n WHEN cut IS NULL THEN s + 768 ELSE least(n, cut + ((greatest(0, 766 - (cut - s)) + 15) // 16) * 16) END
    FROM (SELECT *, CASE WHEN contains(h, chr(10)) THEN s + 768 - (instr(reverse(h), chr(10)) - 1) WHEN regexp_matches(h, '\s') THEN s + 768 - length(regexp_extract(h, '(\S*)$', 1)) END AS cut
      FROM (SELECT doc_id, chunk, s, n, substr(t, s + 385, 384) AS h FROM (SELECT doc_id, chunk, CASE WHEN chunk < 0 THEN 0 ELSE greatest(b - 96, a + 1) END AS s, b FROM halves) AS p JOIN d USING (doc_id) WHERE b < n) AS q) AS r),
  kept AS (SELECT doc_id, a, b, substr(t, a + 1, b - a) AS w FROM halves JOIN d USING (doc_id) WHERE chunk >= 0)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS chunk, a AS start_char, b AS end_char FROM kept WHERE regexp_matches(w, '\S')"""


@query(CHUNKS_SQL)
def semantic_chunks(spark, sf_dir):
    return chunks.windows(documents(spark, sf_dir), "doc_id", "text").select("doc_id", "chunk", "start_char", "end_char")


@query(r"""SELECT doc_id, unnest(range(len(p))) AS chunk, unnest(p) AS text FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s)(?:.{600}[^\s.]*[\s.]|.+)') AS p FROM documents) AS d""")
def text_fixed_chunks(spark, sf_dir):
    return chunks.fixed_chunks(documents(spark, sf_dir), "doc_id", "text", 600)


@query(r"""WITH c AS (SELECT doc_id, unnest(range(len(p))) AS chunk, md5(unnest(p)) AS digest FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s)(?:.{600}[^\s.]*[\s.]|.+)') AS p FROM documents) AS d),
  stored AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk) AS key FROM c), made AS (SELECT doc_id, chunk, CASE WHEN chunk % 2 = 0 THEN digest ELSE md5(digest) END AS digest FROM c WHERE doc_id % 3 = 0),
  f AS (SELECT m.*, row_number() OVER (ORDER BY m.doc_id, m.chunk) + (SELECT coalesce(max(key), 0) FROM stored) AS key FROM made m LEFT JOIN stored s USING (doc_id, chunk, digest) WHERE s.key IS NULL)
  SELECT doc_id, chunk, digest, key, doc_id % 3 = 0 AND chunk % 2 = 1 AS deleted FROM stored UNION ALL SELECT doc_id, chunk, digest, key, false FROM f""")
def chunk_replacement(spark, sf_dir):
    cut = chunks.fixed_chunks(documents(spark, sf_dir), "doc_id", "text", 600).select("doc_id", "chunk", F.md5("text").alias("digest"))
    stored = running_total(cut, [], F.expr("doc_id div 10000"), ["doc_id", "chunk"], F.lit(1).cast("long"), "_n")
    stored = stored.select("doc_id", "chunk", "digest", (F.col("_n") + 1).alias("key"), F.lit(False).alias("deleted"))
    made = cut.where("doc_id % 3 = 0").withColumn("digest", F.when(F.col("chunk") % 2 == 0, F.col("digest")).otherwise(F.md5("digest")))
    return chunks.replaced_chunks(stored, made, "doc_id")
