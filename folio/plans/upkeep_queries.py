"""Queries over commits of several tables, paired renames, reconciliation, candidate pairs, signals, taxonomies, segments and development vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folio.operators import chunks, embedding, identity, matching, pathfit, reconcile, sinks, taxonomy
from folio.plans.lineage import kept, scratch
from folio.plans.registry import WATCH_SQL, documents, half_time, query
from folio.sources.adapters import OCCURRENCES, WATCH, adapted, plain
from folio.sources.commits import Tables
from folio.sources.tables import table
from folio.streaming import renames

# commits


class _Stopped(RuntimeError):
    pass


def _scanned(spark, sf_dir) -> Tables:
    """Two scans of the watched paths, before and after half time, committed; a third that fails between its tables; old files removed."""
    events = adapted(spark, sf_dir, WATCH)
    cut = F.lit(half_time(events)).cast("long")

    def write(folder: str) -> None:
        tables = Tables(spark, folder)

        def seen(part):
            last = F.max_by(F.struct("at_ms", "kind", "byte_size"), F.struct("at_ms", "seq")).alias("l")
            rows = part.groupBy(F.concat_ws(":", F.col("root_id").cast("string"), "path").alias("file"), "path").agg(last)
            return rows.select(
                "file", "path", F.col("l.byte_size").alias("byte_size"), F.md5(F.col("l.byte_size").cast("string")).alias("digest"), F.col("l.at_ms").alias("at"),
                (F.col("l.kind") != "removed").alias("readable"), F.when(F.col("l.kind") == "removed", "unreadable").alias("error"),
            )

        for scan, part in enumerate((events.where(F.col("at_ms") < cut), events.where(F.col("at_ms") >= cut)), 1):
            issues = part.where("kind = 'metadata'").select("path", F.col("kind").alias("code"))
            sinks.commit_scan(tables, scan, seen(part), issues, base=scan - 1)

        def stop(name: str) -> None:
            if name == "listed":
                raise _Stopped(name)

        try:
            sinks.commit_scan(tables, 3, seen(events).withColumn("byte_size", F.lit(-1).cast("long")), events.limit(0).select("path", F.col("kind").alias("code")), before_manifest=stop)
        except _Stopped:
            tables.vacuum()

    return Tables(spark, kept(spark, f"scans of {sf_dir}", write))


SCANS_SQL = f"""{WATCH_SQL}, cut AS (SELECT (min(at_ms) + max(at_ms)) // 2 AS c FROM watch),
  seen AS (SELECT CASE WHEN at_ms < c THEN 1 ELSE 2 END AS scan, concat(root_id, ':', path) AS file, path, at_ms AS at, byte_size, md5(byte_size::VARCHAR) AS digest, kind <> 'removed' AS readable FROM watch, cut
    QUALIFY row_number() OVER (PARTITION BY root_id, path, at_ms < c ORDER BY at_ms DESC, seq DESC) = 1),
  pair AS (SELECT coalesce(a.file, b.file) AS file, coalesce(a.path, b.path) AS path, a.at AS at1, b.at AS at2, a.byte_size AS s1, b.byte_size AS s2, a.digest AS d1, b.digest AS d2, a.readable AS r1, b.readable AS r2
    FROM (FROM seen WHERE scan = 1) AS a FULL JOIN (FROM seen WHERE scan = 2) AS b ON a.file = b.file),
  now AS (SELECT file, path, CASE WHEN at2 IS NULL THEN d1 ELSE d2 END AS digest, CASE WHEN at2 IS NULL THEN r1 ELSE r2 END AS readable FROM pair),
  renewed AS (SELECT *, at1 IS NOT NULL AND at2 IS NOT NULL AND s1 IS DISTINCT FROM s2 AS renewed FROM pair)"""


@query(f"""{SCANS_SQL} SELECT file, s1 AS byte_size, 1::BIGINT AS version, at1 AS valid_from, CASE WHEN renewed THEN at2 END AS valid_to FROM renewed WHERE at1 IS NOT NULL
  UNION ALL SELECT file, s2, CASE WHEN at1 IS NULL THEN 1 ELSE 2 END, at2, NULL FROM renewed WHERE at1 IS NULL OR renewed""")
def sink_scan_versions(spark, sf_dir):
    return _scanned(spark, sf_dir).read("versions").select("file", "byte_size", "version", "valid_from", "valid_to")


@query(f"{SCANS_SQL} SELECT digest, count(*) AS files, min(path) AS canonical FROM now WHERE readable AND digest IS NOT NULL GROUP BY digest HAVING count(*) > 1")
def sink_scan_duplicates(spark, sf_dir):
    return _scanned(spark, sf_dir).read("duplicates")


@query(f"""{SCANS_SQL} SELECT file, 'unreadable' AS reason, CASE WHEN NOT coalesce(r2, false) AND NOT (r2 IS NULL AND r1) AND (r2 IS NOT NULL OR NOT r1) THEN 'open' ELSE 'resolved' END AS status, ((NOT coalesce(r1, true))::INT + (NOT coalesce(r2, true))::INT)::BIGINT AS hits
  FROM pair WHERE NOT coalesce(r1, true) OR NOT coalesce(r2, true)""")
def sink_scan_reviews(spark, sf_dir):
    return _scanned(spark, sf_dir).read("reviews").select("file", "reason", "status", "hits")


@query(f"""{SCANS_SQL} SELECT s.scan::BIGINT AS scan, count(*) AS files, coalesce(sum(byte_size), 0)::BIGINT AS bytes, count(*) FILTER (NOT readable) AS errors,
  (SELECT count(*) FROM watch, cut WHERE kind = 'metadata' AND (at_ms < c) = (s.scan = 1)) AS issues FROM seen s GROUP BY s.scan""")
def sink_scan_metrics(spark, sf_dir):
    return _scanned(spark, sf_dir).read("metrics").select("scan", "files", "bytes", "errors", "issues")


def _analysed(spark, sf_dir) -> Tables:
    """Two extraction runs and two analyses of all documents, the second of each over those that the first left unsure."""
    docs = documents(spark, sf_dir)

    def write(folder: str) -> None:
        tables = Tables(spark, folder)
        file = F.col("doc_id").cast("string").alias("file")
        long = F.col("n_chars") > 3000
        status = F.when(F.col("text").isNull(), "failed").when(long, "partial").otherwise("success")
        first = docs.select(file, F.lit(1).cast("long").alias("batch"), F.lit(10).cast("long").alias("at"), status.alias("status"), F.md5("text").alias("text"), F.when(F.col("text").isNull(), "unreadable").alias("error"))
        sinks.commit_extractions(tables, first)
        again = first.where("status <> 'success'").withColumns({"batch": F.lit(2).cast("long"), "at": F.lit(20).cast("long"), "status": F.when(F.col("status") == "failed", "failed").otherwise("success"), "error": F.when(F.col("status") == "failed", "encrypted")})
        sinks.commit_extractions(tables, again)
        sure = F.when(long, 0.5).otherwise(0.9)
        made = docs.select(
            file, F.lit(1).cast("long").alias("analysis"), F.lit(11).cast("long").alias("at"), F.col("lang").alias("document_type"), F.col("source").alias("context"), sure.alias("confidence"),
            F.when(F.col("text").isNull(), "unknown").otherwise("success").alias("status"),
        )
        fields = lambda rows: rows.select("file", "analysis", F.lit("language").alias("field"), F.col("document_type").alias("value"), "confidence")
        sinks.commit_analyses(tables, made, fields(made))
        better = made.where("confidence < 0.65").withColumns({"analysis": F.lit(2).cast("long"), "at": F.lit(21).cast("long"), "confidence": F.lit(0.8), "document_type": F.concat(F.lit("long_"), "document_type")})
        sinks.commit_analyses(tables, better, fields(better))
        tables.vacuum()

    return Tables(spark, kept(spark, f"runs over {sf_dir}", write))


@query("""SELECT doc_id::VARCHAR AS file, CASE WHEN text IS NOT NULL THEN md5(text) END AS text, CASE WHEN n_chars > 3000 THEN 'long_' || lang ELSE lang END AS document_type, source AS context,
  CASE WHEN text IS NULL THEN 'unknown' ELSE 'success' END AS status FROM documents""")
def sink_search_rows(spark, sf_dir):
    return _analysed(spark, sf_dir).read("listed").select("file", "text", "document_type", "context", "status")


@query("""SELECT doc_id::VARCHAR AS file, 1::BIGINT AS analysis, lang AS document_type, coalesce(n_chars, 0) <= 3000 AS is_current FROM documents UNION ALL SELECT doc_id::VARCHAR, 2, 'long_' || lang, true FROM documents WHERE n_chars > 3000""")
def sink_analyses(spark, sf_dir):
    return _analysed(spark, sf_dir).read("analyses").select("file", "analysis", "document_type", "is_current")


# renames

HINTS = """
SELECT event_id AS seq, user_id % 3 AS root, CASE WHEN user_id % 13 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS native,
       CASE WHEN event_type IN ('purchase', 'error') THEN NULL ELSE concat('d', CAST(user_id % 7 AS STRING), '/', CAST(user_id AS STRING)) END AS path_before,
       CASE WHEN event_type IN ('signup', 'click') THEN NULL ELSE concat('d', CAST(user_id % 5 AS STRING), '/', CAST(user_id AS STRING), 'n') END AS path_after,
       CASE WHEN event_type = 'signup' THEN 'modified' ELSE 'moved' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'unknown' WHEN event_id % 3 = 1 THEN 'file' ELSE 'folder' END AS scope,
       unix_millis(CAST(ts AS TIMESTAMP)) AS at_ms
FROM {events}"""
PAIR_MS = 3_600_000
"""The test table's events lie hours apart."""


def _hints(spark, sf_dir):
    return adapted(spark, sf_dir, HINTS)


@query(f"""WITH h AS ({plain(HINTS)}), halves AS (SELECT *, row_number() OVER w AS i, path_after IS NOT NULL AS side FROM h WHERE kind = 'moved' AND (path_before IS NULL) <> (path_after IS NULL) AND native IS NOT NULL WINDOW w AS (PARTITION BY root, native ORDER BY at_ms, seq)),
  lists AS (SELECT root, native, list({{'s': side, 'at': at_ms, 'q': seq}} ORDER BY at_ms, seq) AS l FROM halves GROUP BY ALL),
  folded AS (SELECT root, native, list_reduce(list_prepend({{'wait': NULL::BIGINT, 'at': NULL::BIGINT, 'side': NULL::BOOLEAN, 'out': []::STRUCT(a BIGINT, b BIGINT)[]}}, list_transform(l, lambda x: {{'wait': x.q, 'at': x.at, 'side': x.s, 'out': []::STRUCT(a BIGINT, b BIGINT)[]}})),
    lambda p, x: CASE WHEN p.wait IS NULL THEN {{'wait': x.wait, 'at': x.at, 'side': x.side, 'out': p.out}}
      WHEN p.side <> x.side AND x.at - p.at <= {PAIR_MS} THEN {{'wait': NULL, 'at': NULL, 'side': NULL, 'out': list_append(p.out, {{'a': p.wait, 'b': x.wait}})}}
      ELSE {{'wait': x.wait, 'at': x.at, 'side': x.side, 'out': list_append(p.out, {{'a': p.wait, 'b': NULL::BIGINT}})}} END) AS f FROM lists),
  decided AS (SELECT unnest(f.out) AS o FROM folded UNION ALL SELECT {{'a': f.wait, 'b': NULL}} FROM folded WHERE f.wait IS NOT NULL),
  made AS (SELECT a.root, a.native, coalesce(a.path_before, b.path_before) AS path_before, coalesce(a.path_after, b.path_after) AS path_after, CASE WHEN b.seq IS NULL THEN 'rescan' ELSE 'moved' END AS kind,
    CASE WHEN b.seq IS NULL THEN 'unknown' WHEN a.scope = b.scope THEN a.scope WHEN a.scope = 'unknown' THEN b.scope WHEN b.scope = 'unknown' THEN a.scope ELSE 'unknown' END AS scope, coalesce(b.seq, a.seq) AS seq
    FROM decided JOIN h a ON a.seq = o.a LEFT JOIN h b ON b.seq = o.b)
  SELECT * FROM made UNION ALL SELECT root, native, path_before, path_after, CASE WHEN half THEN 'rescan' ELSE kind END, CASE WHEN half THEN 'unknown' ELSE scope END, seq
    FROM (SELECT *, kind = 'moved' AND (path_before IS NULL) <> (path_after IS NULL) AS half FROM h) AS x WHERE NOT half OR native IS NULL""")
def stream_paired_renames(spark, sf_dir):
    return renames.paired(_hints(spark, sf_dir), PAIR_MS).drop("at_ms")


MOVES = """
SELECT event_id AS seq, CAST(user_id AS STRING) AS native, concat('/home/', CASE user_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'a/b' WHEN 2 THEN 'c' ELSE 'out' END, '/', CAST(user_id AS STRING)) AS before,
  concat('/home/', CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'a/b' WHEN 2 THEN 'c' ELSE 'out' END, '/', CAST(event_id AS STRING)) AS after, 'file' AS scope, unix_millis(CAST(ts AS TIMESTAMP)) AS at_ms
FROM {events}"""


@query(f"""WITH m AS ({plain(MOVES)}), r(root, folder) AS (VALUES (1, '/home/a'), (2, '/home/a/b'), (3, '/home/c')),
  x AS (SELECT seq, root, CASE WHEN starts_with(before, folder || '/') THEN substr(before, length(folder) + 2) END AS path_before, CASE WHEN starts_with(after, folder || '/') THEN substr(after, length(folder) + 2) END AS path_after FROM m, r)
  SELECT seq, root::BIGINT AS root, path_before, path_after, CASE WHEN path_before IS NULL THEN 'created' WHEN path_after IS NULL THEN 'removed' ELSE 'moved' END AS kind FROM x WHERE path_before IS NOT NULL OR path_after IS NOT NULL""")
def stream_root_crossings(spark, sf_dir):
    roots = spark.createDataFrame([(1, "/home/a"), (2, "/home/a/b"), (3, "/home/c")], "root long, folder string")
    return renames.crossing(adapted(spark, sf_dir, MOVES), roots).select("seq", "root", "path_before", "path_after", "kind")


# reconciliation

LISTED = """
SELECT root_id AS root, concat('d', CAST(length(path) % 3 AS STRING), '/', CASE WHEN path LIKE '%7' THEN 'cache/' WHEN path LIKE '%5' THEN 'e/' ELSE '' END, path) AS path, byte_size, at_ms AS modified_ms, kind, before
FROM (SELECT root_id, path, byte_size, at_ms, kind, before, row_number() OVER (PARTITION BY root_id, path, before ORDER BY at_ms DESC, seq DESC) AS nth
      FROM (SELECT w.*, true AS before FROM ({watch}) AS w WHERE at_ms < {cut} UNION ALL SELECT w.*, false FROM ({watch}) AS w) AS u) AS v
WHERE nth = 1 AND kind <> 'removed'"""


def _sides(spark, sf_dir):
    cut = half_time(adapted(spark, sf_dir, WATCH))
    events = adapted(spark, sf_dir, WATCH)
    events.createOrReplaceTempView(name := f"watch_{uuid.uuid4().hex}")
    rows = spark.sql(LISTED.format(watch=f"SELECT * FROM {name}", cut=cut if cut is not None else 0))
    return rows.where("not before").drop("before", "kind"), rows.where("before").drop("before", "kind")


GAP_SQL = f"""{WATCH_SQL}, cut AS (SELECT (min(at_ms) + max(at_ms)) // 2 AS c FROM watch), rows AS ({LISTED.format(watch='SELECT * FROM watch', cut='(SELECT c FROM cut)')}),
  a AS (SELECT root, path, byte_size, modified_ms FROM rows WHERE NOT before), b AS (SELECT root, path, byte_size, modified_ms FROM rows WHERE before),
  x AS (SELECT coalesce(a.root, b.root) AS root, CASE WHEN a.path IS NULL THEN b.path END AS path_before, a.path AS path_after, coalesce(a.path, b.path) AS path,
    CASE WHEN b.path IS NULL THEN 'created' WHEN a.path IS NULL THEN 'removed' ELSE 'modified' END AS kind FROM a FULL JOIN b ON a.root = b.root AND lower(a.path) = lower(b.path)
    WHERE a.path IS NULL OR b.path IS NULL OR a.byte_size IS DISTINCT FROM b.byte_size OR a.modified_ms IS DISTINCT FROM b.modified_ms),
  gap AS (SELECT * FROM x WHERE NOT (path_after IS NOT NULL AND (contains(path, '/cache/') OR (root = 1 AND starts_with(path, 'd2/')))))"""


def _roots(spark):
    return spark.createDataFrame([(0, True, True, 10**9), (1, True, False, 10**9), (2, False, True, 10**9), (3, True, True, 10**9)], "root long, enabled boolean, complete boolean, entry_limit long")


def _excluded(spark):
    return spark.createDataFrame([(1, "D2")], "root long, folder string")


@query(f"{GAP_SQL} SELECT root, path_before, path_after, kind FROM gap WHERE root <> 2 AND (root <> 1 OR kind <> 'removed')")
def catalog_root_gaps(spark, sf_dir):
    listing, catalog = _sides(spark, sf_dir)
    return reconcile.root_gaps(listing, catalog, _roots(spark), _excluded(spark))[0]


@query(f"""{GAP_SQL} SELECT r.root::BIGINT AS root, CASE WHEN r.root = 2 THEN 0 ELSE count(g.root) FILTER (r.root <> 1 OR kind <> 'removed') END AS events,
  CASE WHEN r.root = 2 THEN 'skipped' WHEN r.root = 1 THEN 'deferred' WHEN count(g.root) = 0 THEN 'reconciled' ELSE 'reconciling' END AS state FROM (VALUES (0), (1), (2), (3)) AS r(root) LEFT JOIN gap g ON g.root = r.root GROUP BY r.root""")
def catalog_startup(spark, sf_dir):
    listing, catalog = _sides(spark, sf_dir)
    return reconcile.startup(listing, catalog, _roots(spark), _excluded(spark))[1]


@query(f"""{GAP_SQL} SELECT root, path_before, path_after, kind FROM x WHERE NOT (path_after IS NOT NULL AND contains(path, '/cache/')) AND ((root = 0 AND starts_with(path, 'd0/'))
  OR (root = 1 AND starts_with(path, 'd2/')) OR (root = 2 AND starts_with(path, 'd1/e/')))
  UNION ALL SELECT root, path, NULL, 'removed' FROM b WHERE root = 2 AND starts_with(path, 'd1/') AND NOT starts_with(path, 'd1/e/')""")
def catalog_directory_gaps(spark, sf_dir):
    listing, catalog = _sides(spark, sf_dir)
    # nested folders, one that was moved into its own subfolder's place, one whose listing is not complete
    changes = spark.createDataFrame(
        [(0, None, "d0", True), (0, "d0/e", "d0/e", True), (1, "d2", "d2", True), (1, None, "d0", False), (2, "d1", "d1/e", True)], "root long, folder_before string, folder_after string, complete boolean"
    )
    listing = listing.where("root <> 2 or path like 'd1/e/%' or path not like 'd1/%'")
    return reconcile.directory_gaps(listing, catalog, changes)[0]


# identities


def _ranked(spark, sf_dir):
    """Candidate pairs of all occurrences with the priority of their best block and the distance of their numbers."""
    return identity.prioritised_pairs(identity.blocking_keys(identity.prepared(adapted(spark, sf_dir, OCCURRENCES))))


@query(None)
def identity_capped(spark, sf_dir):
    """Pairs that remain when no mention may have more than four; tested against the sequential pass."""
    return matching.capped(_ranked(spark, sf_dir), ["priority", "blocks"], 4)


MENTIONED = """
SELECT l_orderkey AS doc, concat('m', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS source_id, CASE l_suppkey % 3 WHEN 0 THEN 'organization' WHEN 1 THEN 'person' ELSE 'project' END AS kind,
  CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_partkey % 40 * 50 AS BIGINT) END AS start FROM {lineitem}"""
FOUND = """
SELECT l_orderkey AS doc, concat('s', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS signal_id, CASE l_partkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'company_identifier' ELSE 'project_reference' END AS signal,
  CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE CAST(l_suppkey % 40 * 50 AS BIGINT) END AS start FROM {lineitem}"""


@query(f"""WITH m AS ({MENTIONED.format(lineitem='lineitem')}), s AS ({FOUND.format(lineitem='lineitem')}),
  e AS (SELECT s.doc, signal_id, source_id, abs(m.start - s.start) AS d, count(*) OVER (PARTITION BY s.doc, signal_id) AS n FROM s JOIN m ON m.doc = s.doc AND CASE kind WHEN 'organization' THEN signal <> 'project_reference' WHEN 'person' THEN signal IN ('email', 'phone') ELSE signal = 'project_reference' END),
  r AS (SELECT *, rank() OVER (PARTITION BY doc, signal_id ORDER BY d) AS k FROM e WHERE n > 1 AND d <= 500), t AS (SELECT *, count(*) OVER (PARTITION BY doc, signal_id) AS ties FROM r WHERE k = 1)
  SELECT doc, signal_id, source_id FROM e WHERE n = 1 UNION ALL SELECT doc, signal_id, source_id FROM t WHERE ties = 1""")
def identity_signals(spark, sf_dir):
    read = lambda sql: spark.sql(sql, lineitem=table(spark, sf_dir, "lineitem"))
    return matching.attached(read(MENTIONED), read(FOUND), "doc")


CANDIDATES = """
SELECT o_orderkey AS candidate, concat('i', CAST(o_custkey AS STRING)) AS a, concat('i', CAST(o_orderkey % 400 AS STRING)) AS b, CASE o_orderkey % 6 WHEN 0 THEN 'candidate' WHEN 1 THEN 'conflicting' WHEN 2 THEN 'user_confirmed' WHEN 3 THEN 'candidate' WHEN 4 THEN 'auto_linked' ELSE 'candidate' END AS status,
  o_orderkey % 10 <> 7 AS active, CASE WHEN o_orderkey % 5 = 0 THEN 'r1' ELSE 'r2' END AS version, concat('g', CAST(o_custkey % 50 AS STRING)) AS review_group FROM {orders}"""


@query(f"""WITH c AS ({CANDIDATES.format(orders='orders')}), live AS (SELECT concat('i', c_custkey) AS i FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT concat('i', c_custkey) AS i FROM customer WHERE c_custkey % 8 = 0),
  w AS (SELECT *, CASE WHEN NOT (active AND status IN ('candidate', 'conflicting')) THEN NULL WHEN a IN (FROM new) OR b IN (FROM new) THEN 'changed' WHEN version <> 'r2' THEN 'outdated' WHEN a NOT IN (FROM live) OR b NOT IN (FROM live) THEN 'orphaned' END AS why FROM c)
  SELECT candidate, CASE WHEN why IS NULL THEN status ELSE 'superseded' END AS status, active AND why IS NULL AS active, why AS retired_for FROM w""")
def identity_superseded(spark, sf_dir):
    rows = spark.sql(CANDIDATES, orders=table(spark, sf_dir, "orders"))
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("identity"), F.col("c_custkey").alias("k"))
    out = matching.superseded(rows, people.select("identity", (F.col("k") % 3 != 0).alias("active")), people.where("k % 8 = 0"), "r2")
    return out.select("candidate", "status", "active", "retired_for")


# taxonomies

EDGES = """
SELECT CAST(l_partkey % 90 AS BIGINT) AS parent, CAST(l_partkey % 90 + 8 + l_suppkey % 12 AS BIGINT) AS child FROM {lineitem}
UNION ALL SELECT CAST(200 + c_custkey AS BIGINT), CAST(201 + c_custkey AS BIGINT) FROM {customer}
UNION ALL SELECT CAST(30 + n_nationkey AS BIGINT), CAST(20 + n_nationkey AS BIGINT) FROM {nation} WHERE n_nationkey < 3"""


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT parent, child FROM ({EDGES.format(lineitem='lineitem', customer='customer', nation='nation')}) AS x), small AS (SELECT * FROM e WHERE parent < 200),
  reach AS (SELECT parent AS u, child AS v FROM small UNION SELECT u, child FROM reach JOIN small ON v = parent), ring AS (SELECT DISTINCT u FROM reach WHERE u = v),
  below AS (SELECT u AS n FROM ring UNION SELECT v FROM reach WHERE u IN (FROM ring)), above AS (SELECT u AS n FROM ring UNION SELECT u FROM reach WHERE v IN (FROM ring))
  SELECT parent, child FROM small WHERE parent IN (FROM below) AND child IN (FROM above)""")
def taxonomy_cycles(spark, sf_dir):
    edges = spark.sql(EDGES, **{n: table(spark, sf_dir, n) for n in ("lineitem", "customer", "nation")})
    return taxonomy.cyclic(edges)


# segments and vectors

STRUCTURED = """
SELECT doc_id, concat('filename: doc_', CAST(doc_id AS STRING)) AS metadata,
  CASE lang WHEN 'de' THEN replace(text, chr(10), chr(12)) WHEN 'fr' THEN concat('intro', chr(10), 'Feuille : ', coalesce(source, 'x'), chr(10), replace(text, chr(10), concat(chr(10), 'slide 2', chr(10))))
    WHEN 'es' THEN replace(text, chr(10), concat(chr(10), chr(10))) ELSE text END AS text
FROM {documents}"""

SEGMENT_SQL = rf"""WITH RECURSIVE raw AS ({plain(STRUCTURED)}), docs AS (SELECT doc_id, metadata, text AS t FROM raw WHERE regexp_matches(text, '\S')),
  kinds AS (SELECT *, CASE WHEN contains(t, chr(12)) THEN 'page' WHEN regexp_matches(t, '(?im)^(?:sheet|feuille|slide|diapositive)\s*[:#-]?\s*(.+)$') THEN 'part' ELSE 'paragraph' END AS k FROM docs),
  pieces AS (SELECT doc_id, k, t, string_split(t, CASE k WHEN 'page' THEN chr(12) WHEN 'part' THEN chr(10) ELSE chr(10) || chr(10) END) AS p, CASE k WHEN 'paragraph' THEN 2 ELSE 1 END AS w FROM kinds),
  placed AS (SELECT doc_id, k, t, i, p[i] AS x, coalesce(list_sum(list_transform(p[1:i - 1], lambda y: length(y) + w)), 0)::BIGINT AS a FROM pieces, unnest(range(1, len(p) + 1)) AS g(i)),
  marked AS (SELECT *, k = 'part' AND regexp_matches(x, '(?i)^(?:sheet|feuille|slide|diapositive)\s*[:#-]?\s*(.+)$') AS m FROM placed),
  grouped AS (SELECT *, CASE WHEN k = 'part' THEN sum(m::INT) OVER (PARTITION BY doc_id ORDER BY i) ELSE i END AS g FROM marked),
  named AS (SELECT doc_id, k, g, any_value(t) AS t, min(a) FILTER (NOT m) AS a, max(a + length(x)) FILTER (NOT m) AS b, any_value(left(trim(regexp_extract(x, '(?i)^(?:sheet|feuille|slide|diapositive)\s*[:#-]?\s*(.+)$', 1)), 80)) FILTER (m) AS part FROM grouped GROUP BY ALL),
  cut AS (SELECT *, substr(t, a + 1, b - a) AS s FROM named WHERE b > a),
  full_segments AS (SELECT doc_id, k, g, part, a + length(s) - length(regexp_replace(s, '^\s+', '')) AS a, regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '') AS s FROM cut WHERE regexp_matches(s, '\S')),
  alone AS (SELECT doc_id FROM full_segments WHERE k = 'paragraph' GROUP BY doc_id HAVING count(*) = 1),
  segs AS (SELECT f.doc_id, k, g, part, CASE WHEN o.doc_id IS NULL THEN a ELSE 0 END AS pos, CASE WHEN o.doc_id IS NULL THEN s ELSE t END AS t, length(CASE WHEN o.doc_id IS NULL THEN s ELSE t END) AS n FROM full_segments f LEFT JOIN alone o USING (doc_id) LEFT JOIN docs USING (doc_id)),
  halves(doc_id, g, c, a, b) AS (SELECT doc_id, g, -1::BIGINT, 0::BIGINT, 0::BIGINT FROM segs UNION ALL
    SELECT doc_id, g, c + 1, s, CASE WHEN n <= 768 OR s + 768 >= n THEN n WHEN cut IS NULL THEN s + 768 ELSE least(n, cut + ((greatest(0, 766 - (cut - s)) + 15) // 16) * 16) END
    FROM (SELECT *, CASE WHEN contains(h, chr(10)) THEN s + 768 - (instr(reverse(h), chr(10)) - 1) WHEN regexp_matches(h, '\s') THEN s + 768 - length(regexp_extract(h, '(\S*)$', 1)) END AS cut
      FROM (SELECT doc_id, g, c, s, n, substr(t, s + 385, 384) AS h FROM (SELECT doc_id, g, c, CASE WHEN c < 0 THEN 0 ELSE greatest(b - 96, a + 1) END AS s, b FROM halves WHERE c < 16) AS p JOIN segs USING (doc_id, g) WHERE b < n) AS q) AS r),
  windows AS (SELECT doc_id, g, k, part, pos + a AS start_char, pos + b AS end_char, row_number() OVER (PARTITION BY doc_id ORDER BY pos, a) AS chunk FROM halves JOIN segs USING (doc_id, g) WHERE c >= 0 AND regexp_matches(substr(t, a + 1, b - a), '\S')),
  held AS (SELECT *, max(chunk) OVER (PARTITION BY doc_id) > 16 AS truncated FROM windows)
  SELECT doc_id, chunk, 'text_chunk' AS kind, start_char, end_char, CASE WHEN k = 'page' THEN g::BIGINT END AS page, part, truncated FROM held WHERE chunk <= 16
  UNION ALL SELECT doc_id, 0, 'semantic_summary', NULL, NULL, NULL, NULL, coalesce((SELECT bool_or(truncated) FROM held h WHERE h.doc_id = raw.doc_id), false) FROM raw"""


@query(SEGMENT_SQL)
def semantic_segments(spark, sf_dir):
    return chunks.structured_chunks(adapted(spark, sf_dir, STRUCTURED), "doc_id", "text", "metadata").drop("text")


TITLES = """
SELECT doc_id, concat_ws(' ', CASE doc_id % 5 WHEN 0 THEN 'facture client' WHEN 1 THEN 'devis chantier' WHEN 2 THEN 'photo' ELSE 'note' END, coalesce(source, ''), substr(coalesce(text, ''), 1, 400)) AS text FROM {documents}"""
FEATURES_SQL = rf"""WITH t AS ({plain(TITLES)}), w0 AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 2) AS w FROM t),
  w AS (SELECT doc_id, w || (CASE WHEN list_contains(w, 'facture') THEN ['invoice', 'billing'] ELSE [] END) || (CASE WHEN list_contains(w, 'devis') THEN ['quote', 'estimate'] ELSE [] END)
    || (CASE WHEN list_contains(w, 'chantier') THEN ['project', 'construction'] ELSE [] END) || (CASE WHEN list_contains(w, 'client') THEN ['customer'] ELSE [] END) || (CASE WHEN list_contains(w, 'photo') THEN ['image', 'picture'] ELSE [] END) AS w FROM w0),
  f AS (SELECT doc_id, unnest(w) AS x, 20 AS u FROM w UNION ALL SELECT doc_id, substr(x, i, 3), 7 FROM (SELECT doc_id, unnest(w) AS x FROM w) AS y, unnest(range(1, length(x) - 1)) AS g(i)
    UNION ALL SELECT doc_id, w[i] || ':' || w[i + 1], 11 FROM w, unnest(range(1, len(w))) AS g(i)),
  h AS (SELECT doc_id, ('0x' || substr(md5(x), 1, 4))::BIGINT % 256 AS bucket, sum(CASE WHEN ('0x' || substr(md5(x), 5, 2))::BIGINT % 2 = 0 THEN u ELSE -u END)::BIGINT AS s FROM f GROUP BY ALL HAVING sum(CASE WHEN ('0x' || substr(md5(x), 5, 2))::BIGINT % 2 = 0 THEN u ELSE -u END) <> 0),
  v AS (SELECT doc_id, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)) AS weight FROM h)"""


def _vectors(spark, sf_dir):
    return embedding.development(adapted(spark, sf_dir, TITLES), "doc_id", "text")


@query(f"{FEATURES_SQL} SELECT doc_id, bucket, round(weight, 6)::DOUBLE AS weight FROM v")
def vector_development(spark, sf_dir):
    return _vectors(spark, sf_dir).withColumn("weight", F.round("weight", 6))


ASKED = "SELECT item_id, text FROM {benchmark}"


@query(None)
def vector_semantic_topk(spark, sf_dir):
    """The ten nearest documents of every benchmark item by development vectors; tested against all cosines."""
    asked = embedding.development(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "text")
    return embedding.similar(_vectors(spark, sf_dir), asked, "doc_id", "item_id", 10)


# paths

LONG_PATHS = """
SELECT doc_id, array(concat('Folder ', coalesce(lang, '?')), substr(replace(coalesce(text, 'none'), chr(10), ' '), 1, CAST(1 + doc_id % 90 AS INT)), concat('a<b>:', coalesce(source, '?'), '.'), substr(replace(coalesce(text, 'none'), chr(10), ' '), 5, 70), 'con', 'sixth', 'seventh') AS folders,
  concat(substr(replace(coalesce(text, ' '), chr(10), ' '), 20, CAST(doc_id % 170 AS INT)), '.pdf') AS name FROM {documents}"""


@query(None)
def path_fitted(spark, sf_dir):
    """Machine-made paths of all documents brought within the limits; tested against a plain pass in UTF-16."""
    rows = pathfit.fitted(adapted(spark, sf_dir, LONG_PATHS), "folders", "name", 6)
    return rows.select("doc_id", F.array_join("fit.folders", "\\").alias("folder"), F.col("fit.name").alias("name"), F.col("fit.changed").alias("changed"), F.col("fit.valid").alias("valid"))


def folder_for_tests(spark) -> str:
    """A fresh folder among this session's stored tables."""
    return f"{scratch(spark)}/tables-{uuid.uuid4().hex}"
