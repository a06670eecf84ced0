"""Queries over merges, history, decisions and derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import catalog, maintenance, search
from folio.plans.registry import FACTS_SQL, FILES_SQL, STATES_SQL, TOKENS_SQL, WATCH_SQL, documents, files, half_time, query, states
from folio.sources.adapters import FACTS, WATCH, adapted
from folio.sources.tables import table
from folio.streaming import watch

KEY, ORDER = ["root_id", "path"], ["at_ms", "seq"]


def _halves(spark, sf_dir):
    """Events before half time, and those from then on."""
    events = adapted(spark, sf_dir, WATCH)
    cut = F.lit(half_time(events)).cast("long")
    return events.where(F.col("at_ms") < cut), events.where(F.col("at_ms") >= cut)


@query(f"{STATES_SQL} SELECT root_id, path, seq, kind, byte_size FROM full_state WHERE kind <> 'removed'")
def state_upsert(spark, sf_dir):
    before, after = _halves(spark, sf_dir)
    columns = [*KEY, *ORDER, "kind", "byte_size"]
    current = maintenance.upsert(before.select(*columns).limit(0), before, KEY, ORDER)
    return maintenance.upsert(current, after, KEY, ORDER, F.col("kind") == "removed").select("root_id", "path", "seq", "kind", "byte_size")


@query(f"""{WATCH_SQL}, o AS (SELECT root_id, path, at_ms, max(kind) AS kind FROM watch GROUP BY ALL),
  c AS (SELECT *, lag(kind) OVER w IS DISTINCT FROM kind AS fresh FROM o WINDOW w AS (PARTITION BY root_id, path ORDER BY at_ms))
  SELECT root_id, path, kind, row_number() OVER w AS version, at_ms AS valid_from, lead(at_ms) OVER w AS valid_to FROM c WHERE fresh WINDOW w AS (PARTITION BY root_id, path ORDER BY at_ms)""")
def state_history_merge(spark, sf_dir):
    empty = spark.createDataFrame([], "root_id long, path string, kind string, version long, valid_from long, valid_to long")
    history = empty
    for part in _halves(spark, sf_dir):
        history = maintenance.scd2_merge(history, part, KEY, "at_ms", ["kind"])
    return history


@query(f"""{STATES_SQL} SELECT * FROM (SELECT h.root_id, h.path, concat_ws(',', CASE WHEN h.byte_size IS DISTINCT FROM f.byte_size THEN 'byte_size' END, CASE WHEN h.kind IS DISTINCT FROM f.kind THEN 'kind' END) AS reason
  FROM half h JOIN full_state f USING (root_id, path)) AS d WHERE reason <> ''""")
def organize_drift(spark, sf_dir):
    return maintenance.drift(*states(spark, sf_dir), KEY, ["byte_size", "kind"])


@query(f"""{FACTS_SQL}, c AS (SELECT customer_name, arg_max(coalesce(currency, 'none'), file_id) AS currency FROM facts WHERE user_confirmed GROUP BY customer_name)
  SELECT customer_name, coalesce(c.currency, 'EUR') AS currency, c.currency IS NOT NULL AS corrected FROM (SELECT DISTINCT customer_name FROM facts) AS m LEFT JOIN c USING (customer_name)""")
def semantic_corrections(spark, sf_dir):
    rows = adapted(spark, sf_dir, FACTS).withColumn("currency", F.coalesce("currency", F.lit("none")))
    machine = rows.select("customer_name").distinct().withColumn("currency", F.lit("EUR"))
    return maintenance.overlay(machine, rows.where("user_confirmed"), ["customer_name"], "currency", ["file_id"])


NEW_TEXTS = "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.text ELSE d.lang || ' ' || d.source END AS text FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) AS l ON d.doc_id = l.doc_id"


def _index(spark, sf_dir):
    """The token index after every labelled document got a new text, and the documents as they are then."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    named = table(spark, sf_dir, "labels").select("doc_id").distinct()
    renewed = docs.withColumn("text", F.when(F.col("lang").isNotNull() & F.col("source").isNotNull(), F.concat_ws(" ", "lang", "source"))).join(named, "doc_id", "left_semi")
    build = lambda rows: search.token_lists(rows, "doc_id", "text")
    return maintenance.replaced_index(build(docs), renewed, "doc_id", build), docs.join(named, "doc_id", "left_anti").unionByName(renewed)


@query(f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS token FROM ({NEW_TEXTS}) AS n) AS t GROUP BY token")
def search_index_refresh(spark, sf_dir):
    index, _ = _index(spark, sf_dir)
    return index.select(F.inline("counts")).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"""WITH stored AS (SELECT doc_id, unnest({TOKENS_SQL}) AS token FROM documents), now AS (SELECT doc_id, CASE WHEN doc_id % 30 = 1 THEN left(text, 200) ELSE text END AS text FROM documents WHERE doc_id % 40 <> 0),
  a AS (SELECT doc_id, token, count(*) AS tf FROM stored GROUP BY ALL), b AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS token FROM now) AS n GROUP BY ALL)
  SELECT 'stale' AS side, count(*) AS differences FROM (FROM a EXCEPT FROM b) AS x HAVING count(*) > 0 UNION ALL SELECT 'absent', count(*) FROM (FROM b EXCEPT FROM a) AS y HAVING count(*) > 0""")
def search_index_check(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    now = docs.where("doc_id % 40 <> 0").withColumn("text", F.when(F.col("doc_id") % 30 == 1, F.left("text", F.lit(200))).otherwise(F.col("text")))
    stored, wanted = (search.token_lists(rows, "doc_id", "text") for rows in (docs, now))
    return maintenance.document_differences(stored, wanted, "doc_id", "counts").groupBy("side").agg(F.count("*").alias("differences"))


@query("""WITH h AS (SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL), s AS (SELECT digest, max(doc_id) AS vector FROM h JOIN (SELECT DISTINCT doc_id FROM labels) AS l USING (doc_id) GROUP BY digest)
  SELECT doc_id, vector, vector IS NOT NULL AS reused FROM h LEFT JOIN s USING (digest)""")
def embedding_reuse(spark, sf_dir):
    wanted = documents(spark, sf_dir).where("text is not null").select("doc_id", F.md5("text").alias("digest"))
    stored = wanted.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("digest", F.col("doc_id").alias("vector"))
    return maintenance.reuse(wanted, stored, "doc_id", "digest", "vector").select("doc_id", "vector", "reused")


@query(f"{STATES_SQL} SELECT f.root_id, f.path, f.kind FROM full_state f LEFT JOIN half h USING (root_id, path) WHERE h.path IS NULL OR f.kind <> h.kind")
def state_work_list(spark, sf_dir):
    half, full = states(spark, sf_dir)
    return maintenance.to_process(full.select(*KEY, "kind"), half, KEY, ["kind"])


@query(f"""{FACTS_SQL}, k AS (SELECT file_id, 'customer' AS kind, lower(customer_name) AS key FROM facts UNION ALL SELECT file_id, 'folder', currency || '/' || substr(iso_date, 1, 7) FROM facts),
  t AS (SELECT DISTINCT kind, key FROM k JOIN facts USING (file_id) WHERE user_confirmed)
  SELECT DISTINCT file_id FROM k JOIN t USING (kind, key) UNION SELECT file_id FROM facts WHERE user_confirmed""")
def organize_neighbourhood(spark, sf_dir):
    rows = adapted(spark, sf_dir, FACTS)
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    keys = rows.select("file_id", F.inline(F.array(key("customer", F.lower("customer_name")), key("folder", F.concat("currency", F.lit("/"), F.substring("iso_date", 1, 7))))))
    return maintenance.neighbourhood(keys, rows.where("user_confirmed"), "file_id")


LADDER = ["explicit_rule", "user_confirmed", "preference", "machine", "default"]


@query(f"""{FILES_SQL}, c AS (SELECT file_id, 5 AS r, 'default' AS source, 'Unsorted' AS value FROM files UNION ALL SELECT file_id, 4, 'machine', extension FROM files
    UNION ALL SELECT file_id, 3, 'preference', 'Papers' FROM files WHERE extension IN ('pdf', 'docx', 'txt') UNION ALL SELECT file_id, 1, 'explicit_rule', 'French' FROM files WHERE ends_with(parent_path, '/fr'))
  SELECT file_id, arg_min(value, r) AS value, arg_min(source, r) AS source FROM c GROUP BY file_id""")
def rules_precedence(spark, sf_dir):
    option = lambda source, value, rule: F.struct(F.lit(source).alias("source"), F.lit(0).alias("position"), F.lit(rule).alias("rule_id"), value.alias("value"))
    paper = F.when(catalog.type_group(F.col("extension")) == "document", "Papers")
    french = F.when(F.endswith("parent_path", F.lit("/fr")), "French")
    options = F.array(option("default", F.lit("Unsorted"), "d"), option("machine", F.col("extension"), "m"), option("preference", paper, "p"), option("explicit_rule", french, "r"))
    rows = files(spark, sf_dir).select("file_id", F.inline(options)).where("value is not null")
    return maintenance.precedence(rows, "file_id", LADDER)


@query(f"""{FACTS_SQL} SELECT currency, count(*) AS items, round(max(confidence::DOUBLE), 6) AS top_score, min(customer_name) AS first_name, bool_or(user_confirmed) AS conflicting FROM facts GROUP BY currency""")
def identity_review_groups(spark, sf_dir):
    rows = adapted(spark, sf_dir, FACTS).withColumn("confidence", F.col("confidence").cast("double"))
    return maintenance.review_groups(rows, "currency", "confidence", "customer_name", F.col("user_confirmed")).withColumn("top_score", F.round("top_score", 6))


@query(f"""{STATES_SQL} SELECT coalesce(f.root_id, h.root_id) AS root_id, coalesce(f.path, h.path) AS path, coalesce(f.kind, h.kind) AS kind,
  CASE WHEN h.path IS NULL THEN 'insert' WHEN f.path IS NULL THEN 'retire' WHEN h.kind = f.kind THEN 'keep' ELSE 'update' END AS action
  FROM (SELECT * FROM half WHERE kind <> 'removed') AS h FULL JOIN (SELECT * FROM full_state WHERE kind <> 'removed') AS f ON h.path = f.path AND h.root_id = f.root_id""")
def state_synchronise(spark, sf_dir):
    half, full = [s.where("kind <> 'removed'") for s in states(spark, sf_dir)]
    return maintenance.synchronised(half, full, KEY, "kind")


POLL_MS = 86_400_000


@query(f"""{WATCH_SQL} SELECT root_id, path, at_ms // {POLL_MS} AS poll, count(*) AS hints, list_reduce(list(kind ORDER BY at_ms, seq), lambda a, b: CASE WHEN a = b THEN a WHEN a = 'metadata' THEN b WHEN b = 'metadata' THEN a
    WHEN a IN ('created', 'modified') AND b IN ('created', 'modified') THEN 'created' WHEN b = 'removed' THEN 'removed' WHEN a = 'removed' AND b = 'created' THEN 'modified' ELSE b END) AS kind
  FROM watch GROUP BY 1, 2, 3""")
def stream_coalesce_fold(spark, sf_dir):
    events = adapted(spark, sf_dir, WATCH).withColumn("poll", F.expr(f"at_ms div {POLL_MS}"))
    return watch.coalesced(events, [*KEY, "poll"], ORDER)


@query(f"""{WATCH_SQL} SELECT root_id, path, seq FROM watch WHERE kind <> 'metadata' AND at_ms + 750 <= (SELECT max(at_ms) FROM watch) QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY at_ms, seq) <= 25""")
def stream_due_jobs(spark, sf_dir):
    events = adapted(spark, sf_dir, WATCH)
    now = events.agg(F.max("at_ms")).first()[0]
    return watch.due(events.where("kind <> 'metadata'"), "root_id", F.col("at_ms") + 750, ORDER, now, 25).select(*KEY, "seq")
