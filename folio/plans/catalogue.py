"""The registered queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.operators import catalog, identity, index, organize, search, understanding
from folio.plans import content_queries, document_queries, hybrid_queries, identity_queries, ledger_queries, proposal_queries, routing_queries, state_queries, text_queries, upkeep_queries  # noqa: F401  (they register their queries)
from folio.plans.registry import FACTS_SQL, FILES_SQL, ORACLES, QUERIES, STATES_SQL, TEXT_SQL, TOKENS_SQL, WATCH_SQL, asked_tokens, doc_text, documents, files, query, states, text_index  # noqa: F401
from folio.sources.adapters import FACTS, OCCURRENCES, PREDICTIONS, WATCH, adapted, plain
from folio.sources.tables import table
from folio.streaming import watch

GROUPS_SQL = f"{FILES_SQL}, groups AS (SELECT byte_size, digest, count(*) AS members, min(file_id) AS canonical FROM files WHERE digest IS NOT NULL GROUP BY ALL HAVING count(*) > 1)"


# catalogue


@query(f"{GROUPS_SQL} SELECT * FROM groups")
def catalog_exact_duplicates(spark, sf_dir):
    return catalog.exact_duplicates(files(spark, sf_dir))


@query(f"""{GROUPS_SQL} SELECT file_id, canonical, file_id = canonical AS is_canonical, members,
  CASE WHEN file_id = canonical THEN 0 ELSE byte_size END AS wasted FROM files JOIN groups USING (byte_size, digest)""")
def catalog_duplicate_report(spark, sf_dir):
    return catalog.duplicate_report(files(spark, sf_dir))


@query(f"""{FILES_SQL} SELECT file_id, byte_size, peers FROM files JOIN
  (SELECT byte_size, count(*) AS peers FROM files GROUP BY byte_size HAVING count(*) > 1) AS s USING (byte_size)""")
def catalog_size_collisions(spark, sf_dir):
    return catalog.size_collisions(files(spark, sf_dir))


@query(f"""{FILES_SQL} SELECT CASE WHEN extension IN ('pdf', 'docx', 'txt') THEN 'document' WHEN extension = 'xlsx' THEN 'spreadsheet'
  WHEN extension = 'jpg' THEN 'image' ELSE 'archive' END AS type_group, count(*) AS n_files, sum(byte_size)::BIGINT AS bytes FROM files GROUP BY 1""")
def catalog_type_groups(spark, sf_dir):
    rows = files(spark, sf_dir).groupBy(catalog.type_group(F.col("extension")).alias("type_group"))
    return rows.agg(F.count("*").alias("n_files"), F.sum("byte_size").alias("bytes"))


@query(f"{FILES_SQL} SELECT count(*) AS files, count(DISTINCT parent_path) AS folders, coalesce(sum(byte_size), 0)::BIGINT AS bytes, count(digest) AS hashed FROM files")
def catalog_scan_metrics(spark, sf_dir):
    return catalog.scan_metrics(files(spark, sf_dir))


@query(f"{FILES_SQL} SELECT file_id, filename, byte_size FROM files ORDER BY byte_size DESC NULLS LAST, file_id LIMIT 50 OFFSET 50")
def catalog_inventory_page(spark, sf_dir):
    rows = files(spark, sf_dir).select("file_id", "filename", "byte_size")
    return catalog.inventory_page(rows, "byte_size", descending=True, offset=50, limit=50)


@query(f"""{WATCH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY root_id, path ORDER BY at_ms DESC, seq DESC) AS n, count(*) OVER (PARTITION BY root_id, path) AS versions FROM watch)
  SELECT root_id, path, versions, kind, byte_size FROM r WHERE n = 1""")
def catalog_latest_version(spark, sf_dir):
    return catalog.latest_by(adapted(spark, sf_dir, WATCH), ["root_id", "path"], ["at_ms", "seq"], ["kind", "byte_size"])


@query(f"""{WATCH_SQL} SELECT seq, path, row_number() OVER w AS version, at_ms AS valid_from, lead(at_ms) OVER w AS valid_to
  FROM watch WINDOW w AS (PARTITION BY root_id, path ORDER BY at_ms, seq)""")
def catalog_validity_ranges(spark, sf_dir):
    rows = catalog.validity_ranges(adapted(spark, sf_dir, WATCH), ["root_id", "path"], ["at_ms", "seq"], "at_ms")
    return rows.select("seq", "path", "version", "valid_from", "valid_to")


SNAPSHOTS = f"""{STATES_SQL}, older AS (SELECT root_id, path, byte_size, kind FROM half WHERE kind <> 'removed'), newer AS (SELECT root_id, path, byte_size, kind FROM full_state WHERE kind <> 'removed')"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Paths that stood at half time and those that stand at the end of the events."""
    half, full = states(spark, sf_dir)
    return half.where("kind <> 'removed'"), full.where("kind <> 'removed'")


@query(f"""{SNAPSHOTS} SELECT * FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'removed'
  WHEN a.byte_size IS DISTINCT FROM b.byte_size OR a.kind <> b.kind THEN 'modified' END AS status
  FROM older a FULL JOIN newer b ON a.path = b.path) AS d WHERE status IS NOT NULL""")
def catalog_snapshot_diff(spark, sf_dir):
    return catalog.snapshot_diff(*_snapshots(spark, sf_dir), "path", ["byte_size", "kind"])


@query(f"""{FILES_SQL}, gone AS (SELECT byte_size, digest, min(file_id) AS before FROM files WHERE starts_with(parent_path, 'src1') GROUP BY ALL HAVING count(*) = 1),
  made AS (SELECT byte_size, digest, min(file_id) AS after FROM files WHERE NOT starts_with(parent_path, 'src1') GROUP BY ALL HAVING count(*) = 1)
  SELECT before, after FROM gone JOIN made USING (byte_size, digest)""")
def catalog_rename_pairs(spark, sf_dir):
    rows, left = files(spark, sf_dir), F.startswith("parent_path", F.lit("src1"))
    return catalog.rename_pairs(rows.where(left), rows.where(~left), "file_id", ["byte_size", "digest"])


@query("SELECT doc_id, quality FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id IS NOT NULL)")
def catalog_orphans(spark, sf_dir):
    parent = table(spark, sf_dir, "documents").where("lang = 'en'")
    return catalog.orphans(table(spark, sf_dir, "labels").select("doc_id", "quality"), parent, "doc_id", "doc_id")


# retrieval

ASKED_SQL = f"""WITH asked AS (SELECT unnest(list_slice({TOKENS_SQL}, 1, 6)) AS token FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)),
  body AS (SELECT doc_id, text, lang, source, {TOKENS_SQL} AS ts FROM documents)"""


@query(f"SELECT doc_id, len({TOKENS_SQL})::BIGINT AS n_tokens, len(list_distinct({TOKENS_SQL}))::BIGINT AS n_distinct FROM documents")
def text_tokens(spark, sf_dir):
    t = search.tokens(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS_SQL})) AS token FROM documents) AS t GROUP BY token")
def text_document_frequency(spark, sf_dir):
    return search.document_frequency(documents(spark, sf_dir), "text")


TFIDF_SQL = f"""{ASKED_SQL}, times AS (SELECT token, count(*) AS times FROM asked GROUP BY token),
  held AS (SELECT doc_id, token, times FROM (SELECT doc_id, unnest(list_distinct(ts)) AS token FROM body) AS u JOIN times USING (token)),
  dfs AS (SELECT token, count(*) AS df FROM held GROUP BY token),
  scores AS (SELECT doc_id, round(sum(times * (ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1)) + 1)), 6) AS score FROM held JOIN dfs USING (token) GROUP BY doc_id)"""


@query(f"{TFIDF_SQL} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores ORDER BY score DESC, doc_id LIMIT 20")
def search_tfidf_topk(spark, sf_dir):
    scores = index.tfidf(spark, text_index(spark, sf_dir), "doc_id", "text", asked_tokens(spark, sf_dir))
    return search.ranked(scores.withColumn("score", F.round("score", 6)), "doc_id", 20)


@query(f"""{ASKED_SQL}, parts AS (SELECT doc_id, list_concat(list_transform(ts, lambda t: {{'t': t, 'w': 1.0}}), list_transform(regexp_extract_all(lower(coalesce(source, '')), '[\\p{{L}}\\p{{N}}]{{2,}}'), lambda t: {{'t': t, 'w': 3.5}})) AS p FROM body),
  sized AS (SELECT doc_id, p, len(p) AS length, avg(len(p)) OVER () AS mean FROM parts),
  tf AS (SELECT doc_id, length, mean, u.t AS token, sum(u.w)::DOUBLE AS f FROM (SELECT doc_id, length, mean, unnest(p) AS u FROM sized) AS x WHERE u.t IN (SELECT token FROM asked) GROUP BY ALL),
  dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY token), n AS (SELECT count(*) AS n FROM documents),
  scores AS (SELECT doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM tf JOIN dfs USING (token), n GROUP BY doc_id)
  SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores ORDER BY score DESC, doc_id LIMIT 20""")
def search_bm25_fields(spark, sf_dir):
    scores = index.bm25(spark, text_index(spark, sf_dir), "doc_id", {"text": 1.0, "source": 3.5}, asked_tokens(spark, sf_dir))
    return search.ranked(scores.withColumn("score", F.round("score", 6)), "doc_id", 20)


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])ma') AND regexp_matches(lower(text), '(^|[^\p{L}\p{N}])de')")
def search_prefix_and(spark, sf_dir):
    return documents(spark, sf_dir).where(search.holds_prefixes(F.col("text"), ["ma", "de"])).select("doc_id")


@query("SELECT doc_id, substr(text, greatest(instr(lower(text), 'the') - 40, 1), 240) AS excerpt FROM documents WHERE text IS NOT NULL")
def search_snippet(spark, sf_dir):
    return documents(spark, sf_dir).where("text is not null").select("doc_id", search.snippet(F.col("text"), "the").alias("excerpt"))


VECTOR_SQL = """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
  sims AS (SELECT vec_id, label, round(list_inner_product(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q)"""


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every vector to the first one, which travels in the plan as a literal."""
    rows = table(spark, sf_dir, "embeddings")
    asked_for = rows.orderBy("vec_id").select("embedding").first()["embedding"]
    target = F.array(*[F.lit(float(x)) for x in asked_for])
    return rows.select("vec_id", "label", F.round(search.dot(F.col("embedding"), target), 6).alias("score"))


@query(f"{VECTOR_SQL} SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM sims ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    return search.ranked(_similar(spark, sf_dir).select("vec_id", "score"), "vec_id", 20)


@query(f"{VECTOR_SQL} SELECT label, max(score) AS score, count(*) AS vectors FROM sims GROUP BY label")
def vector_group_max(spark, sf_dir):
    return _similar(spark, sf_dir).groupBy("label").agg(F.max("score").alias("score"), F.count("*").alias("vectors"))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: round(greatest(least(x::DOUBLE, 1.0), -1.0) * 127, 0)::INTEGER), ',') AS codes FROM embeddings")
def vector_quantise(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(search.quantise(F.col("embedding")), lambda x: x.cast("string")), ",").alias("codes"))


@query(f"""WITH t AS (SELECT doc_id, md5(unnest({TOKENS_SQL})) AS h FROM documents),
  s AS (SELECT doc_id, ('0x' || substr(h, 1, 4))::BIGINT % 64 AS bucket, sum(CASE WHEN ('0x' || substr(h, 5, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS s FROM t GROUP BY 1, 2 HAVING s <> 0)
  SELECT doc_id, bucket, round(s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)), 6) AS weight FROM s""")
def vector_hashed_embedding(spark, sf_dir):
    found = search.hashed_embedding(documents(spark, sf_dir), "doc_id", "text")
    return found.withColumn("weight", F.round("weight", 6))


@query(f"""{TFIDF_SQL}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores ORDER BY rank LIMIT 50),
  q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
  sims AS (SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q),
  b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM sims ORDER BY rank LIMIT 50)
  SELECT doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (FROM a UNION ALL FROM b) AS u GROUP BY doc_id""")
def search_rank_fusion(spark, sf_dir):
    lexical = index.tfidf(spark, text_index(spark, sf_dir), "doc_id", "text", asked_tokens(spark, sf_dir)).withColumn("score", F.round("score", 6))
    near = _similar(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "score")
    fused = search.fuse([search.ranked(lexical, "doc_id", 50), search.ranked(near, "doc_id", 50)], "doc_id")
    return fused.withColumn("score", F.round("score", 6))


# facts


@query(f"{FACTS_SQL} SELECT file_id, amount_minor, iso_date FROM facts WHERE amount_minor BETWEEN 5000000 AND 15000000 AND currency = 'EUR' AND iso_date BETWEEN '1995-01-01' AND '1996-12-31'")
def search_fact_filters(spark, sf_dir):
    rows = adapted(spark, sf_dir, FACTS)
    held = F.col("amount_minor").between(5_000_000, 15_000_000) & (F.col("currency") == "EUR") & F.col("iso_date").between("1995-01-01", "1996-12-31")
    return rows.where(held).select("file_id", "amount_minor", "iso_date")


@query(f"""{FACTS_SQL} SELECT file_id, round(score, 6) AS score FROM (SELECT file_id,
  0.18 * greatest(0, 1 - abs(amount_minor - 10000000) / 10000000.0) + 0.24 * greatest(confidence::DOUBLE, 0.7) + CASE WHEN user_confirmed THEN 0.08 ELSE 0 END AS score
  FROM facts) AS s ORDER BY round(score, 6) DESC, file_id LIMIT 100""")
def search_fact_score(spark, sf_dir):
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.col("amount_minor") - 10_000_000) / F.lit(1e7))
    sure = F.when(F.col("user_confirmed"), 0.08).otherwise(0.0)
    score = F.round(0.18 * near + 0.24 * F.greatest(F.col("confidence").cast("double"), F.lit(0.7)) + sure, 6)
    return adapted(spark, sf_dir, FACTS).select("file_id", score.alias("score")).orderBy(F.desc("score"), "file_id").limit(100)


@query(TEXT_SQL + r" SELECT DISTINCT file_id, email FROM (SELECT file_id, unnest(regexp_extract_all(lower(extracted_text), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}')) AS email FROM docs) AS e WHERE NOT contains(email, '..')")
def extract_emails(spark, sf_dir):
    return understanding.emails(doc_text(spark, sf_dir), "file_id", "extracted_text")


@query(TEXT_SQL + r" SELECT file_id, 0::BIGINT AS position, regexp_extract(extracted_text, '([0-9]+) ?EUR', 1)::BIGINT * 100 AS amount_minor, 'EUR' AS currency FROM docs WHERE regexp_matches(extracted_text, '[0-9]+ ?EUR\b')")
def extract_money(spark, sf_dir):
    return understanding.money(doc_text(spark, sf_dir), "file_id", "extracted_text")


@query(TEXT_SQL + r" SELECT DISTINCT file_id, iso_date FROM (SELECT file_id, unnest(regexp_extract_all(extracted_text, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b')) AS iso_date FROM docs) AS d WHERE try_cast(iso_date AS DATE) IS NOT NULL")
def extract_dates(spark, sf_dir):
    return understanding.iso_dates(doc_text(spark, sf_dir), "file_id", "extracted_text")


@query(TEXT_SQL + """ SELECT file_id, CASE file_id % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'quote' ELSE 'letter' END AS document_type,
  round(CASE file_id % 3 WHEN 0 THEN 0.99 WHEN 1 THEN 0.9 ELSE 0.72 END, 6)::DOUBLE AS score FROM docs""")
def semantic_document_type(spark, sf_dir):
    return understanding.document_types(doc_text(spark, sf_dir), "file_id", "extracted_text").withColumn("score", F.round("score", 6))


@query("""SELECT doc_id, round(CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN least(b, 0.25) ELSE b END, 6)::DOUBLE AS quality
  FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.78 WHEN 2 THEN 0.35 ELSE 0.2 END AS b FROM documents) AS d""")
def semantic_quality(spark, sf_dir):
    status = F.get(F.array(*map(F.lit, ("success", "partial", "skipped", "failed"))), (F.col("doc_id") % 4).cast("int"))
    return documents(spark, sf_dir).select("doc_id", F.round(understanding.text_quality(F.col("text"), status), 6).alias("quality"))


@query(f"""{FACTS_SQL}, c AS (SELECT customer_name AS k, coalesce(currency, 'none') AS v, max(confidence::DOUBLE) AS top, sum(confidence::DOUBLE) AS s FROM facts GROUP BY 1, 2),
  m AS (SELECT k, v, round(least(top + 0.18 * (s - top), 0.99), 9) AS c FROM c),
  r AS (SELECT *, row_number() OVER w AS n, lead(c) OVER w AS nx FROM m WINDOW w AS (PARTITION BY k ORDER BY c DESC, v)),
  t AS (SELECT *, CASE WHEN c < 0.65 THEN 'unknown' WHEN nx >= 0.65 AND c - nx < 0.12 THEN 'conflicting' WHEN c >= 0.85 THEN 'confirmed' ELSE 'inferred' END AS status FROM r WHERE n = 1)
  SELECT k AS customer_name, CASE WHEN status IN ('confirmed', 'inferred') THEN v END AS currency, round(c, 6) AS confidence, status FROM t""")
def semantic_resolve_field(spark, sf_dir):
    rows = adapted(spark, sf_dir, FACTS).select("customer_name", F.coalesce("currency", F.lit("none")).alias("currency"), F.col("confidence").cast("double").alias("c"))
    return understanding.resolve(rows, ["customer_name"], "currency", "c").withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH p AS ({plain(PREDICTIONS)}) SELECT least(floor(probability * 10), 9)::BIGINT AS bin, count(*) AS rows, round(avg(probability), 6)::DOUBLE AS mean_probability,
  round(avg(positive::INTEGER), 6) AS share_positive, round(sum((probability - positive::INTEGER) * (probability - positive::INTEGER)), 6)::DOUBLE AS brier_sum
  FROM p WHERE probability IS NOT NULL AND positive IS NOT NULL GROUP BY 1""")
def metrics_calibration(spark, sf_dir):
    rows = adapted(spark, sf_dir, PREDICTIONS).withColumn("probability", F.col("probability").cast("double"))
    found = understanding.calibration(rows)
    return found.select("bin", "rows", *[F.round(c, 6).alias(c) for c in ("mean_probability", "share_positive", "brier_sum")])


# identity

OCC_SQL = f"""WITH RECURSIVE raw AS ({plain(OCCURRENCES)}),
  named AS (SELECT *, trim(regexp_replace(lower(original_value), '[^a-z0-9]+', ' ', 'g')) AS name FROM raw),
  occ AS (SELECT *, regexp_replace(name, ' (s a s|s a|sas|sarl|sa|ltd|inc|llc|gmbh)$', '') AS core,
          CASE WHEN domain NOT IN ('gmail.com', 'outlook.com', 'hotmail.com', 'yahoo.com') THEN domain END AS own_domain FROM named),
  keys AS (SELECT occurrence_key, 'name:' || name AS block, false AS strong FROM occ UNION ALL SELECT occurrence_key, 'core:' || core, false FROM occ
           UNION ALL SELECT occurrence_key, 'domain:' || own_domain, false FROM occ WHERE own_domain IS NOT NULL
           UNION ALL SELECT occurrence_key, 'id:' || company_identifier, true FROM occ WHERE company_identifier IS NOT NULL),
  sizes AS (SELECT block, strong, count(*) AS members, NOT strong AND count(*) > 512 AS skipped FROM keys GROUP BY block, strong),
  placed AS (SELECT k.*, row_number() OVER (PARTITION BY block ORDER BY occurrence_key) AS n FROM keys k JOIN sizes s USING (block) WHERE NOT s.skipped),
  pairs AS (SELECT x.occurrence_key AS a, y.occurrence_key AS b, count(*) AS blocks FROM placed x JOIN placed y
            ON x.block = y.block AND y.n - x.n BETWEEN 1 AND CASE WHEN x.strong THEN 32 ELSE 16 END GROUP BY ALL),
  sides AS (SELECT a, b, l.name = r.name AS same_name, l.core = r.core AS same_core, coalesce(l.company_identifier = r.company_identifier, false) AS same_id,
            coalesce(l.company_identifier <> r.company_identifier, false) AS clash, coalesce(l.own_domain = r.own_domain, false) AS same_domain
            FROM pairs JOIN occ l ON l.occurrence_key = a JOIN occ r ON r.occurrence_key = b),
  scored AS (SELECT *, least(CASE WHEN same_name THEN 0.62 WHEN same_core THEN 0.54 ELSE 0 END + CASE WHEN same_id THEN 0.72 ELSE 0 END + CASE WHEN same_domain THEN 0.24 ELSE 0 END, 1)::DOUBLE AS score FROM sides),
  judged AS (SELECT a, b, score, CASE WHEN clash THEN 'keep_separate' WHEN score >= 0.97 AND same_name AND same_id THEN 'auto_link'
             WHEN score >= 0.5 OR (same_core AND NOT same_name) THEN 'review' ELSE 'keep_separate' END AS decision FROM scored),
  links AS (SELECT a AS u, b AS v FROM judged WHERE decision = 'auto_link' UNION ALL SELECT b, a FROM judged WHERE decision = 'auto_link'),
  reach AS (SELECT occurrence_key AS node, occurrence_key AS root FROM occ UNION SELECT v, root FROM reach JOIN links ON node = u),
  members AS (SELECT node AS occurrence_key, min(root) AS identity FROM reach GROUP BY node)"""


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.prepared(adapted(spark, sf_dir, OCCURRENCES))


@query(f"{OCC_SQL} SELECT block, strong, members, skipped FROM sizes")
def identity_blocking_stats(spark, sf_dir):
    return identity.block_sizes(identity.blocking_keys(_occurrences(spark, sf_dir)))


@query(f"{OCC_SQL} SELECT a, b, blocks FROM pairs")
def identity_pairs(spark, sf_dir):
    return identity.candidate_pairs(identity.blocking_keys(_occurrences(spark, sf_dir)))


def _assessed(occ: DataFrame) -> DataFrame:
    return identity.assess(identity.candidate_pairs(identity.blocking_keys(occ)), occ)


@query(f"{OCC_SQL} SELECT a, b, round(score, 6) AS score, decision FROM judged")
def identity_assessment(spark, sf_dir):
    return _assessed(_occurrences(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"{OCC_SQL} SELECT occurrence_key, identity FROM members")
def identity_components(spark, sf_dir):
    occ = _occurrences(spark, sf_dir)
    return identity.identities(_assessed(occ), occ)


@query(f"""{OCC_SQL} SELECT identity, display_name, members FROM (SELECT identity, original_value AS display_name, count(*) OVER (PARTITION BY identity) AS members,
  row_number() OVER (PARTITION BY identity ORDER BY length(original_value), original_value) AS n FROM members JOIN occ USING (occurrence_key)) AS d WHERE n = 1""")
def identity_canonical_names(spark, sf_dir):
    occ = _occurrences(spark, sf_dir)
    return identity.canonical_names(identity.identities(_assessed(occ), occ), occ)


# rules and organisation

RULES = [
    ("r1", 1, "type_group", "document", 2, "folder", "Papers"), ("r1", 1, "lang", "en", 2, "folder", "Papers"),
    ("r2", 2, "type_group", "document", 1, "folder", "Documents"), ("r3", 3, "lang", "fr", 1, "context", "french"),
    ("r4", 4, "extension", "zip", 1, "folder", "Archives"), ("r4b", 4, "extension", "zip", 1, "folder", "Zipped"),
]
RULE_VALUES = ", ".join(str(r) for r in RULES)
MATCH_SQL = f"""{FILES_SQL}, rules(rule_id, position, field, expected, n_conditions, action, value) AS (VALUES {RULE_VALUES}),
  held AS (SELECT file_id, 'extension' AS field, extension AS fact FROM files UNION ALL SELECT file_id, 'lang', split_part(parent_path, '/', 2) FROM files
           UNION ALL SELECT file_id, 'type_group', 'document' FROM files WHERE extension IN ('pdf', 'docx', 'txt')),
  matches AS (SELECT file_id, rule_id, position, action, value FROM held JOIN rules ON held.field = rules.field AND fact = expected
              GROUP BY file_id, rule_id, position, action, value, n_conditions HAVING count(DISTINCT held.field) = n_conditions)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    fact = lambda name, c: F.struct(F.lit(name).alias("field"), c.alias("fact"))
    facts = F.array(fact("extension", F.col("extension")), fact("lang", F.get(F.split("parent_path", "/"), 1)), fact("type_group", catalog.type_group(F.col("extension"))))
    rules = spark.createDataFrame(RULES, "rule_id string, position int, field string, expected string, n_conditions int, action string, value string")
    return organize.matching_rules(rows.select("file_id", F.inline(facts)), "file_id", rules)


@query(f"{MATCH_SQL} SELECT * FROM matches")
def rules_match(spark, sf_dir):
    return _matches(spark, sf_dir)


@query(f"{MATCH_SQL} SELECT file_id, action, value, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id, action ORDER BY position, rule_id) AS n FROM matches) AS m WHERE n = 1")
def rules_first_wins(spark, sf_dir):
    return organize.first_wins(_matches(spark, sf_dir), "file_id")


@query(f"""{FACTS_SQL} SELECT customer_name, count(*) AS support, min(currency) AS currency FROM facts WHERE user_confirmed GROUP BY customer_name
  HAVING count(*) >= 3 AND count(DISTINCT currency) = 1""")
def rules_suggestions(spark, sf_dir):
    return organize.suggestions(adapted(spark, sf_dir, FACTS).where("user_confirmed"), ["customer_name"], "currency")


@query(f"{FACTS_SQL} SELECT CASE WHEN confidence >= 0.95 THEN 'very_high' WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.65 THEN 'medium' ELSE 'low' END AS band, count(*) AS files FROM facts GROUP BY 1")
def organize_confidence(spark, sf_dir):
    band = organize.confidence_band(F.col("confidence").cast("double"))
    return adapted(spark, sf_dir, FACTS).groupBy(band.alias("band")).agg(F.count("*").alias("files"))


NAMED_SQL = f"""{FILES_SQL}, wanted AS (SELECT file_id, extension AS folder, concat('Note ', CAST(file_id % 50 AS VARCHAR), '.', CASE file_id % 2 WHEN 0 THEN 'TXT' ELSE 'txt' END) AS name FROM files),
  placed AS (SELECT *, row_number() OVER (PARTITION BY lower(folder), lower(name) ORDER BY file_id) AS n FROM wanted)"""


@query(NAMED_SQL + r""" SELECT file_id, folder, name, CASE WHEN n = 1 THEN name ELSE concat(split_part(name, '.', 1), '_', CAST(n AS VARCHAR), '.', split_part(name, '.', 2)) END AS final_name FROM placed""")
def organize_collisions(spark, sf_dir):
    ending = F.when(F.col("file_id") % 2 == 0, ".TXT").otherwise(".txt")
    wanted = files(spark, sf_dir).select("file_id", F.col("extension").alias("folder"), F.concat(F.lit("Note "), (F.col("file_id") % 50).cast("string"), ending).alias("name"))
    return organize.collision_names(wanted, "file_id", "folder", "name")


@query(f"""{FILES_SQL}, deep AS (SELECT concat('root/', parent_path) AS folder, byte_size FROM files),
  levels AS (SELECT array_to_string(list_slice(string_split(folder, '/'), 1, n), '/') AS node, n AS depth, byte_size FROM deep, unnest(range(1, 4)) AS t(n))
  SELECT node, depth, count(*) AS files, coalesce(sum(byte_size), 0)::BIGINT AS bytes FROM levels GROUP BY ALL""")
def organize_tree(spark, sf_dir):
    rows = files(spark, sf_dir).select(F.concat(F.lit("root/"), "parent_path").alias("folder"), "byte_size")
    return organize.folder_tree(rows, "folder", "byte_size")


@query(f"""{SNAPSHOTS}, x AS (SELECT path, concat(root_id::VARCHAR, '/', kind) AS d FROM older), y AS (SELECT path, concat(root_id::VARCHAR, '/', kind) AS d FROM newer)
  SELECT CASE WHEN x.d IS NULL THEN 'added' WHEN y.d IS NULL THEN 'removed' WHEN x.d <> y.d THEN 'changed' ELSE 'same' END AS status, count(*) AS files FROM x FULL JOIN y ON x.path = y.path GROUP BY 1""")
def organize_diff(spark, sf_dir):
    before, after = [s.select("path", F.concat_ws("/", "root_id", "kind").alias("d")) for s in _snapshots(spark, sf_dir)]
    return organize.proposal_diff(before, after, "path", "d")


# change events


@query(f"{WATCH_SQL} SELECT seq, root_id, row_number() OVER (PARTITION BY root_id, path ORDER BY at_ms, seq) - 1 AS number FROM watch")
def stream_sequence(spark, sf_dir):
    return watch.numbered(adapted(spark, sf_dir, WATCH), ["root_id", "path"], ["at_ms", "seq"]).select("seq", "root_id", "number")


QUIET_MS = 6 * 3_600_000


@query(f"""{WATCH_SQL}, g AS (SELECT *, CASE WHEN coalesce(at_ms - lag(at_ms) OVER w >= {QUIET_MS}, true) THEN 1 ELSE 0 END AS fresh FROM watch WINDOW w AS (PARTITION BY root_id, path ORDER BY at_ms, seq)),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY root_id, path ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING) AS run FROM g)
  SELECT root_id, path, min(at_ms) AS started, max(at_ms) + {QUIET_MS} AS ready, count(*) AS hints, arg_max(kind, (at_ms, seq)) AS kind FROM r GROUP BY root_id, path, run""")
def stream_debounce_sessions(spark, sf_dir):
    return watch.debounced(adapted(spark, sf_dir, WATCH), ["root_id", "path"], "at_ms", "seq", QUIET_MS)


@query(f"""{WATCH_SQL} SELECT seq, path FROM (SELECT seq, path, byte_size = lag(byte_size) OVER w AND at_ms - lag(at_ms) OVER w >= 1000 AS ok
  FROM watch WINDOW w AS (PARTITION BY root_id, path ORDER BY at_ms, seq)) AS s WHERE ok""")
def stream_stability(spark, sf_dir):
    return watch.stable(adapted(spark, sf_dir, WATCH), ["root_id", "path"], "at_ms", "seq", "byte_size", 1000).select("seq", "path")


@query(f"{WATCH_SQL} SELECT seq, CASE WHEN seq % 10 < 8 THEN at_ms + 1000 * pow(2, least(seq % 10, 6))::BIGINT END AS due_ms FROM watch WHERE kind = 'removed'")
def stream_retry(spark, sf_dir):
    rows = adapted(spark, sf_dir, WATCH).where("kind = 'removed'")
    return rows.select("seq", watch.retry_at(F.col("at_ms"), F.col("seq") % 10).alias("due_ms"))


@query(f"""{WATCH_SQL}, c AS (SELECT seq, root_id, md5(CAST(seq AS VARCHAR)) AS d, CASE WHEN seq % 13 = 0 THEN 'x' ELSE lag(md5(CAST(seq AS VARCHAR))) OVER w END AS p,
  row_number() OVER w + CASE WHEN seq % 17 = 0 THEN 1 ELSE 0 END AS n, lag(md5(CAST(seq AS VARCHAR))) OVER w AS d0 FROM watch WINDOW w AS (PARTITION BY root_id ORDER BY seq)),
  e AS (SELECT *, lag(d) OVER o AS before, lag(n) OVER o AS last FROM c WINDOW o AS (PARTITION BY root_id ORDER BY n, seq))
  SELECT seq FROM e WHERE last IS NOT NULL AND (before IS DISTINCT FROM p OR n <> last + 1)""")
def audit_chain_check(spark, sf_dir):
    digest, over = F.md5(F.col("seq").cast("string")), Window.partitionBy("root_id").orderBy("seq")
    rows = adapted(spark, sf_dir, WATCH).select("seq", "root_id", digest.alias("d"), F.when(F.col("seq") % 13 == 0, "x").otherwise(F.lag(digest).over(over)).alias("p"),
        (F.row_number().over(over) + F.when(F.col("seq") % 17 == 0, 1).otherwise(0)).alias("n"))
    return organize.broken_chain(rows, ["root_id"], "n", "seq", "d", "p", span=1000).select("seq")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's own search: lexical and vector rankings, fused."""
    return search_rank_fusion(spark, sf_dir)
