"""Queries over names, texts and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import catalog, detection, organize, ranking, search, understanding, vectors
from folio.plans.registry import FACTS_SQL, FILES_SQL, TEXT_SQL, doc_text, documents, files, query
from folio.sources.adapters import FACTS, OCCURRENCES, adapted, plain
from folio.sources.tables import table

# what a file is

BYTES_SQL = f"""{FILES_SQL}, heads AS (SELECT file_id, byte_size, extension, CASE file_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'executable' END AS magic,
    file_id % 5 = 4 AND coalesce(text, '') <> '' AS readable FROM files),
  k AS (SELECT *, CASE extension WHEN 'txt' THEN 'text' WHEN 'jpg' THEN 'image' ELSE extension END AS expected FROM heads),
  d AS (SELECT file_id, byte_size, CASE WHEN magic = 'zip' AND expected IN ('docx', 'xlsx') THEN expected WHEN magic IS NOT NULL THEN magic
    WHEN expected = 'text' AND NOT readable THEN 'unknown' ELSE expected END AS kind,
    magic IS NOT NULL AND NOT (magic = 'zip' AND expected IN ('docx', 'xlsx')) AND expected <> magic AS mismatch FROM k)"""


def _detected(spark, sf_dir):
    """Files with leading bytes made from their ids: PDF, zip and program magic, bytes of no kind, and the file's own text."""
    head = lambda h: F.unhex(F.lit(h))
    kind = F.col("file_id") % 5
    prefix = F.when(kind == 0, head("255044462D312E37")).when(kind == 1, head("504B0304140000")).when(kind == 2, head("4D5A9000")).when(kind == 3, head("FFFE00FF")).otherwise(F.encode("text", "UTF-8"))
    rows = files(spark, sf_dir).select("file_id", "filename", "byte_size", prefix.alias("prefix"))
    return detection.detect(rows, "filename", "prefix")


@query(f"{BYTES_SQL} SELECT file_id, kind, mismatch FROM d")
def content_kinds(spark, sf_dir):
    return _detected(spark, sf_dir).select("file_id", "kind", "mismatch")


@query(f"""{BYTES_SQL}, p AS (SELECT CASE WHEN mismatch THEN 'failed' WHEN kind IN ('executable', 'unknown') THEN 'unsupported'
    WHEN kind IN ('pdf', 'docx', 'xlsx', 'image', 'zip') AND byte_size > 2000 THEN 'skipped' WHEN kind = 'text' THEN 'read_prefix' ELSE 'read_whole' END AS plan FROM d)
  SELECT plan, CASE plan WHEN 'failed' THEN 'type_mismatch' WHEN 'unsupported' THEN 'unsupported' WHEN 'skipped' THEN 'too_large' END AS reason, count(*) AS files FROM p GROUP BY ALL""")
def extraction_plans(spark, sf_dir):
    limits = dict.fromkeys(("pdf", "docx", "xlsx", "image", "zip"), 2000)
    return detection.extraction_plan(_detected(spark, sf_dir), "byte_size", limits).groupBy("plan", "reason").agg(F.count("*").alias("files"))


@query(f"""{FILES_SQL} SELECT file_id, CASE WHEN extension = 'jpg' THEN 'Images' WHEN extension = 'zip' THEN 'Archives' ELSE 'Documents/Personnel' END AS folder FROM files""")
def organize_everyday(spark, sf_dir):
    path, group = F.concat_ws("/", "parent_path", "filename"), catalog.type_group(F.col("extension"))
    return files(spark, sf_dir).select("file_id", organize.everyday_folder(path, F.col("filename"), group).alias("folder"))


FOLDERS_SQL = f"{FILES_SQL}, f0 AS (SELECT concat('root/', parent_path, '/', extension) AS folder, count(*) AS files FROM files GROUP BY 1), c0 AS (SELECT *, folder AS collapsed FROM f0)" + "".join(
    f""", c{i} AS (SELECT folder, files, CASE WHEN sum(files) OVER (PARTITION BY collapsed) < 20 THEN regexp_replace(collapsed, '/[^/]*$', '') ELSE collapsed END AS collapsed FROM c{i - 1})"""
    for i in range(1, 5)
)


@query(f"{FOLDERS_SQL} SELECT folder, files, collapsed FROM c4")
def organize_group_collapse(spark, sf_dir):
    rows = files(spark, sf_dir).select(F.concat(F.lit("root/"), "parent_path", F.lit("/"), "extension").alias("folder"))
    return organize.collapse_groups(rows, "folder", 20, 4)


@query(f"""{FACTS_SQL}, w AS (SELECT file_id, confidence::DOUBLE AS c, CASE WHEN currency IS NOT NULL THEN 0.9 END AS a, user_confirmed AS u FROM facts)
  SELECT file_id, round((0.35 * c + coalesce(0.3 * a, 0)) / (0.35 + CASE WHEN a IS NULL THEN 0 ELSE 0.3 END) * CASE WHEN u THEN 0.85 ELSE 1 END, 6)::DOUBLE AS confidence FROM w""")
def organize_weighted_confidence(spark, sf_dir):
    parts = {"type": (F.col("confidence").cast("double"), 0.35), "amount": (F.when(F.col("currency").isNotNull(), 0.9), 0.30)}
    mean = organize.weighted_confidence(parts, F.col("user_confirmed"), F.lit(False))
    return adapted(spark, sf_dir, FACTS).select("file_id", F.round(mean, 6).alias("confidence"))


# texts


@query("""WITH c AS (SELECT doc_id, lang, lower(coalesce(text, '')) AS t FROM documents),
  n AS (SELECT doc_id, lang, len(list_filter([' le ', ' la ', ' de ', ' facture', ' montant', ' client'], lambda w: contains(t, w))) AS fr,
        len(list_filter([' the ', ' of ', ' invoice', ' amount', ' customer', ' due '], lambda w: contains(t, w))) AS en FROM c)
  SELECT doc_id, CASE WHEN fr >= 2 AND fr > en THEN 'fr' WHEN en >= 2 AND en > fr THEN 'en' END AS language FROM n""")
def semantic_language(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", understanding.language(F.col("text")).alias("language"))


@query(f"{TEXT_SQL} SELECT file_id, CASE WHEN file_id % 3 < 2 THEN 'business' ELSE 'unknown' END AS context FROM docs")
def semantic_context(spark, sf_dir):
    rows = doc_text(spark, sf_dir)
    types = understanding.document_types(rows, "file_id", "extracted_text")
    return rows.join(types, "file_id").select("file_id", understanding.context(F.col("extracted_text"), F.col("document_type")).alias("context"))


LABELS = ["facture no", "devis no", "client", "fournisseur", "date de facture", "total ttc"]


@query(TEXT_SQL + r""", lines AS (SELECT file_id, unnest(string_split(extracted_text, chr(10))) AS t, unnest(range(len(string_split(extracted_text, chr(10))))) AS line FROM docs)
  SELECT file_id, line, lower(regexp_extract(t, '^([^:]+): ', 1)) AS label, regexp_extract(t, '^[^:]+: (.*)$', 1) AS value FROM lines
  WHERE lower(regexp_extract(t, '^([^:]+): ', 1)) IN ('facture no', 'devis no', 'client', 'fournisseur', 'date de facture', 'total ttc')""")
def extract_labelled(spark, sf_dir):
    return understanding.labelled(doc_text(spark, sf_dir), "file_id", "extracted_text", LABELS)


@query(r"""WITH n AS (SELECT c_custkey, (30000000 + c_custkey * 7919)::VARCHAR AS n FROM customer), s AS (SELECT c_custkey, substr(n, 1, 2) || ' ' || substr(n, 3) AS n FROM n),
  raw AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '+' || n WHEN 1 THEN '(' || n || ')' ELSE n || ' ext' END AS t FROM s), d AS (SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS digits FROM raw)
  SELECT c_custkey, CASE WHEN regexp_matches(t, '^[+]?[0-9 .()-]+$') AND length(digits) BETWEEN 8 AND 15 THEN CASE WHEN starts_with(t, '+') THEN '+' ELSE '' END || digits END AS phone FROM d""")
def extract_phones(spark, sf_dir):
    digits = (30_000_000 + F.col("c_custkey") * 7919).cast("string")
    spaced = F.concat_ws(" ", F.substring(digits, F.lit(1), F.lit(2)), F.substring(digits, F.lit(3), F.lit(30)))
    kind = F.col("c_custkey") % 3
    raw = F.when(kind == 0, F.concat(F.lit("+"), spaced)).when(kind == 1, F.concat(F.lit("("), spaced, F.lit(")"))).otherwise(F.concat(spaced, F.lit(" ext")))
    return table(spark, sf_dir, "customer").select("c_custkey", understanding.phone(raw).alias("phone"))


@query("""SELECT c_custkey, CASE WHEN list_sum(list_transform(range(1, 10), lambda i: CASE WHEN i % 2 = 1 THEN substr(n, i, 1)::INTEGER
    ELSE (2 * substr(n, i, 1)::INTEGER) // 10 + (2 * substr(n, i, 1)::INTEGER) % 10 END)) % 10 = 0 THEN n END AS company_id
  FROM (SELECT c_custkey, (732829320 + c_custkey)::VARCHAR AS n FROM customer) AS c""")
def extract_company_ids(spark, sf_dir):
    raw = F.concat_ws(" ", F.substring((732_829_320 + F.col("c_custkey")).cast("string"), 1, 3), F.substring((732_829_320 + F.col("c_custkey")).cast("string"), 4, 6))
    return table(spark, sf_dir, "customer").select("c_custkey", understanding.company_id(raw).alias("company_id"))


@query(f"""{FACTS_SQL}, c AS (SELECT customer_name AS k, coalesce(currency, 'none') AS v, max(confidence::DOUBLE) AS top, sum(confidence::DOUBLE) AS s FROM facts GROUP BY 1, 2),
  m AS (SELECT k, round(least(top + 0.18 * (s - top), 0.99), 9) AS c, v FROM c), r AS (SELECT *, row_number() OVER w AS n, lead(c) OVER w AS nx FROM m WINDOW w AS (PARTITION BY k ORDER BY c DESC, v))
  SELECT k AS customer_name, 'conflicting_fields' AS reasons FROM r WHERE n = 1 AND c >= 0.65 AND nx >= 0.65 AND c - nx < 0.12""")
def semantic_review_reasons(spark, sf_dir):
    rows = adapted(spark, sf_dir, FACTS).select("customer_name", F.coalesce("currency", F.lit("none")).alias("value"), F.col("confidence").cast("double").alias("c"))
    fields = understanding.resolve(rows, ["customer_name"], "value", "c").withColumn("field", F.lit("currency"))
    return understanding.review_reasons(fields, "customer_name")


# facts and ranking

INTENT_SQL = f"""{FACTS_SQL}, s AS (SELECT customer_name, user_confirmed AS u,
    CASE WHEN currency = 'EUR' AND amount_minor BETWEEN 9000000 AND 11000000 THEN greatest(0, 1 - abs(amount_minor - 10000000) / 10000000.0) ELSE 0 END AS a, CASE WHEN substr(iso_date, 1, 4) = '1996' THEN 1 ELSE 0 END AS d FROM facts),
  g AS (SELECT customer_name, coalesce(max(a) FILTER (u), max(a)) AS a, coalesce(max(d) FILTER (u), max(d)) AS d, coalesce(max(a) FILTER (u), 1) <= 0 OR coalesce(max(d) FILTER (u), 1) <= 0 AS wrong FROM s GROUP BY customer_name)"""


def _intents(spark, sf_dir):
    """How well each customer's orders answer: about 100,000 euros, in 1996."""
    amount = F.when(F.col("currency") == "EUR", ranking.amount_similarity(F.col("amount_minor"), 9_000_000, 11_000_000, 10_000_000)).otherwise(0.0)
    year = F.when(F.substring("iso_date", 1, 4) == "1996", 1.0).otherwise(0.0)
    return ranking.fact_scores(adapted(spark, sf_dir, FACTS), "customer_name", {"amount": amount, "date": year}, F.col("user_confirmed"))


@query(f"{INTENT_SQL} SELECT customer_name FROM g WHERE a > 0 AND d > 0")
def search_filters(spark, sf_dir):
    return ranking.matching_files(_intents(spark, sf_dir), "customer_name", ["amount", "date"])


@query(f"""{INTENT_SQL}, t AS (SELECT customer_name, 0.18 * a + 0.12 * d - CASE WHEN wrong THEN 0.8 ELSE 0 END AS score FROM g WHERE a > 0 OR d > 0)
  SELECT customer_name, round(least(score, 1), 6)::DOUBLE AS score FROM t WHERE score >= 0.035""")
def search_hybrid_score(spark, sf_dir):
    found = ranking.hybrid_score(_intents(spark, sf_dir), "customer_name", {"amount": ranking.AMOUNT, "date": ranking.DATE})
    return found.withColumn("score", F.round("score", 6))


@query(f"WITH o AS ({plain(OCCURRENCES)}) SELECT occurrence_key FROM o WHERE contains(lower(original_value), 'firm 1')")
def search_party_candidates(spark, sf_dir):
    return adapted(spark, sf_dir, OCCURRENCES).where(ranking.names_match(F.col("original_value"), "Firm 1")).select("occurrence_key")


@query(f"""{FILES_SQL} SELECT file_id, CASE WHEN contains(lower(filename), '12') THEN 'filename' WHEN contains(lower(parent_path), '12') THEN 'path'
  WHEN contains(lower(text), '12') THEN 'content' END AS source FROM files""")
def search_match_source(spark, sf_dir):
    fields = {"filename": F.col("filename"), "path": F.col("parent_path"), "content": F.col("text")}
    return files(spark, sf_dir).select("file_id", ranking.match_source(fields, "12").alias("source"))


@query("SELECT doc_id, n_chars, (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents) > 40 AS has_more FROM documents ORDER BY n_chars DESC NULLS FIRST, doc_id LIMIT 20 OFFSET 20")
def search_page_sorted(spark, sf_dir):
    return ranking.page(documents(spark, sf_dir).select("doc_id", "n_chars"), [F.desc_nulls_first("n_chars"), F.col("doc_id")], 20, 20)


@query("""WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: round(greatest(least(x::DOUBLE, 1.0), -1.0) * 127, 0) / 127.0) AS v, embedding FROM embeddings),
  q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
  s AS (SELECT vec_id, round(list_inner_product(v, e) / sqrt(list_inner_product(v, v)), 6) AS score FROM codes, q)
  SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s ORDER BY score DESC, vec_id LIMIT 20""")
def vector_quantised_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked_for = rows.orderBy("vec_id").select("embedding").first()["embedding"]
    held = rows.withColumn("v", F.transform(search.quantise(F.col("embedding")), lambda x: x / F.lit(127.0)))
    score = search.dot(F.col("v"), F.array(*[F.lit(float(x)) for x in asked_for])) / F.sqrt(search.dot(F.col("v"), F.col("v")))
    return search.ranked(held.select("vec_id", F.round(score, 6).alias("score")), "vec_id", 20)


@query("""WITH s AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_inner_product(r.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0)
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 20""")
def vector_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 20)


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents),
  w AS (SELECT DISTINCT d.source, d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1), n AS (SELECT source, count(*) AS relevant FROM w GROUP BY source),
  h AS (SELECT source, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain FROM r JOIN w USING (source, doc_id) WHERE rank <= 10 GROUP BY source)
  SELECT n.source, relevant, CASE WHEN first IS NULL THEN 0 ELSE 1 END::BIGINT AS hit, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS reciprocal_rank,
    round(coalesce(gain / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6)::DOUBLE AS ndcg FROM n LEFT JOIN h ON n.source = h.source""")
def metrics_retrieval(spark, sf_dir):
    docs = documents(spark, sf_dir).select("source", "doc_id", "n_chars")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    ranks = ranking.rank_within(docs, "source", [F.desc_nulls_last("n_chars"), F.col("doc_id")], 10)
    found = ranking.retrieval_metrics(ranks, docs.join(good, "doc_id"), "source", "doc_id", 10)
    return found.withColumns({c: F.round(c, 6) for c in ("reciprocal_rank", "ndcg")})
