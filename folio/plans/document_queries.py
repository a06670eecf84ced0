"""Queries over what documents are and say."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import documents as docs_ops
from folio.operators import understanding
from folio.plans.lineage import kept
from folio.plans.registry import FACTS_SQL, TEXT_SQL, doc_text, documents, query
from folio.plans.sizes import spread
from folio.sources.adapters import FACTS, PREDICTIONS, adapted, plain
from folio.sources.tables import table

PAPERS = """
SELECT o_orderkey AS file_id, concat('doc_', CAST(o_orderkey AS STRING), CASE o_orderkey % 5 WHEN 0 THEN '_invoice.pdf' WHEN 1 THEN ' report.docx' ELSE '.txt' END) AS filename, o_orderkey % 2 = 0 AS french,
  concat(CASE o_orderkey % 16 WHEN 0 THEN 'FACTURE\nFacture no: 7' WHEN 1 THEN 'Devis\nDevis no 9\nValidité: 30 j' WHEN 2 THEN 'Contract\nbetween the parties' WHEN 3 THEN '  Bon de commande\nCommande n 3' WHEN 4 THEN 'Delivery note\ndelivered on'
    WHEN 5 THEN 'Relevé de compte\nIBAN x solde' WHEN 6 THEN 'Income tax\ntaxpayer' WHEN 7 THEN 'Bulletin de paie\nnet à payer' WHEN 8 THEN 'Employment contract\nemployee' WHEN 9 THEN 'Insurance policy\npolicyholder'
    WHEN 10 THEN 'Ticket de caisse\ncash' WHEN 11 THEN 'Curriculum vitae\nEducation' WHEN 12 THEN 'a\nb\nc\nd\ne\nRapport annuel' WHEN 13 THEN 'Objet : x\nMadame, Monsieur' WHEN 14 THEN '1\n2\n3\n4\n5\n6\n7\n8\n9\n10\n11\n12\nfacture' ELSE 'nothing known' END,
    '\n', CAST(o_custkey % 31 AS STRING), '/', CAST(o_orderkey % 14 AS STRING), '/', CAST(1990 + o_custkey % 30 AS STRING), ' and ', CAST(CAST(o_orderdate AS DATE) AS STRING), ' le ', CAST(1 + o_custkey % 30 AS STRING),
    CASE o_orderkey % 3 WHEN 0 THEN ' février ' WHEN 1 THEN ' june ' ELSE ' août ' END, '2019, ', 'May ', CAST(o_custkey % 40 AS STRING), ', 2020. ',
    CASE o_orderkey % 6 WHEN 0 THEN concat('€', CAST(o_custkey AS STRING), ',50') WHEN 1 THEN concat(CAST(o_custkey AS STRING), ' 1.234,56 EUR') WHEN 2 THEN concat('USD 12 345.', CAST(10 + o_custkey % 80 AS STRING))
      WHEN 3 THEN concat('$', CAST(o_custkey AS STRING)) WHEN 4 THEN concat('1,234 £ ', CAST(o_custkey AS STRING)) ELSE CAST(o_custkey AS STRING) END) AS body
FROM {orders}"""
PAPERS_SQL = plain(PAPERS).replace("'", "'")


def _papers(spark, sf_dir):
    return adapted(spark, sf_dir, PAPERS)


def _hit_sql(phrases, header: bool) -> str:
    quoted = ["'" + p.replace("'", "''") + "'" for p in phrases]
    if not header:
        return "(" + " OR ".join(f"contains(low, {p})" for p in quoted) + ")"
    begun = " OR ".join(f"starts_with(ltrim(x), {p})" for p in quoted)
    return f"(len(list_filter(lines, lambda x: {begun})) > 0 OR " + " OR ".join(f"contains(top, {p})" for p in quoted) + ")"


def _type_sql(kind: str) -> str:
    content = " + ".join(f"CASE WHEN {_hit_sql(ps, h)} THEN {w} ELSE 0 END" for ps, w, h in docs_ops.INDICATORS[kind])
    named = f"CASE WHEN contains(name, '{kind.replace('_', ' ')}') OR contains(name, '{kind}') THEN 0.2 ELSE 0 END"
    return f"SELECT file_id, '{kind}' AS document_type, (CASE WHEN {content} > 0 THEN least({content} + {named}, 0.99) * (0.5 + 0.5 * q) ELSE least({named}, 0.4) END)::DOUBLE AS score FROM lined"


_NL = lambda sql: sql.replace("\\n", "' || chr(10) || '")
PAPERS_CTE = f"papers AS ({_NL(PAPERS_SQL)})"
TYPES_SQL = f"""WITH {PAPERS_CTE}, lined AS (SELECT file_id, filename, body, lower(body) AS low, lower(filename) AS name, string_split(lower(body), chr(10))[1:12] AS lines, array_to_string(string_split(lower(body), chr(10))[1:4], chr(10)) AS top,
    CASE file_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.78 WHEN 2 THEN 0.35 ELSE 0.2 END AS q FROM papers), scored AS ({' UNION ALL '.join(_type_sql(k) for k in docs_ops.INDICATORS)}),
  best AS (SELECT file_id, document_type, score FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY score DESC, document_type) = 1)"""


def _status(id_col):
    return F.get(F.array(*map(F.lit, ("success", "partial", "skipped", "failed"))), (F.col(id_col) % 4).cast("int"))


def _best(spark, sf_dir):
    """The best type of every paper, classified once a session and kept for the queries that need it."""

    def write(folder: str) -> None:
        orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
        rows = spark.sql(PAPERS, orders=orders)
        q = docs_ops.quality(_status("file_id"), F.col("body"), F.lit(False), F.lit(False), F.lit(None).cast("double"))
        docs_ops.best_type(docs_ops.type_scores(rows, "file_id", F.col("body"), F.col("filename"), q), "file_id").write.parquet(folder)

    return spark.read.parquet(kept(spark, f"paper types of {sf_dir}", write))


@query(f"{TYPES_SQL} SELECT file_id, document_type, round(score, 6) AS score FROM best")
def semantic_type_rules(spark, sf_dir):
    return _best(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN repeat(chr(1), length(text)) ELSE text END AS t, CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.78 WHEN 2 THEN 0.35 ELSE 0.2 END AS b, doc_id % 5 = 0 AS cut, CASE WHEN doc_id % 7 = 0 THEN (doc_id % 11) / 11.0 END AS ocr FROM documents),
  q AS (SELECT doc_id, t, (CASE WHEN trim(coalesce(t, '')) = '' THEN least(b, 0.25) ELSE b END * CASE WHEN cut THEN 0.82 ELSE 1 END * CASE WHEN ocr IS NOT NULL THEN 0.55 + 0.45 * ocr ELSE 1 END
    * CASE WHEN length(t) - length(regexp_replace(t, '[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g')) > 0.08 * length(t) THEN 0.65 ELSE 1 END)::DOUBLE AS q FROM d)
  SELECT doc_id, round(q, 6) AS quality, CASE WHEN q >= 0.85 THEN 'good' WHEN q >= 0.6 THEN 'degraded' WHEN trim(coalesce(t, '')) = '' AND q <= 0.25 THEN 'unusable' ELSE 'poor' END AS band, round(0.9 * (0.5 + 0.5 * q), 6) AS adjusted FROM q""")
def semantic_input_quality(spark, sf_dir):
    odd = F.when(F.col("doc_id") % 9 == 0, F.repeat(F.lit("\x01"), F.length("text"))).otherwise(F.col("text"))
    rows = documents(spark, sf_dir).select("doc_id", odd.alias("t"))
    ocr = F.when(F.col("doc_id") % 7 == 0, (F.col("doc_id") % 11) / F.lit(11.0))
    rows = rows.withColumn("q", docs_ops.quality(_status("doc_id"), F.col("t"), F.col("doc_id") % 5 == 0, F.lit(False), ocr))
    return rows.select("doc_id", F.round("q", 6).alias("quality"), docs_ops.quality_band(F.col("q"), F.col("t")).alias("band"), F.round(docs_ops.adjusted(F.lit(0.9), F.col("q")), 6).alias("adjusted"))


@query(rf"""WITH {PAPERS_CTE}, s AS (SELECT file_id, french, unnest(list_distinct(list_concat(regexp_extract_all(body, '\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\b'), regexp_extract_all(body, '\b[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{4}}\b')))) AS surface FROM papers),
  n AS (SELECT *, list_transform(regexp_extract_all(surface, '[0-9]+'), lambda x: x::INT) AS p, regexp_matches(surface, '^[0-9]{{4}}') AS iso FROM s),
  d AS (SELECT *, CASE WHEN iso THEN surface END AS own, try_cast(printf('%04d-%02d-%02d', p[3], p[2], p[1]) AS DATE) AS df, try_cast(printf('%04d-%02d-%02d', p[3], p[1], p[2]) AS DATE) AS mf FROM n),
  r AS (SELECT file_id, surface, CASE WHEN iso THEN own WHEN p[1] > 12 THEN df::VARCHAR WHEN p[2] > 12 THEN mf::VARCHAR WHEN french THEN df::VARCHAR ELSE mf::VARCHAR END AS iso_date,
    CASE WHEN NOT iso AND p[1] <= 12 AND p[2] <= 12 AND p[1] <> p[2] THEN CASE WHEN french THEN mf ELSE df END END::VARCHAR AS alternate, CASE WHEN iso THEN 0.99 WHEN p[1] > 12 THEN 0.98 WHEN p[2] > 12 THEN 0.95 ELSE 0.72 END::DOUBLE AS confidence FROM d)
  SELECT * FROM r WHERE iso_date IS NOT NULL""")
def extract_numeric_dates(spark, sf_dir):
    return docs_ops.numeric_dates(_papers(spark, sf_dir), "file_id", F.col("body"), F.col("french"))


_MONTHS_SQL = "CASE m " + " ".join(f"WHEN '{m}' THEN {i + 1}" for names in (docs_ops.FRENCH_MONTHS, docs_ops.ENGLISH_MONTHS) for i, m in enumerate(names)) + " END"
_NAMED = "|".join(dict.fromkeys((*docs_ops.FRENCH_MONTHS, *docs_ops.ENGLISH_MONTHS)))


@query(rf"""WITH {PAPERS_CTE}, s AS (SELECT file_id, unnest(list_distinct(list_concat(regexp_extract_all(lower(body), '\b[0-9]{{1,2}}(?:er)? (?:{_NAMED}) [0-9]{{4}}\b'), regexp_extract_all(lower(body), '\b(?:{_NAMED}) [0-9]{{1,2}}, [0-9]{{4}}\b')))) AS surface FROM papers),
  p AS (SELECT *, regexp_extract(surface, '({_NAMED})', 1) AS m, regexp_extract(surface, '\b([0-9]{{1,2}})\b', 1)::INT AS d, regexp_extract(surface, '([0-9]{{4}})', 1)::INT AS y FROM s)
  SELECT file_id, surface, iso_date::VARCHAR AS iso_date, 0.98::DOUBLE AS confidence FROM (SELECT *, try_cast(printf('%04d-%02d-%02d', y, {_MONTHS_SQL}, d) AS DATE) AS iso_date FROM p) AS t WHERE iso_date IS NOT NULL""")
def extract_textual_dates(spark, sf_dir):
    return docs_ops.textual_dates(_papers(spark, sf_dir), "file_id", F.col("body"))


_MONEY_SQL = docs_ops.MONEY


@query(rf"""WITH {PAPERS_CTE}, s AS (SELECT file_id, list_filter(list_zip(regexp_extract_all(body, '{_MONEY_SQL}', 1), regexp_extract_all(body, '{_MONEY_SQL}', 2), regexp_extract_all(body, '{_MONEY_SQL}', 3)), lambda m: m[1] <> '' OR m[3] <> '') AS ms FROM papers),
  m AS (SELECT file_id, unnest(ms) AS m, unnest(range(len(ms))) AS position FROM s), n AS (SELECT file_id, position, regexp_replace(m[2], '[ \x{{A0}}\x{{202F}}]', '', 'g') AS flat, CASE WHEN m[3] <> '' THEN m[3] ELSE m[1] END AS mark FROM m)
  SELECT file_id, position, regexp_replace(flat, '[.,]', '', 'g')::BIGINT * CASE WHEN regexp_matches(flat, '[.,][0-9]{{2}}$') THEN 1 ELSE 100 END AS amount_minor,
    CASE WHEN mark IN ('€', 'EUR') THEN 'EUR' WHEN mark IN ('$', 'USD') THEN 'USD' ELSE 'GBP' END AS currency, CASE WHEN mark = '$' THEN 0.86 ELSE 0.98 END::DOUBLE AS confidence FROM n""")
def extract_money_values(spark, sf_dir):
    return docs_ops.money_values(_papers(spark, sf_dir), "file_id", F.col("body"))


@query(f"""{TYPES_SQL}, f AS ({plain(FACTS)}) SELECT file_id, CASE WHEN document_type IN ('invoice', 'quote', 'contract', 'purchase_order', 'delivery_note', 'bank_statement', 'tax_document', 'payslip') AND confidence >= 0.85 THEN substr(iso_date, 1, 4) END AS year,
  CASE file_id % 6 WHEN 0 THEN amount_minor * 100 WHEN 1 THEN amount_minor * 10 WHEN 2 THEN amount_minor WHEN 3 THEN amount_minor // 10 WHEN 4 THEN amount_minor // 100 END::BIGINT AS rescaled FROM best JOIN f USING (file_id)""")
def semantic_years(spark, sf_dir):
    rows = _best(spark, sf_dir).join(adapted(spark, sf_dir, FACTS), "file_id")
    year = docs_ops.useful_year(F.col("document_type"), F.col("iso_date"), F.col("confidence"))
    return rows.select("file_id", year.alias("year"), docs_ops.rescaled(F.col("amount_minor"), F.col("file_id") % 6).alias("rescaled"))


@query(f"""WITH p AS ({plain(PREDICTIONS)}) SELECT doc_id, round(CASE WHEN doc_id % 10 = 0 THEN probability ELSE 1 / (1 + exp(-(4 * probability - 2))) END, 6)::DOUBLE AS calibrated, round(probability, 6)::DOUBLE AS raw FROM p WHERE probability IS NOT NULL""")
def metrics_platt(spark, sf_dir):
    rows = adapted(spark, sf_dir, PREDICTIONS).where("probability is not null").withColumn("p", F.col("probability").cast("double"))
    curve = lambda n: F.round(docs_ops.calibrated(F.col("p"), 4.0, -2.0, n, F.col("doc_id") % 10 == 0), 6)
    return rows.select("doc_id", curve(100).alias("calibrated"), curve(3).alias("raw"))


@query(TEXT_SQL + r""", lines AS (SELECT file_id, extracted_text, unnest(string_split(extracted_text, chr(10))) AS t FROM docs),
  kinds AS (SELECT file_id, CASE WHEN starts_with(extracted_text, 'FACTURE') THEN 'invoice' WHEN starts_with(extracted_text, 'DEVIS') THEN 'quote' END AS kind FROM docs),
  l AS (SELECT file_id, lower(regexp_extract(t, '^([^:]+): ', 1)) AS label, regexp_extract(t, '^[^:]+: (.*)$', 1) AS value FROM lines)
  SELECT file_id, CASE label WHEN 'facture no' THEN 'invoice_number' WHEN 'devis no' THEN 'quote_number' WHEN 'client' THEN 'customer' WHEN 'fournisseur' THEN 'supplier' WHEN 'date de facture' THEN 'issue_date' WHEN 'total ttc' THEN CASE kind WHEN 'invoice' THEN 'total' ELSE 'amount' END END AS field, value
  FROM l JOIN kinds USING (file_id) WHERE kind IS NOT NULL AND label IN ('facture no', 'devis no', 'client', 'fournisseur', 'date de facture', 'total ttc')""")
def semantic_business_fields(spark, sf_dir):
    rows = doc_text(spark, sf_dir)
    types = understanding.document_types(rows, "file_id", "extracted_text")
    labels = [label for fields in docs_ops.FIELDS.values() for names in fields.values() for label in names]
    return docs_ops.business_fields(understanding.labelled(rows, "file_id", "extracted_text", list(dict.fromkeys(labels))), types, "file_id")


@query(f"""{TYPES_SQL}, fields AS (SELECT file_id, 'document_type' AS field, CASE WHEN score >= 0.25 THEN document_type ELSE 'unknown' END AS value, CASE WHEN score >= 0.85 THEN 'confirmed' WHEN score >= 0.65 THEN 'inferred' ELSE 'ambiguous' END AS status FROM best
    UNION ALL SELECT file_id, 'context', CASE WHEN file_id % 3 = 0 THEN 'unknown' WHEN file_id % 3 = 1 THEN 'business' END, 'inferred' FROM lined),
  held AS (SELECT file_id, bool_or(value IS NOT NULL AND value <> 'unknown') AS says, bool_or(status IN ('ambiguous', 'conflicting')) AS unsure FROM fields GROUP BY file_id)
  SELECT file_id, CASE WHEN NOT coalesce(says, false) THEN 'unknown' WHEN q < 0.85 OR unsure THEN 'partial' ELSE 'success' END AS status FROM lined LEFT JOIN held USING (file_id)""")
def semantic_status(spark, sf_dir):
    rows = _papers(spark, sf_dir)
    score, context = F.col("score"), F.when(F.col("file_id") % 3 == 0, "unknown").when(F.col("file_id") % 3 == 1, "business")
    sure = F.when(score >= 0.85, "confirmed").when(score >= 0.65, "inferred").otherwise("ambiguous")
    types = _best(spark, sf_dir).select("file_id", F.lit("document_type").alias("field"), F.when(score >= 0.25, F.col("document_type")).otherwise("unknown").alias("value"), sure.alias("status"))
    fields = types.unionByName(rows.select("file_id", F.lit("context").alias("field"), context.alias("value"), F.lit("inferred").alias("status")))
    q = docs_ops.quality(_status("file_id"), F.col("body"), F.lit(False), F.lit(False), F.lit(None).cast("double"))
    return docs_ops.analysis_status(fields, rows.select("file_id", docs_ops.quality_band(q, F.col("body")).alias("band")), "file_id")


@query(f"""{FACTS_SQL}, e AS (SELECT DISTINCT customer_name, coalesce(currency, 'none') AS kind, file_id // 40 AS "offset", substr(iso_date, 1, 4) AS text FROM facts),
  r AS (SELECT *, row_number() OVER (PARTITION BY customer_name ORDER BY "offset", kind, text) AS n FROM e)
  SELECT customer_name, string_agg(text, ',' ORDER BY n) AS evidence FROM r WHERE n <= 8 GROUP BY customer_name""")
def semantic_first_evidence(spark, sf_dir):
    rows = adapted(spark, sf_dir, FACTS).select("customer_name", F.coalesce("currency", F.lit("none")).alias("kind"), F.expr("file_id div 40").alias("offset"), F.substring("iso_date", 1, 4).alias("text"))
    return docs_ops.first_evidence(rows, ["customer_name"]).withColumn("evidence", F.array_join("evidence", ","))


@query(f"""{FACTS_SQL} SELECT customer_name, currency, file_id FROM facts WHERE currency IS NOT NULL QUALIFY row_number() OVER (PARTITION BY customer_name, currency ORDER BY confidence DESC, file_id) = 1""")
def semantic_entity_dedupe(spark, sf_dir):
    rows = adapted(spark, sf_dir, FACTS).where("currency is not null")
    return docs_ops.first_by(rows, ["customer_name", "currency"], [F.desc("confidence"), F.col("file_id")]).select("customer_name", "currency", "file_id")


# the text without its title, under its customer's name in capitals where the id is even
_HEADED_SQL = f"""{TEXT_SQL}, headed AS (SELECT file_id, CASE WHEN starts_with(extracted_text, 'FACTURE') THEN 'invoice' WHEN starts_with(extracted_text, 'DEVIS') THEN 'quote' END AS kind,
  CASE WHEN file_id % 2 = 0 THEN 'MAISON ' || (file_id % 50) || chr(10) ELSE '' END || replace(replace(extracted_text, 'FACTURE' || chr(10), ''), 'DEVIS' || chr(10), '') AS t FROM docs)"""


def _headed(spark, sf_dir):
    rows = doc_text(spark, sf_dir)
    kind = F.when(F.startswith("extracted_text", F.lit("FACTURE")), "invoice").when(F.startswith("extracted_text", F.lit("DEVIS")), "quote")
    bare = F.replace(F.replace("extracted_text", F.lit("FACTURE\n"), F.lit("")), F.lit("DEVIS\n"), F.lit(""))
    head = F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("MAISON "), (F.col("file_id") % 50).cast("string"), F.lit("\n"))).otherwise("")
    return rows.select("file_id", kind.alias("kind"), F.concat(head, bare).alias("t"))


_NUMBER = docs_ops.DOCUMENT_NUMBER.replace("'", "''")


@query(f"""{_HEADED_SQL}, m AS (SELECT file_id, kind, unnest(regexp_extract_all(t, '{_NUMBER}', 1)[1:8]) AS label, unnest(regexp_extract_all(t, '{_NUMBER}', 2)[1:8]) AS number, unnest(range(8)) AS position FROM headed)
  SELECT file_id, position, trim(upper(number), '._/-') AS number, number AS original, round(0.98 * 0.9, 6)::DOUBLE AS confidence FROM m
  WHERE number IS NOT NULL AND ((kind = 'invoice' AND lower(label) IN ('facture', 'invoice')) OR (kind = 'quote' AND lower(label) IN ('devis', 'quote', 'quotation', 'estimate')))
    AND regexp_matches(number, '[0-9]') AND length(trim(number, '._/-')) >= 3""")
def semantic_identifiers(spark, sf_dir):
    found = docs_ops.identifiers(_headed(spark, sf_dir), "file_id", F.col("t"), F.col("kind"), F.lit(0.8))
    return found.withColumn("confidence", F.round("confidence", 6))


@query(f"""{_HEADED_SQL}, l AS (SELECT file_id, trim(unnest(string_split(t, chr(10))[1:4])) AS line, unnest(range(4)) AS n FROM headed)
  SELECT file_id, arg_min(line, n) AS supplier FROM l WHERE length(regexp_replace(line, '\\P{{L}}', '', 'g')) >= 2 AND length(line) <= 80
    AND length(regexp_replace(line, '\\P{{Lu}}', '', 'g')) * 100 >= length(regexp_replace(line, '\\P{{L}}', '', 'g')) * 70
    AND NOT regexp_matches(lower(line), 'facture|invoice|devis|quote') GROUP BY file_id""")
def semantic_supplier_header(spark, sf_dir):
    rows = _headed(spark, sf_dir).select("file_id", docs_ops.supplier_header(F.col("t")).alias("supplier"))
    return rows.where("supplier is not null")
