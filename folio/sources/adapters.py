"""Logical tables of the engine over the parquet tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.sources.tables import table

FILES = """
SELECT doc_id AS file_id,
       concat('doc_', lpad(CAST(doc_id AS STRING), 6, '0'),
              CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.xlsx'
                              WHEN 3 THEN '.txt' WHEN 4 THEN '.jpg' ELSE '.zip' END) AS filename,
       CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'xlsx'
                       WHEN 3 THEN 'txt' WHEN 4 THEN 'jpg' ELSE 'zip' END AS extension,
       concat(coalesce(source, 'none'), '/', coalesce(lang, 'none')) AS parent_path,
       n_chars AS byte_size, md5(text) AS digest, doc_id * 3600000 AS modified_ms, text, source, lang
FROM {documents}"""

WATCH = """
SELECT event_id AS seq, user_id % 3 AS root_id, concat('p/', CAST(user_id AS STRING)) AS path,
       CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'modified'
            WHEN 'purchase' THEN 'moved' WHEN 'error' THEN 'removed' ELSE 'metadata' END AS kind,
       unix_millis(CAST(ts AS TIMESTAMP)) AS at_ms, CAST(floor(value) AS BIGINT) AS byte_size
FROM {events}"""

FACTS = """
SELECT o_orderkey AS file_id,
       CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor,
       CASE o_orderkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN NULL ELSE 'EUR' END AS currency,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS iso_date,
       c_name AS customer_name,
       (o_orderkey * 37 % 100) / 100.0 AS confidence,
       o_orderkey % 11 = 0 AS user_confirmed
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

DOC_TEXT = """
SELECT o_orderkey AS file_id,
       CASE o_orderkey % 3
         WHEN 0 THEN concat('FACTURE', chr(10), 'Facture No: INV-', CAST(o_orderkey AS STRING), chr(10),
                            'Client: ', c_name, chr(10), 'Fournisseur: Supplier ', CAST(o_custkey % 40 AS STRING), chr(10),
                            'Date de facture: ', CAST(CAST(o_orderdate AS DATE) AS STRING), chr(10),
                            'Total TTC: ', CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING), ' EUR')
         WHEN 1 THEN concat('DEVIS', chr(10), 'Devis No: Q-', CAST(o_orderkey AS STRING), chr(10), 'Client: ', c_name, chr(10),
                            'contact: ', lower(replace(c_name, '#', '')), '@firm', CAST(o_custkey % 9 AS STRING), '.example.com')
         ELSE concat('Objet : relance', chr(10), 'Madame, Monsieur', chr(10), c_name)
       END AS extracted_text
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

OCCURRENCES = """
SELECT concat('c', CAST(c_custkey AS STRING)) AS occurrence_key, 'customer' AS role,
       concat('Firm ', CAST(c_custkey % 60 AS STRING), CASE c_custkey % 4 WHEN 0 THEN ' SAS' WHEN 1 THEN ' SARL' WHEN 2 THEN '' ELSE ' S.A.S' END) AS original_value,
       concat('firm', CAST(c_custkey % 60 AS STRING), '.example') AS domain,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('FR', lpad(CAST(c_custkey % 45 AS STRING), 9, '7')) END AS company_identifier
FROM {customer}
UNION ALL
SELECT concat('s', CAST(s_suppkey AS STRING)), 'supplier',
       upper(concat('Firm ', CAST(s_suppkey % 60 AS STRING))),
       CASE WHEN s_suppkey % 2 = 0 THEN 'gmail.com' ELSE concat('firm', CAST(s_suppkey % 60 AS STRING), '.example') END,
       concat('FR', lpad(CAST(s_suppkey % 45 AS STRING), 9, '7'))
FROM {supplier}"""

PREDICTIONS = """
SELECT l.doc_id, d.n_chars / (d.n_chars + 2000.0) AS probability, l.quality = 1 AS positive
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"""

TABLES = ("documents", "events", "orders", "customer", "supplier", "labels")


def adapted(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the adapters above as a DataFrame; only the tables it names are read."""
    named = [n for n in TABLES if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in named})


def plain(sql: str) -> str:
    """The same adapter for DuckDB."""
    return sql.format(**{n: n for n in TABLES}).replace("unix_millis(CAST(ts AS TIMESTAMP))", "epoch_us(CAST(ts AS TIMESTAMP)) // 1000")
