"""Queries over typed questions, names, addresses, paths and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import interpret, normalise
from folio.plans.registry import FACTS_SQL, FILES_SQL, documents, files, query
from folio.sources.adapters import FACTS, OCCURRENCES, adapted, plain
from folio.sources.tables import table

ASKS = """
SELECT o_orderkey AS query_id, CASE o_orderkey % 9
         WHEN 0 THEN concat('Factures Fournisseur ', c_name, ' entre 100 et ', CAST(o_custkey AS STRING), ',5 euros')
         WHEN 1 THEN concat('devis client de Dupont plus de ', CAST(o_custkey AS STRING), ' 200,50 €')
         WHEN 2 THEN concat('Contrats personnels  MARS ', CAST(1990 + o_custkey % 40 AS STRING))
         WHEN 3 THEN concat('photos de l’année dernière ', c_name)
         WHEN 4 THEN concat('bon de commande environ ', CAST(o_custkey AS STRING), '.200 EUR chantier Étoile')
         WHEN 5 THEN concat('Été ', CAST(1990 + o_custkey % 40 AS STRING), ' ', c_name)
         WHEN 6 THEN concat('reports/final_', CAST(o_custkey AS STRING), '.pdf')
         WHEN 7 THEN concat('purchase order moins de ', CAST(o_custkey AS STRING), ' professionnel')
         ELSE 'retrouver le document' END AS asked
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
FORM_SQL = r"left(trim(regexp_replace(translate(lower(strip_accents({0})), '’‘`  ', '''''''  '), '\s+', ' ', 'g')), 512)"
THIS_YEAR = 2026


@query(f"SELECT doc_id, {FORM_SQL.format('text')} AS form FROM documents")
def text_search_form(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", normalise.search_form(F.col("text")).alias("form"))


def _minor_sql(x: str) -> str:
    c = rf"regexp_replace({x}, '\s', '', 'g')"
    decimal = rf"((contains({c}, ',') AND contains({c}, '.')) OR regexp_matches({c}, '[.,][0-9]{{0,2}}$'))"
    digits = rf"regexp_replace(CASE WHEN {decimal} THEN regexp_replace({c}, '[.,][0-9]*$', '') ELSE {c} END, '[.,]', '', 'g')"
    cents = rf"rpad(substr(CASE WHEN {decimal} THEN regexp_extract({c}, '[.,]([0-9]*)$', 1) ELSE '' END, 1, 2), 2, '0')::BIGINT"
    return f"CASE WHEN regexp_matches({digits}, '^[0-9]{{1,15}}$') THEN {digits}::BIGINT * 100 + {cents} END"


def _group_sql(groups: dict) -> str:
    held = lambda p: f"contains(' ' || q || ' ', ' {p} ')"
    return "CASE " + " ".join(f"WHEN {' OR '.join(map(held, ps))} THEN '{k}'" for k, ps in groups.items()) + " END"


def _relation_sql(kind: str, what: str) -> str:
    parts = []
    for mark in interpret.RELATIONS[kind]:
        raw = f"regexp_replace(substr(q, instr(q, '{mark} ') + {len(mark) + 1}), ' ({'|'.join(interpret.STOPS)}) .*$', '')"
        value = rf"regexp_replace(regexp_replace({raw}, '^[\s,;:.]+|[\s,;:.]+$', '', 'g'), '^de ', '')"
        usual = rf"{value} <> '' AND NOT regexp_matches({value}, '^([0-9]+( |$)|{'|'.join((*interpret.FRENCH_MONTHS, 'annee', 'last year'))})')"
        parts.append(f"WHEN contains(q, '{mark} ') THEN CASE WHEN {usual} THEN {value if what == 'value' else f'trim({chr(39)}{mark} {chr(39)} || {raw})'} END")
    return "CASE " + " ".join(parts) + " END"


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_B, _C, _S = (_sql_text(p) for p in (interpret.BETWEEN, interpret.COMPARED, interpret.SINGLE))
_x = lambda p, g: f"regexp_extract(q, {p}, {g})"
_MONTHS = "CASE m " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in interpret.MONTHS.items()) + " END"
_CODE = r"CASE WHEN regexp_matches(mark, '^(\$|dollars?|usd)$') THEN 'USD' WHEN mark IN ('£', 'gbp') THEN 'GBP' ELSE 'EUR' END"
_ALIASES = ", ".join(
    f"CASE WHEN {name} = '{g}' THEN '{p}' END" for name, groups in (("document_type", interpret.TYPES), ("context", interpret.CONTEXTS)) for g, ps in groups.items() for p in ps
)
_FILLER = ", ".join(f"'{w}'" for w in interpret.FILLER)
_WORDS = lambda t: rf"list_filter(list_transform(regexp_split_to_array({t}, '[^\p{{L}}\p{{N}}-]+'), lambda w: trim(w, '-')), lambda w: w <> '' AND w NOT IN ({_FILLER}))[1:32]"
INTERPRET_SQL = rf"""WITH asks AS ({plain(ASKS)}), norm AS (SELECT query_id, {FORM_SQL.format('asked')} AS q FROM asks),
  raw AS (SELECT *, {_group_sql(interpret.TYPES)} AS document_type, {_group_sql(interpret.CONTEXTS)} AS context,
    {_minor_sql(_x(_B, 1))} AS b1, {_minor_sql(_x(_B, 2))} AS b2, {_minor_sql(_x(_C, 2))} AS c1, regexp_matches({_x(_C, 1)}, '^(plus|sup|au)') AS above,
    {_minor_sql(_x(_S, 3))} AS s1, {_x(_S, 1)} <> '' OR {_x(_S, 2)} <> '' AS rough, {_x(_B, 0)} AS bs, {_x(_C, 0)} AS cs, {_x(_S, 0)} AS ss,
    regexp_extract(q, {_sql_text(interpret.MONTH_YEAR)}, 1) AS m, regexp_extract(q, {_sql_text(interpret.MONTH_YEAR)}, 2) AS my, regexp_extract(q, {_sql_text(interpret.YEAR)}, 1) AS y,
    regexp_extract(q, {_sql_text(interpret.LAST_YEAR)}, 0) AS ly, regexp_extract(q, {_sql_text(interpret.MONTH_YEAR)}, 0) AS ms,
    {', '.join(f'{_relation_sql(k, "value")} AS {k}, {_relation_sql(k, "span")} AS {k}_span' for k in interpret.RELATIONS)} FROM norm),
  kinds AS (SELECT *, CASE WHEN b1 IS NOT NULL AND b2 IS NOT NULL THEN 'b' WHEN c1 IS NOT NULL THEN 'c' WHEN s1 IS NOT NULL THEN 's' END AS k FROM raw),
  flat AS (SELECT *, CASE k WHEN 'b' THEN least(b1, b2) WHEN 'c' THEN CASE WHEN above THEN c1 + 1 END WHEN 's' THEN s1 - slack END AS amount_least,
    CASE k WHEN 'b' THEN greatest(b1, b2) WHEN 'c' THEN CASE WHEN NOT above THEN c1 - 1 END WHEN 's' THEN s1 + slack END AS amount_most, CASE k WHEN 's' THEN s1 END AS amount_target,
    CASE WHEN k IS NOT NULL THEN {_CODE} END AS currency, CASE k WHEN 'b' THEN bs WHEN 'c' THEN cs WHEN 's' THEN ss END AS amount_span,
    CASE WHEN ly <> '' THEN '{THIS_YEAR - 1}-01-01' WHEN m <> '' THEN make_date(my::INT, {_MONTHS}, 1)::VARCHAR WHEN y <> '' THEN y || '-01-01' END AS date_from,
    CASE WHEN ly <> '' THEN '{THIS_YEAR - 1}-12-31' WHEN m <> '' THEN last_day(make_date(my::INT, {_MONTHS}, 1))::VARCHAR WHEN y <> '' THEN y || '-12-31' END AS date_to,
    CASE WHEN ly <> '' THEN ly WHEN m <> '' THEN ms WHEN y <> '' THEN y END AS date_span
    FROM (SELECT *, CASE WHEN rough THEN greatest(s1 // 10, 1000) ELSE 0 END AS slack, CASE k WHEN 'b' THEN {_x(_B, 3)} WHEN 'c' THEN {_x(_C, 3)} ELSE {_x(_S, 4)} END AS mark FROM kinds) AS z),
  cut AS (SELECT *, array_to_string({_WORDS("list_reduce(list_prepend(q, list_transform(list_reverse_sort(list_transform(list_filter([amount_span, date_span, supplier_span, customer_span, project_span, " + _ALIASES + "], lambda s: trim(s) <> ''), lambda s: {'n': length(s), 's': s})), lambda x: x.s)), lambda t, s: replace(t, s, ' '))")}, ' ') AS l FROM flat),
  named AS (SELECT *, list_filter(string_split(l, ' '), lambda w: regexp_matches(w, '\p{{L}}'))[1:8] AS ws FROM cut)
  SELECT query_id, document_type, context, amount_least, amount_most, amount_target, currency, date_from, date_to, supplier, customer, project,
    CASE WHEN supplier IS NULL AND customer IS NULL AND len(ws) > 0 AND NOT (regexp_matches(q, '[/\\]') OR regexp_matches(q, '\S.*[.][\p{{L}}\p{{N}}]{{2,10}}$')) THEN array_to_string(ws, ' ') END AS party,
    CASE WHEN l <> '' THEN l ELSE array_to_string({_WORDS('q')}, ' ') END AS lexical FROM named"""


@query(INTERPRET_SQL)
def query_interpretation(spark, sf_dir):
    found = interpret.interpreted(adapted(spark, sf_dir, ASKS), "query_id", "asked", THIS_YEAR)
    return found.select(
        "query_id", "document_type", "context", *[F.col(f"amount.{c}").alias(f"amount_{c}") for c in ("least", "most", "target")], F.col("amount.currency").alias("currency"),
        F.col("date.from").alias("date_from"), F.col("date.to").alias("date_to"), *interpret.RELATIONS, "party", "lexical",
    )


_SINGULAR = "CASE lower(t) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in interpret.SINGULARS.items()) + " END"


@query(rf"""WITH asks AS ({plain(ASKS)}), t AS (SELECT query_id, regexp_extract_all(asked, '[\p{{L}}\p{{N}}]+')[1:32] AS ts FROM asks)
  SELECT query_id, array_to_string(list_transform(ts, lambda t: t || CASE WHEN length(t) >= 2 THEN '*' ELSE '' END || coalesce('|' || {_SINGULAR}, '')), ' ') AS prefixes,
    array_to_string(list_filter(ts, lambda t: length(t) >= 2)[1:12], ' ') AS exact FROM t""")
def query_terms(spark, sf_dir):
    rows = adapted(spark, sf_dir, ASKS).select("query_id", interpret.query_terms(F.col("asked")).alias("ts"))
    shown = F.transform(interpret.prefix_terms(F.col("ts")), lambda t: F.concat(t["term"], F.when(t["prefix"], "*").otherwise(""), F.coalesce(F.concat(F.lit("|"), t["also"]), F.lit(""))))
    return rows.select("query_id", F.array_join(shown, " ").alias("prefixes"), F.array_join(interpret.exact_terms(F.col("ts")), " ").alias("exact"))


_FORMS = "|".join(normalise.LEGAL_FORMS)
NAME_SQL = rf"""WITH o AS ({plain(OCCURRENCES)}), e AS (SELECT occurrence_key, original_value, trim(regexp_replace(lower(original_value), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS exact FROM o),
  f AS (SELECT *, regexp_extract(exact, '^(?:.* )?(s a s|s a r l|s a|l l c)$', 1) AS spaced, regexp_extract(exact, '^(?:.* )?({_FORMS})$', 1) AS short FROM e),
  g AS (SELECT *, CASE WHEN spaced <> '' THEN spaced WHEN short <> '' THEN short END AS found FROM f)"""


@query(f"""{NAME_SQL} SELECT occurrence_key, exact, trim(left(exact, length(exact) - length(coalesce(found, '')))) AS core, replace(found, ' ', '') AS form,
  CASE WHEN regexp_matches(original_value, '\\p{{Ll}}') THEN original_value ELSE array_to_string(list_transform(string_split(lower(original_value), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS shown,
  CASE WHEN contains(exact, 'firm') THEN 1.0 / len(list_distinct(list_concat(string_split(exact, ' '), ['firm']))) ELSE 0 END::DOUBLE AS likeness FROM g""")
def identity_name_parts(spark, sf_dir):
    rows = adapted(spark, sf_dir, OCCURRENCES).withColumn("n", normalise.name_parts(F.col("original_value")))
    near = normalise.jaccard(F.split("n.exact", " "), F.array(F.lit("firm")))
    return rows.select("occurrence_key", "n.exact", "n.core", "n.form", normalise.title_case(F.col("original_value")).alias("shown"), near.alias("likeness"))


ADDRESSES = """
SELECT c_custkey AS id, concat(CASE c_custkey % 7 WHEN 0 THEN '.' WHEN 1 THEN 'a..b' WHEN 2 THEN ' ' ELSE 'x+' END, replace(c_name, '#', ''),
         CASE c_custkey % 5 WHEN 0 THEN '@Firm.example' WHEN 1 THEN '@-bad.example' WHEN 2 THEN '@host' WHEN 3 THEN '@a@b.example' ELSE '@sub.firm.co.uk.' END) AS address
FROM {customer}"""


@query(rf"""WITH a AS ({plain(ADDRESSES)}), s AS (SELECT id, address, lower(trim(address)) AS low FROM a),
  p AS (SELECT *, split_part(low, '@', 1) AS local, trim(trim(split_part(low, '@', -1)), '.') AS host, len(string_split(low, '@')) AS n FROM s),
  d AS (SELECT *, CASE WHEN regexp_matches(host, '^([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?[.])+[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?$') AND length(host) <= 253 THEN host END AS domain FROM p)
  SELECT id, domain, CASE WHEN n = 2 AND domain IS NOT NULL AND length(local) BETWEEN 1 AND 64 AND length(low) <= 254 AND regexp_matches(local, '^[a-z0-9+_-]+([.][a-z0-9+_-]+)*$') THEN local || '@' || domain END AS email FROM d""")
def identity_addresses(spark, sf_dir):
    rows = adapted(spark, sf_dir, ADDRESSES)
    return rows.select("id", normalise.domain(F.substring_index("address", "@", -1)).alias("domain"), normalise.email(F.col("address")).alias("email"))


@query(rf"""{FACTS_SQL}, j AS (SELECT file_id, concat('  ( ', customer_name, '  ;', coalesce(currency, '-'), ') ') AS raw, amount_minor, currency, customer_name FROM facts),
  e AS (SELECT *, regexp_replace(trim(regexp_replace(raw, '\s+', ' ', 'g')), '^[!-*,./:-?\[-`{{-~]+|[!-*,./:-?\[-`{{-~]+$', '', 'g') AS v FROM j)
  SELECT file_id, v AS value, 'text:' || lower(v) AS value_key, array_to_string(list_filter([customer_name, currency], lambda x: x IS NOT NULL), ', ') AS listed,
    sha256(concat('customer', chr(10), lower(v))) AS signature, amount_minor::VARCHAR AS stored FROM e""")
def entity_values(spark, sf_dir):
    rows = adapted(spark, sf_dir, FACTS)
    raw = F.concat(F.lit("  ( "), "customer_name", F.lit("  ;"), F.coalesce("currency", F.lit("-")), F.lit(") "))
    value, stored = normalise.entity_value(raw), F.to_json(F.struct(F.struct("amount_minor").alias("money")))
    key = normalise.value_key(F.lit("text"), raw)
    return rows.select(
        "file_id", value.alias("value"), key.alias("value_key"), normalise.text_list(F.array_compact(F.array("customer_name", "currency"))).alias("listed"),
        normalise.signature(F.lit("customer"), F.lower(value)).alias("signature"), F.get_json_object(stored, "$.money.amount_minor").alias("stored"),
    )


PATHS = """
SELECT c_custkey AS id, CASE c_custkey % 10 WHEN 0 THEN 'con.txt' WHEN 1 THEN concat('a<b>|', c_name, '?.pdf ') WHEN 2 THEN '..' WHEN 3 THEN concat('scan_', CAST(c_custkey AS STRING), '.jpg')
         WHEN 4 THEN 'x/y' WHEN 5 THEN '  ' WHEN 6 THEN concat(CAST(c_custkey AS STRING), '.7.png') WHEN 7 THEN 'C:name. ' WHEN 8 THEN concat(repeat('long', 40), '.', c_name, '.docx') ELSE 'Facture.pdf' END AS name,
       concat(CASE c_custkey % 3 WHEN 0 THEN 'Business' WHEN 1 THEN 'old' ELSE 'personnel' END, '/', c_name, '\\\\', CASE c_custkey % 4 WHEN 0 THEN 'Invoices' ELSE 'misc' END, '//f.txt') AS path,
       concat('business/', lower(c_name), '/invoices') AS wanted
FROM {customer}"""
PATHS_SQL = plain(PATHS).replace("\\\\", "\\")
_RESERVED = r"(?i)^(con|prn|aux|nul|(com|lpt)[1-9])([.].*)?$"


@query(rf"""WITH p AS ({PATHS_SQL}), f0 AS (SELECT id, name, regexp_replace(regexp_replace(trim(name), '[<>:"|?*/\\\x00-\x1F]+', '_', 'g'), '[ .]+$', '') AS f FROM p),
  f1 AS (SELECT id, name, CASE WHEN f = '' THEN 'Unclassified' ELSE f END AS f FROM f0), f2 AS (SELECT id, name, CASE WHEN regexp_matches(f, '{_RESERVED}') THEN '_' || f ELSE f END AS f FROM f1),
  f3 AS (SELECT *, regexp_extract(f, '^.+([.][^.]{{1,16}})$', 1) AS e FROM f2), f4 AS (SELECT *, CASE WHEN length(f) <= 120 THEN f ELSE left(f, 120 - length(e)) || e END AS safe FROM f3),
  s AS (SELECT *, lower(regexp_replace(name, '[.][^.]*$', '')) AS stem, regexp_extract(safe, '^(.+?)([.][^.]{{1,16}})?$', 1) AS st, regexp_extract(safe, '^(.+?)([.][^.]{{1,16}})?$', 2) AS en FROM f4)
  SELECT id, safe, CASE WHEN trim(name) = '' THEN 'empty' WHEN name IN ('.', '..') OR regexp_matches(name, '[/\\]') THEN 'traversal' WHEN regexp_matches(name, '^[A-Za-z]:') THEN 'drive'
    WHEN regexp_matches(name, '[<>:"|?*\x00-\x1F]') OR regexp_matches(name, '[ .]$') THEN 'invalid' WHEN regexp_matches(name, '{_RESERVED}') THEN 'reserved' WHEN length(name) > 120 THEN 'too_long' END AS fault,
    regexp_matches(stem, '^(scan|img|image|document|file)([_-].*)?$') OR stem IN ('facture', 'invoice') OR length(stem) - length(regexp_replace(stem, '[0-9]', '', 'g')) >= strlen(stem) // 2 AS generic,
    lower('Papers\' || safe) AS collision_key, left(st, greatest(118 - length(en), 1)) || '_2' || en AS second FROM s""")
def path_safety(spark, sf_dir):
    rows = adapted(spark, sf_dir, PATHS).withColumn("safe", normalise.safe_component(F.col("name")))
    return rows.select(
        "id", "safe", normalise.component_fault(F.col("name")).alias("fault"), normalise.generic_name(F.col("name")).alias("generic"),
        normalise.collision_key(F.array(F.lit("Papers")), F.col("safe")).alias("collision_key"), normalise.collision_name(F.col("safe"), F.lit(2)).alias("second"),
    )


@query(rf"""WITH p AS ({PATHS_SQL}), s AS (SELECT id, list_filter(regexp_split_to_array(path, '[/\\]'), lambda x: trim(x) <> '')[1:3] AS a, string_split(wanted, '/') AS b FROM p),
  t AS (SELECT *, list_transform(a, lambda x: lower(x)) AS la, len(list_filter(list_transform(a, lambda x: lower(x)), lambda x: list_contains(b, x))) AS met FROM s)
  SELECT id, array_to_string(a, '/') AS folders, la[1] IN ('business', 'personnel') AND met >= 2 AND met * 2 >= 3 AS useful,
    round(CASE WHEN la = b THEN 0.15 ELSE (1 - met / 3.0) * 0.85 + 0.15 END, 6)::DOUBLE AS disruption FROM t""")
def path_structure(spark, sf_dir):
    rows = adapted(spark, sf_dir, PATHS).select("id", normalise.parent_parts(F.col("path"), F.lit("F.TXT")).alias("a"), F.split("wanted", "/").alias("b"))
    cost = normalise.disruption(F.col("a"), F.col("b"), F.lit("f.txt"), F.lit("g.txt"))
    return rows.select("id", F.array_join("a", "/").alias("folders"), normalise.structure_useful(F.col("a"), F.col("b")).alias("useful"), F.round(cost, 6).alias("disruption"))


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: 0.0::DOUBLE) WHEN vec_id % 13 = 0 THEN (embedding::DOUBLE[])[1:3] ELSE list_transform(embedding::DOUBLE[], lambda x: x * 3) END AS v FROM embeddings),
  n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
  SELECT vec_id, len(v) = (SELECT max(len(embedding)) FROM embeddings) AND n * n > 1e-12 AS valid, round(list_sum(CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END), 6)::DOUBLE AS unit_sum FROM n""")
def vector_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    dimensions = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    v = F.when(F.col("vec_id") % 11 == 0, zero).when(F.col("vec_id") % 13 == 0, F.slice(F.col("embedding").cast("array<double>"), 1, 3)).otherwise(F.transform("embedding", lambda x: x.cast("double") * 3))
    rows = rows.select("vec_id", v.alias("v"))
    total = F.aggregate(normalise.unit(F.col("v")), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", normalise.valid_vector(F.col("v"), dimensions).alias("valid"), F.round(total, 6).alias("unit_sum"))


@query(f"""{FILES_SQL} SELECT file_id, concat_ws(chr(10), 'filename: ' || filename, CASE WHEN extension <> '' THEN 'type: ' || extension END, CASE WHEN parent_path <> '' THEN 'folder: ' || parent_path END, 'identity: ' || split_part(parent_path, '/', 1)) AS summary,
  ceil(length(text) / 3.0)::BIGINT AS tokens, left(text, 96) AS beginning FROM files""")
def metadata_summary(spark, sf_dir):
    field = lambda name, c: F.struct(F.lit(name).alias("name"), F.col(c).alias("value"))
    fields, identities = F.array(field("type", "extension"), field("folder", "parent_path")), F.slice(F.split("parent_path", "/"), 1, 1)
    return files(spark, sf_dir).select(
        "file_id", normalise.metadata_summary(F.col("filename"), fields, identities).alias("summary"), normalise.token_estimate(F.col("text")).alias("tokens"), normalise.truncated(F.col("text"), 32).alias("beginning")
    )
