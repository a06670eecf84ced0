"""Queries over proposals of where files should go: built whole, and from what changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import proposals
from folio.plans.lineage import kept, store_by
from folio.plans.registry import query
from folio.plans.sizes import spread
from folio.sources.adapters import FACTS, adapted, plain
from folio.sources.commits import Change, Tables

INPUTS = """
SELECT file_id, concat(folder, '/', name) AS path, name, context, 0.95 AS context_confidence, document_type, 0.7 + file_id % 4 * 0.1 AS type_confidence,
  CASE WHEN file_id % 3 <> 0 THEN customer_name END AS customer, CASE WHEN file_id % 2 = 0 THEN concat('Supplier ', CAST(file_id % 11 AS STRING)) END AS supplier,
  CASE WHEN file_id % 6 = 0 THEN concat('Project ', CAST(file_id % 23 AS STRING)) END AS project, CASE WHEN file_id % 5 <> 2 THEN 0.95 END AS relation_confidence,
  CASE WHEN file_id % 3 <> 1 THEN iso_date END AS date, CASE WHEN file_id % 4 = 1 THEN concat('N', CAST(file_id % 9 AS STRING)) END AS identifier, CASE WHEN file_id % 17 = 0 THEN 0.5 ELSE 0.9 END AS quality,
  CASE file_id % 12 WHEN 0 THEN 'partial' WHEN 1 THEN NULL ELSE 'success' END AS semantic_status, CASE WHEN file_id % 29 = 0 THEN 'partial' ELSE 'success' END AS extraction_status,
  CASE WHEN file_id % 31 = 0 THEN 'low_quality' ELSE '' END AS review_reasons, file_id % 13 = 0 AS duplicate, CASE file_id % 37 WHEN 0 THEN 'preserve' WHEN 1 THEN 'project' END AS rule,
  CASE WHEN file_id % 41 = 0 THEN false END AS rule_years, CASE file_id % 43 WHEN 0 THEN 'keep' WHEN 1 THEN 'review' WHEN 2 THEN 'rename' END AS override, CASE WHEN file_id % 43 = 2 THEN 'Mine.pdf' END AS override_name
FROM (SELECT *, CASE file_id % 8 WHEN 0 THEN 'Business/Clients' WHEN 1 THEN 'Inbox' ELSE concat('Inbox/', coalesce(currency, 'none')) END AS folder,
        CASE file_id % 4 WHEN 0 THEN concat('scan_', CAST(file_id % 50 AS STRING), '.pdf') WHEN 1 THEN 'scan.pdf' ELSE concat('report ', CAST(file_id % 200 AS STRING), '.pdf') END AS name,
        CASE file_id % 5 WHEN 0 THEN 'Personal' WHEN 4 THEN 'unknown' ELSE 'business' END AS context,
        CASE file_id % 7 WHEN 0 THEN 'invoice' WHEN 1 THEN 'quote' WHEN 2 THEN 'contract' WHEN 3 THEN 'photo' WHEN 4 THEN 'tax_document' WHEN 5 THEN 'cv' ELSE NULL END AS document_type FROM ({facts}) AS f) AS g"""
CHANGED = "file_id % 9 = 4 AND amount_minor % 5 = 0"
DELETED = "file_id % 9 = 5 AND amount_minor % 7 = 0"
FACTS_AFTER = f"""SELECT file_id, amount_minor, currency, CASE WHEN {CHANGED} THEN '2021-03-04' ELSE iso_date END AS iso_date, CASE WHEN {CHANGED} THEN 'Moved Client' ELSE customer_name END AS customer_name, confidence, user_confirmed
  FROM ({{facts}}) AS x WHERE NOT ({DELETED})"""
PREFERENCES = proposals.Preferences(least_group=3)


def _inputs(spark, sf_dir, after: bool = False, only: str = "true"):
    """The inputs of a proposal, dealt by file while they are narrow: as many tasks compile them as the session shuffles to."""
    facts = adapted(spark, sf_dir, FACTS)
    if after:
        facts = spark.sql(FACTS_AFTER.format(facts="SELECT * FROM {facts}"), facts=facts)
    facts = spread(facts.where(only) if only != "true" else facts, "file_id")
    rows = spark.sql(INPUTS.format(facts="SELECT * FROM {facts}"), facts=facts)
    doubles = [F.col(c).cast("double").alias(c) if c in ("context_confidence", "type_confidence", "relation_confidence", "quality") else c for c in rows.columns]
    return rows.select(*doubles, F.lit(None).cast("array<string>").alias("rule_destination"), F.lit(None).cast("array<string>").alias("override_destination"))


def _names_sql(names: dict[str, str], key: str = "document_type") -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


def _build_sql(facts: str) -> str:
    """The proposal of the inputs above in SQL: the policy by clients first, groups of three, numbered names, each folded in order."""
    p = proposals
    private = "CASE document_type " + " ".join(f"WHEN '{k}' THEN ['" + "', '".join(v) + "']" for k, v in p.PERSONAL.items()) + " ELSE ['Administrative'] END"
    dated = "document_type IN ('" + "', '".join(p.DATED) + "')"
    return rf"""WITH RECURSIVE inputs AS ({INPUTS.format(facts=facts)}),
  w AS (SELECT * REPLACE (lower(coalesce(context, 'unknown')) AS context, coalesce(document_type, 'unknown') AS document_type), list_filter(string_split(regexp_replace(path, '/[^/]*$', ''), '/'), lambda x: x <> '') AS source FROM inputs),
  c AS (SELECT *, round(((0.95 * 0.35 + type_confidence * 0.3 + coalesce(relation_confidence * 0.25, 0) + quality * 0.1) / (0.35 + 0.3 + CASE WHEN relation_confidence IS NULL THEN 0 ELSE 0.25 END + 0.1)
      * CASE WHEN semantic_status = 'partial' THEN 0.85 ELSE 1 END * CASE WHEN review_reasons <> '' THEN 0.8 ELSE 1 END)::DOUBLE, 9) AS confidence FROM w),
  r AS (SELECT *, context = 'unknown' OR document_type = 'unknown' OR type_confidence < 0.85 OR semantic_status IS NULL OR quality < 0.65 OR extraction_status <> 'success' OR review_reasons <> '' OR confidence < 0.65 AS review0 FROM c),
  y AS (SELECT *, CASE WHEN {dated} AND coalesce(rule_years, true) AND regexp_matches(date, '^(19|20|21)') THEN [substr(date, 1, 4)] ELSE [] END AS year, document_type = 'invoice' AND supplier IS NOT NULL AND project IS NOT NULL AS within,
      review0 AND (confidence < 0.65 OR context = 'unknown') AS aside FROM r),
  t AS (SELECT *, CASE WHEN within THEN 'Supplier Invoices' ELSE {_names_sql(p.TYPE_FOLDERS)} END AS tf, coalesce({_names_sql(p.AREAS)}, 'Administration') AS area,
      project IS NOT NULL AND (coalesce(rule = 'project', false) OR document_type = 'photo' OR (within AND customer IS NULL)) AS by_project FROM y),
  d0 AS (SELECT *, CASE WHEN aside THEN ['TO_REVIEW'] WHEN context = 'personal' THEN ['Personal'] || {private} WHEN by_project THEN ['Business', 'Projects', project]
      WHEN customer IS NOT NULL THEN ['Business', 'Clients', customer] || CASE WHEN project IS NULL THEN [] ELSE [project] END WHEN project IS NOT NULL THEN ['Business', 'Projects', project] WHEN supplier IS NOT NULL THEN ['Business', 'Suppliers', supplier] ELSE ['Business', area] END AS fixed,
    CASE WHEN aside THEN [] WHEN context = 'personal' THEN year WHEN by_project THEN (CASE WHEN tf IS NULL THEN [] ELSE [tf] END) || year ELSE year || (CASE WHEN tf IS NULL THEN [] ELSE [tf] END) END AS tail FROM t),
  d1 AS (SELECT *, len(list_filter(source, lambda s: list_contains(list_transform(fixed || tail, lambda x: lower(x)), lower(s)))) AS m FROM d0),
  d2 AS (SELECT *, coalesce(rule = 'preserve', false) OR (NOT review0 AND lower(source[1]) IN ('business', 'personal') AND m >= 2 AND m * 2 >= least(len(source), len(list_distinct(list_transform(fixed || tail, lambda x: lower(x)))))) AS stays FROM d1),
  d3 AS (SELECT * REPLACE (CASE WHEN stays THEN source ELSE fixed END AS fixed, CASE WHEN stays THEN [] ELSE tail END AS tail) FROM d2),
  named AS (SELECT *, regexp_replace(name, '[.][^.]*$', '') AS stem, list_filter([date, coalesce(supplier, customer), CASE WHEN document_type <> 'unknown' THEN coalesce({_names_sql(p.SINGULAR)}, 'Document') END, identifier], lambda x: x IS NOT NULL) AS known FROM d3),
  n2 AS (SELECT *, CASE WHEN confidence >= 0.85 AND len(known) >= 2 AND (regexp_matches(lower(stem), '^(scan|img|image|document|file)([_-].*)?$') OR length(regexp_replace(stem, '[^0-9]', '', 'g')) >= length(stem) // 2)
      THEN replace(array_to_string(known, '_'), '#', '#') || '.pdf' ELSE name END AS machine_name FROM named),
  o AS (SELECT *, CASE override WHEN 'keep' THEN source WHEN 'review' THEN ['TO_REVIEW'] ELSE fixed END AS f, CASE WHEN override IS NULL THEN tail ELSE [] END AS tl, CASE WHEN override = 'rename' THEN fixed || tail END AS renamed_to,
      CASE override WHEN 'keep' THEN name WHEN 'rename' THEN override_name ELSE machine_name END AS wanted, CASE override WHEN 'keep' THEN false WHEN 'review' THEN true ELSE review0 END AS needs_review FROM n2),
  o2 AS (SELECT *, coalesce(renamed_to, f) AS f2, CASE WHEN renamed_to IS NULL THEN tl ELSE [] END AS t2 FROM o),
  k AS (SELECT *, CASE WHEN duplicate THEN 'no_action' WHEN override = 'keep' THEN 'keep_in_place' WHEN f2 || t2 = ['TO_REVIEW'] THEN 'to_review' WHEN lower(array_to_string(source, '\')) = lower(array_to_string(f2 || t2, '\')) THEN CASE WHEN lower(name) = lower(wanted) THEN 'keep_in_place' ELSE 'rename' END ELSE 'move' END AS kind0 FROM o2),
  sizes AS (SELECT lower(array_to_string((f2 || t2)[1:i], '\')) AS folder, count(*) AS files FROM k, unnest(range(1, len(f2 || t2) + 1)) AS g(i) GROUP BY 1),
  tails AS (SELECT file_id, max(i) AS keep FROM k, unnest(range(1, len(t2) + 1)) AS g(i) JOIN sizes ON folder = lower(array_to_string((f2 || t2)[1:len(f2) + i], '\')) WHERE files >= 3 GROUP BY file_id),
  grouped AS (SELECT k.*, f2 || t2[1:coalesce(keep, 0)] AS destination FROM k LEFT JOIN tails USING (file_id)),
  moving AS (SELECT file_id, lower(array_to_string(destination || [wanted], '\')) AS key, override IS NOT NULL AS mine, row_number() OVER (ORDER BY file_id) AS i FROM grouped WHERE kind0 NOT IN ('keep_in_place', 'no_action')),
  parts AS (SELECT *, regexp_extract(key, '^(.+?)([.][^.\\]{{1,16}})?$', 1) AS stem, regexp_extract(key, '^(.+?)([.][^.\\]{{1,16}})?$', 2) AS ending, regexp_replace(regexp_extract(key, '^(.+?)([.][^.\\]{{1,16}})?$', 1), '(_[0-9]+)+$', '') AS family FROM moving),
  lists AS (SELECT family, ending, list({{'id': file_id, 'key': key, 'stem': stem, 'mine': mine}} ORDER BY file_id) AS l FROM parts GROUP BY ALL HAVING count(*) > 1),
  folded AS (SELECT family, ending, list_reduce(list_prepend({{'seen': []::VARCHAR[], 'out': []::STRUCT(id BIGINT, number BIGINT, again BOOLEAN)[], 'id': 0::BIGINT, 'key': '', 'stem': '', 'mine': false}},
      list_transform(l, lambda x: {{'seen': []::VARCHAR[], 'out': []::STRUCT(id BIGINT, number BIGINT, again BOOLEAN)[], 'id': x.id, 'key': x.key, 'stem': x.stem, 'mine': x.mine}})),
    lambda a, x: CASE WHEN NOT list_contains(a.seen, x.key) THEN {{'seen': list_append(a.seen, x.key), 'out': a.out, 'id': 0::BIGINT, 'key': '', 'stem': '', 'mine': false}}
      WHEN x.mine THEN {{'seen': list_append(a.seen, x.key), 'out': list_append(a.out, {{'id': x.id, 'number': 0::BIGINT, 'again': true}}), 'id': 0::BIGINT, 'key': '', 'stem': '', 'mine': false}}
      ELSE {{'seen': a.seen || [x.key, x.stem || '_' || list_filter(range(len(list_filter(a.seen, lambda s: s = x.key)) + 1, len(a.seen) + 3), lambda n: NOT list_contains(a.seen, x.stem || '_' || n || ending))[1] || ending],
        'out': list_append(a.out, {{'id': x.id, 'number': list_filter(range(len(list_filter(a.seen, lambda s: s = x.key)) + 1, len(a.seen) + 3), lambda n: NOT list_contains(a.seen, x.stem || '_' || n || ending))[1], 'again': true}}), 'id': 0::BIGINT, 'key': '', 'stem': '', 'mine': false}} END) AS r FROM lists),
  numbers AS (SELECT o.id AS file_id, o.number AS number FROM (SELECT unnest(r.out) AS o FROM folded) AS u)
  SELECT file_id, array_to_string(destination, '\') AS destination, CASE WHEN number > 0 THEN regexp_replace(wanted, '[.]pdf$', '') || '_' || number || '.pdf' ELSE wanted END AS new_name, CASE WHEN number = 0 THEN 'to_review' ELSE kind0 END AS kind,
    CASE WHEN number > 0 THEN 'auto_resolved' WHEN number = 0 THEN 'destination_collision' ELSE 'none' END AS conflict, needs_review OR coalesce(number = 0, false) AS needs_review, confidence
  FROM grouped LEFT JOIN numbers USING (file_id)"""


SHOWN = ("file_id", "destination", "new_name", "kind", "conflict", "needs_review", "confidence")


def _shown(operations):
    return operations.withColumn("destination", F.array_join("destination", "\\")).select(*SHOWN)


KEYED = {"key": ("file_id",), "parts": 16}


def _whole(spark, sf_dir) -> Tables:
    """A proposal committed whole."""

    def write(folder: str) -> None:
        drafts = store_by(proposals.compiled(_inputs(spark, sf_dir), PREFERENCES), "drafts", "file_id")
        whole = proposals.settled(proposals.grouped(drafts, PREFERENCES.least_group))
        Tables(spark, folder).commit({"drafts": Change(drafts, **KEYED), "operations": Change(whole, **KEYED), "dependencies": Change(proposals.dependencies(drafts), **KEYED)})

    return Tables(spark, kept(spark, f"whole proposal of {sf_dir}", write))


def _revisions(spark, sf_dir) -> Tables:
    """The proposal committed whole, then again from the files that changed; only the parts of operations that changed are written."""
    first = _whole(spark, sf_dir).folder

    def write(_: str) -> None:
        tables = Tables(spark, first)
        facts = adapted(spark, sf_dir, FACTS)
        changed = _inputs(spark, sf_dir, True, CHANGED).join(facts.where(DELETED).select("file_id"), "file_id", "left_anti")
        fresh, operations, affected = proposals.incremental(tables.read("drafts"), tables.read("operations"), changed, facts.where(DELETED).select("file_id"), PREFERENCES)
        touched = affected.unionByName(changed.select("file_id")).unionByName(facts.where(DELETED).select("file_id"))
        parts = tables.parts_of("operations", touched)
        tables.commit({n: Change(rows, **KEYED, touched=parts) for n, rows in (("drafts", fresh), ("operations", operations), ("dependencies", proposals.dependencies(fresh)))}, base=1)

    kept(spark, f"proposal of {sf_dir}", write)
    return Tables(spark, first)


@query(_build_sql(plain(FACTS)))
def organize_build(spark, sf_dir):
    return _shown(_whole(spark, sf_dir).read("operations", 1))


@query(_build_sql(FACTS_AFTER.format(facts=plain(FACTS))))
def organize_incremental(spark, sf_dir):
    return _shown(_revisions(spark, sf_dir).read("operations"))


def _flat(operations):
    return operations.withColumn("destination", F.array_join("destination", "\\"))


BEFORE_SQL, AFTER_SQL = _build_sql(plain(FACTS)), _build_sql(FACTS_AFTER.format(facts=plain(FACTS)))


@query(f"""SELECT count(*) FILTER (a.file_id IS NULL) AS added, count(*) FILTER (b.file_id IS NULL) AS deleted, count(*) FILTER (lower(a.destination || '\\' || a.new_name) <> lower(b.destination || '\\' || b.new_name)) AS changed,
  count(*) FILTER (a.conflict <> 'none' AND b.conflict = 'none') AS resolved, count(*) FILTER (NOT a.needs_review AND b.needs_review) AS to_review FROM ({BEFORE_SQL}) AS a FULL JOIN ({AFTER_SQL}) AS b ON a.file_id = b.file_id""")
def organize_difference(spark, sf_dir):
    tables = _revisions(spark, sf_dir)
    return proposals.difference(tables.read("operations", 1), tables.read("operations"))


@query(f"""WITH p AS ({AFTER_SQL}), q AS (SELECT *, CASE WHEN destination = '' THEN [] ELSE string_split(destination, '\\') END AS d FROM p),
  n AS (SELECT array_to_string(d[1:i], '\\') AS node, i::BIGINT AS depth, count(*) AS files, count(*) FILTER (needs_review) AS reviews, count(*) FILTER (conflict <> 'none') AS conflicts FROM q, unnest(range(0, len(d) + 1)) AS g(i) GROUP BY ALL),
  b AS (SELECT CASE WHEN depth > 1 THEN regexp_replace(node, '\\\\[^\\\\]*$', '') ELSE '' END AS node, count(*) AS folders FROM n WHERE depth > 0 GROUP BY 1), o AS (SELECT destination AS node, count(DISTINCT new_name) AS names FROM p GROUP BY 1)
  SELECT node, depth, files, coalesce(folders, 0) + coalesce(names, 0) AS children, reviews, conflicts FROM n LEFT JOIN b USING (node) LEFT JOIN o USING (node)""")
def organize_tree(spark, sf_dir):
    return proposals.tree(_revisions(spark, sf_dir).read("operations"))


@query(f"""SELECT count(*) AS files, count(*) FILTER (kind = 'move') AS moves, count(*) FILTER (kind IN ('keep_in_place', 'no_action')) AS unchanged, count(*) FILTER (kind = 'to_review') AS unresolved, count(*) FILTER (needs_review) AS needs_review,
  count(*) FILTER (conflict <> 'none') AS conflicts, count(*) FILTER (confidence >= 0.85) AS high, count(*) FILTER (confidence >= 0.65 AND confidence < 0.85) AS medium, count(*) FILTER (confidence < 0.65) AS low FROM ({AFTER_SQL}) AS p""")
def organize_figures(spark, sf_dir):
    figures = proposals.summary(_revisions(spark, sf_dir).read("operations"))
    return figures.select("files", "moves", "unchanged", "unresolved", "needs_review", "conflicts", "high", "medium", "low")
