"""What a scan, an extraction run and an analysis leave behind: all their tables in one commit, only touched parts rewritten."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.maintenance import scd2_merge, upsert
from folio.plans.lineage import store
from folio.sources.commits import Change, Tables

PARTS = 16
VERSION = ["path", "byte_size", "digest"]
VERSIONS = "file string, path string, byte_size long, digest string, version long, valid_from long, valid_to long"
STATUSES = "scan long, file string, readable boolean, error string"
LISTED = "file string, path string, extension string, byte_size long, at long, text string, document_type string, context string, status string"
REVIEWS = "file string, stage string, reason string, status string, hits long"
HOLDERS = "digest string, file string, path string"
DUPLICATES = "digest string, files long, canonical string"
METRICS = "scan long, files long, bytes long, errors long, issues long, duplicate_groups long"
RESULTS = "file string, batch long, at long, status string, text string, error string"
ANALYSES = "file string, analysis long, at long, document_type string, context string, confidence double, status string, is_current boolean"
FIELDS = "file string, analysis long, field string, value string, confidence double"
# What a failure asks of the user; cancelled runs ask nothing.
REVIEW_OF_ERROR = {"unreadable": "unreadable", "encrypted": "password_needed", "type_mismatch": "type_mismatch", "too_large": "too_large", "timeout": "retry_later"}


def _touched(tables: Tables, name: str, schema: str, rows: DataFrame) -> tuple[tuple[int, ...] | None, DataFrame]:
    """The parts of a table that hold the keys of ``rows``, and their present rows; no parts and no rows if it is new."""
    if name not in tables.manifest()["tables"]:
        return None, tables.spark.createDataFrame([], schema)
    parts = tables.parts_of(name, rows)
    return parts, tables.read(name, parts=parts)


def _listed(before: DataFrame, changed: DataFrame, order: Column, columns: list[str]) -> DataFrame:
    """Search rows after ``columns`` of some files changed, each by its last change; files not listed yet come in with these columns alone."""
    last = changed.groupBy("file").agg(F.max_by(F.struct(*columns), order).alias("_new"))
    rows = before.join(last, "file", "full")
    new = F.col("_new").isNotNull()
    return rows.select("file", *[F.when(new, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in before.columns if c != "file"])


def reviewed(before: DataFrame, found: DataFrame, seen: DataFrame, stage: str) -> DataFrame:
    """Review items of a stage after it looked at the files ``seen`` and found reasons ``(file, reason)``.

    A recurring reason reopens its item unless the user ignores it, and counts a hit; open items of a seen file whose reason is gone are
    resolved. Items of other stages and files stay.
    """
    mine = before.where(F.col("stage") == stage)
    hits = found.groupBy("file", "reason").agg(F.count("*").alias("_n"))
    looked = seen.select("file").distinct().withColumn("_seen", F.lit(True))
    rows = mine.join(hits, ["file", "reason"], "full").join(looked, "file", "left")
    gone = F.col("_n").isNull() & F.coalesce("_seen", F.lit(False)) & (F.col("status") == "open")
    status = F.when(F.col("status") == "ignored", "ignored").when(F.col("_n").isNotNull(), "open").when(gone, "resolved").otherwise(F.col("status"))
    after = rows.select("file", F.lit(stage).alias("stage"), "reason", status.alias("status"), (F.coalesce("hits", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("hits"))
    return before.where(F.col("stage") != stage).unionByName(after)


def commit_scan(
    tables: Tables, scan: int, observed: DataFrame, issues: DataFrame, parts: int = PARTS, base: int | None = None,
    before_manifest: Callable[[str], None] | None = None,
) -> int:
    """Commit a scan: ``observed`` ``(file, path, byte_size, digest, at, readable, error)`` and ``issues`` ``(path, code)``; returns the version.

    Versions of files, the scan's statuses and figures, search rows, review items, holders of each content and groups of equal contents
    become visible together. Files not observed stay as they are. Rewritten are the parts that hold observed files, and those of
    contents that some observed file has or had.
    """
    observed = store(observed, "observed")
    extension = F.lower(F.regexp_extract("path", r"[.]([^./\\]+)$", 1))
    touched, versions = _touched(tables, "versions", VERSIONS, observed)
    versions = store(versions, "versions-before")
    after = scd2_merge(versions, observed, ["file"], "at", VERSION)
    in_list, listed = _touched(tables, "listed", LISTED, observed)
    rows = observed.withColumn("extension", extension)
    listed = _listed(listed, rows, F.col("at"), ["path", "extension", "byte_size", "at"])
    in_reviews, reviews = _touched(tables, "reviews", REVIEWS, observed)
    last = store(observed.groupBy("file").agg(F.max_by(F.struct("path", "byte_size", "digest", "readable", "error"), "at").alias("l")).select("file", "l.*"), "observed-last")
    found = last.where(~F.col("readable")).select("file", F.coalesce("error", F.lit("unreadable")).alias("reason"))
    reviews = reviewed(reviews, found, last, "scan")

    old = versions.where("valid_to is null").join(last.select("file"), "file", "left_semi").select("digest")
    contents = old.unionByName(last.select("digest")).where("digest is not null").distinct()
    of_content, holders = _touched(tables, "holders", HOLDERS, contents)
    holders = holders.join(last.select("file"), "file", "left_anti").unionByName(last.where("digest is not null and readable").select("digest", "file", "path"))
    holders = store(holders, "holders")
    groups = holders.groupBy("digest").agg(F.count("*").alias("files"), F.min("path").alias("canonical")).where("files > 1")
    zero = F.lit(0).cast("long")
    counted = (
        last.select(F.lit(1).alias("files"), F.col("byte_size").alias("bytes"), (~F.col("readable")).cast("int").alias("errors"), zero.alias("issues"), zero.alias("duplicate_groups"))
        .unionByName(issues.select(zero.alias("files"), zero.alias("bytes"), zero.alias("errors"), F.lit(1).alias("issues"), zero.alias("duplicate_groups")))
        .unionByName(groups.select(zero.alias("files"), zero.alias("bytes"), zero.alias("errors"), zero.alias("issues"), F.lit(1).alias("duplicate_groups")))
    )
    figures = counted.agg(F.lit(scan).cast("long").alias("scan"), *[F.coalesce(F.sum(c), zero).cast("long").alias(c) for c in counted.columns])
    in_groups, _ = _touched(tables, "duplicates", DUPLICATES, contents)
    by_file = lambda rows, at: Change(rows, ("file",), parts, at)
    by_content = lambda rows, at: Change(rows, ("digest",), parts, at)
    changes = {
        "versions": by_file(after, touched), "statuses": Change(last.select(F.lit(scan).cast("long").alias("scan"), "file", "readable", "error"), ("file",), parts, append=True),
        "listed": by_file(listed, in_list), "reviews": by_file(reviews, in_reviews), "holders": by_content(holders, of_content), "duplicates": by_content(groups, in_groups),
        "issues": Change(issues.select(F.lit(scan).cast("long").alias("scan"), "path", "code"), append=True), "metrics": Change(figures, append=True),
    }
    return tables.commit(changes, base, before_manifest)


def commit_extractions(tables: Tables, results: DataFrame, parts: int = PARTS, base: int | None = None) -> int:
    """Commit extraction results ``(file, batch, at, status, text, error)``: a file's last one stands, its search row takes the text, its review items follow."""
    results = store(results, "results")
    touched, before = _touched(tables, "results", RESULTS, results)
    after = store(upsert(before, results, ["file"], ["at", "batch"]), "results-after")
    current = after.join(results.select("file").distinct(), "file", "left_semi")
    in_list, listed = _touched(tables, "listed", LISTED, results)
    shown = current.withColumn("text", F.when(F.col("status").isin("success", "partial"), F.col("text")))
    listed = _listed(listed, shown, F.col("at"), ["text"])
    in_reviews, reviews = _touched(tables, "reviews", REVIEWS, results)
    names = F.create_map(*[F.lit(x) for pair in REVIEW_OF_ERROR.items() for x in pair])
    found = current.where(F.col("status").isin("failed", "unsupported") & F.col("error").isNotNull()).select("file", names[F.col("error")].alias("reason")).where("reason is not null")
    reviews = reviewed(reviews, found, current, "extraction")
    changes = {n: Change(rows, ("file",), parts, at) for n, rows, at in (("results", after, touched), ("listed", listed, in_list), ("reviews", reviews, in_reviews))}
    return tables.commit(changes, base)


def commit_analyses(tables: Tables, analyses: DataFrame, fields: DataFrame, parts: int = PARTS, base: int | None = None) -> int:
    """Commit analyses ``(file, analysis, at, document_type, context, confidence, status)`` and their long ``fields`` ``(file, analysis, field, value, confidence)``.

    The last analysis of a file is current, all earlier ones stay as superseded. Fields come to those there are. The search row takes
    the type, context and status; analyses that are unknown, or of confidence below .65, ask for review.
    """
    analyses = store(analyses, "analyses")
    touched, before = _touched(tables, "analyses", ANALYSES, analyses)
    rows = before.drop("is_current").unionByName(analyses)
    newest = rows.groupBy("file").agg(F.max(F.struct("at", "analysis")).alias("_top"))
    after = rows.join(newest, "file").withColumn("is_current", F.struct("at", "analysis") == F.col("_top")).drop("_top").select(*before.columns)
    after = store(after, "analyses-after")
    current = after.where("is_current").join(analyses.select("file").distinct(), "file", "left_semi")
    in_list, listed = _touched(tables, "listed", LISTED, analyses)
    listed = _listed(listed, current, F.col("at"), ["document_type", "context", "status"])
    in_reviews, reviews = _touched(tables, "reviews", REVIEWS, analyses)
    reason = F.when(F.col("status") == "unknown", "unknown_type").when(F.coalesce(F.col("confidence") < 0.65, F.lit(True)), "low_confidence")
    found = current.select("file", reason.alias("reason")).where("reason is not null")
    reviews = reviewed(reviews, found, current, "analysis")
    changes = {n: Change(rows, ("file",), parts, at) for n, rows, at in (("analyses", after, touched), ("listed", listed, in_list), ("reviews", reviews, in_reviews))}
    changes["fields"] = Change(fields.select("file", "analysis", "field", "value", "confidence"), ("file",), parts, append=True)
    return tables.commit(changes, base)
