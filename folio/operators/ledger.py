"""The engine's books: scans, extraction runs, reviews, relationships, proposals, and the figures drawn from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.catalog import exact_duplicates, size_collisions
from folio.operators.detection import excluded, extension_of

# Media types by extension.
MEDIA_TYPES = {
    "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "pdf": "application/pdf", "zip": "application/zip",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "jpg": "image/jpeg", "png": "image/png", "mp4": "video/mp4",
}
TERMINAL = ("success", "partial", "failed", "skipped")
SEVERITIES = ("error", "warning", "info")
MOST_RETRIES = 5


def media_type(filename: Column) -> Column:
    """By the name's ending; unknown ones are ``application/octet-stream``."""
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(table[extension_of(filename)], F.lit("application/octet-stream"))


def scan(files: DataFrame, path: Column, budget: int) -> DataFrame:
    """``(file_id, media_type, digest, outcome)``: every file that a scan of ``budget`` entries observes.

    Hidden, temporary and excluded paths are ``excluded``, files without content ``unreadable``; only files that share their size with another keep
    a digest. The budget is the scan's own limit: entries past it in path order are not there, and ``truncated`` of the last row tells so.
    """
    rows = files.withColumn("_path", path)
    total = rows.count()
    if total > budget:
        rows = rows.orderBy("_path").limit(budget)
    outcome = F.when(excluded(F.col("_path")), "excluded").when(F.col("digest").isNull(), "unreadable").otherwise("observed")
    seen = rows.select("file_id", "byte_size", "digest", media_type(F.col("filename")).alias("media_type"), outcome.alias("outcome"))
    clashes = size_collisions(seen.where("outcome = 'observed'")).select("file_id", F.lit(True).alias("_clash"))
    out = seen.join(clashes, "file_id", "left")
    return out.select("file_id", "media_type", F.when(F.col("_clash"), F.col("digest")).alias("digest"), "outcome", F.lit(total > budget).alias("truncated"))


def scan_paths(paths: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """``(path, file_id, issue)`` of an explicit list of paths, each once; one that is not there is an issue and no failure."""
    asked = paths.select(path).distinct()
    met = asked.join(files.select(path, "file_id"), path, "left")
    return met.select(path, "file_id", F.when(F.col("file_id").isNull(), "missing").alias("issue"))


def duplicate_members(files: DataFrame) -> DataFrame:
    """``(group_id, file_id, position)``: stored duplicate groups with a stable id and members in order of id, from 1."""
    rows = files.select("file_id", "byte_size", "digest").join(exact_duplicates(files).select("byte_size", "digest"), ["byte_size", "digest"])
    order = Window.partitionBy("byte_size", "digest").orderBy("file_id")
    group = F.sha2(F.concat_ws(":", F.col("byte_size").cast("string"), "digest").cast("binary"), 256)
    return rows.select(group.alias("group_id"), "file_id", F.row_number().over(order).cast("long").alias("position"))


def latest_terminal(runs: DataFrame, key: list[str]) -> DataFrame:
    """The last finished run of each key: by its end, else its beginning, then by id."""
    rows = runs.where(F.col("status").isin(*TERMINAL))
    values = [c for c in runs.columns if c not in key]
    last = F.max_by(F.struct(*values), F.struct(F.coalesce("ended_ms", "begun_ms"), "run_id"))
    return rows.groupBy(*key).agg(last.alias("_r")).select(*key, "_r.*")


def status_counts(rows: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """One row: how many rows have each status, and how many there are."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def ocr_words(rows: DataFrame, id_col: str, tsv: str) -> DataFrame:
    """``(id_col, line, words, confidence)`` of recognised lines: word rows (level 5) of a tab-separated table with text and a confidence of 0 or more."""
    lines = rows.select(id_col, F.posexplode(F.split(tsv, "\n")).alias("_at", "_l")).withColumn("_c", F.split("_l", "\t")).where(F.size("_c") >= 12)
    words = lines.select(id_col, "_at", F.get("_c", 4).alias("line"), F.get("_c", 10).try_cast("double").alias("c"), F.btrim(F.get("_c", 11)).alias("w"), F.get("_c", 0).alias("level"))
    words = words.where((F.col("level") == "5") & (F.col("c") >= 0) & (F.col("w") != ""))
    grouped = words.groupBy(id_col, F.col("line").cast("long").alias("line")).agg(F.array_sort(F.collect_list(F.struct("_at", "w"))).alias("_w"), F.avg("c").alias("confidence"))
    return grouped.select(id_col, "line", F.array_join("_w.w", " ").alias("words"), "confidence")


def calibration_error(bins: DataFrame) -> DataFrame:
    """One row ``(ece, brier)`` from ``understanding.calibration``: the mean gap between promised and found shares, weighted by rows, and the mean squared error."""
    gap = F.abs(F.col("mean_probability") - F.col("share_positive")) * F.col("rows")
    return bins.agg((F.sum(gap) / F.sum("rows")).alias("ece"), (F.sum("brier_sum") / F.sum("rows")).alias("brier"))


def synchronised_reviews(items: DataFrame, findings: DataFrame, key: list[str]) -> DataFrame:
    """``(key, status, count)``: open items after new findings.

    A finding opens an item or, unless the item is ignored, opens it again and counts it; an item without one that is open is resolved, for the rescan could read
    what it was about. ``items`` have ``status`` and ``count``.
    """
    a = items.select(*key, F.col("status").alias("_s"), F.col("count").alias("_n"))
    b = findings.groupBy(*key).agg(F.count("*").alias("_new"))
    rows = a.join(b, key, "full")
    again = F.col("_new").isNotNull()
    status = F.when(F.col("_s") == "ignored", "ignored").when(again, "open").when(F.col("_s") == "open", "resolved").otherwise(F.col("_s"))
    return rows.select(*key, status.alias("status"), (F.coalesce("_n", F.lit(0)) + F.coalesce("_new", F.lit(0))).cast("long").alias("count"))


def acted_reviews(items: DataFrame, action: Column) -> DataFrame:
    """``items`` after a user's ``action`` each: ignore, resolve, reopen, or retry, which is refused once ``MOST_RETRIES`` are used; ``retries`` counts them."""
    allowed = (action == "retry") & (F.col("retries") < MOST_RETRIES)
    status = F.when(action == "ignore", "ignored").when(action == "resolve", "resolved").when((action == "reopen") | allowed, "open").otherwise(F.col("status"))
    return items.withColumns({"status": status, "retries": F.when(allowed, F.col("retries") + 1).otherwise(F.col("retries"))})


def review_page(items: DataFrame, reason: str | None, offset: int, limit: int) -> DataFrame:
    """A page of the review queue: by severity, the latest first, then by path; of one ``reason`` if given."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    rows = items if reason is None else items.where(F.col("reason") == reason)
    return rows.orderBy(rank, F.desc("updated_ms"), "path").offset(offset).limit(limit)


def identity_page(groups: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of identity groups: those that need review first, the highest score first."""
    return groups.orderBy(F.desc("needs_review"), F.desc("top_score"), "group_id").offset(offset).limit(limit)


def eligible_relations(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """Relationships that count: those that a user confirmed, and automatic links of confidence ``least`` or more."""
    return rows.where((F.col("status") == "confirmed") | ((F.col("status") == "auto_linked") & (F.col("confidence") >= least)))


def strongest_relations(rows: DataFrame, id_col: str, kind: str, identity: str) -> DataFrame:
    """``(id_col, kind, identity, confidence)``: of each file and kind the relation of greatest confidence, ties by the least identity."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), F.col(identity).alias("i"))).alias("b")
    return rows.groupBy(id_col, kind).agg(best).select(id_col, kind, F.col("b.i").alias(identity), (-F.col("b.c")).alias("confidence"))


def by_priority(rows: DataFrame, id_col: str, field: str, value: str, order: list[str]) -> DataFrame:
    """``(id_col, value)``: the value of the first field in ``order`` that a file has."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(field))
    return rows.where(F.col(field).isin(*order) & F.col(value).isNotNull()).groupBy(id_col).agg(F.min_by(value, F.struct(rank, F.col(value))).alias(value))


def top_partner(rows: DataFrame, group: str, partner: str, status: str = "status", confidence: str = "confidence") -> DataFrame:
    """``(group, partner)``: of the links of a group that are confirmed or automatic, the confirmed ones first, then the most confident, then by name."""
    rank = F.struct((F.col(status) != "confirmed").alias("s"), (-F.col(confidence)).alias("c"), F.col(partner).alias("p"))
    links = rows.where(F.col(partner).isNotNull() & F.col(status).isin("confirmed", "auto_linked"))
    return links.groupBy(group).agg(F.min(rank).alias("b")).select(group, F.col("b.p").alias(partner))


def nearest_rank(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``(group, n, …)``: of each group's sorted values the one at ``round((n - 1) * share)`` for every named share; nulls are left out.

    Values are counted first, so a group holds one row a distinct value in the window that adds the counts up.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    over = Window.partitionBy(group)
    upto = F.sum("_c").over(over.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"_upto": upto, "_n": F.sum("_c").over(over)})
    at = lambda q: F.floor((F.col("_n") - 1) * q + 0.5)
    return ranked.groupBy(group).agg(F.max("_n").alias("n"), *[F.min(F.when(F.col("_upto") > at(q), F.col(value))).alias(name) for name, q in shares.items()])


def gaps(files: DataFrame, id_col: str, done: dict[str, DataFrame]) -> DataFrame:
    """``(id_col, missing)`` of files that lack one of the named stages, comma-joined in the order given."""
    rows = files.select(id_col)
    for name, table in done.items():
        rows = rows.join(table.select(id_col).distinct().withColumn(name, F.lit(True)), id_col, "left")
    missing = F.concat_ws(",", *[F.when(F.col(n).isNull(), n) for n in done])
    return rows.select(id_col, missing.alias("missing")).where("missing <> ''")


def due_jobs(jobs: DataFrame, settings: DataFrame, queue: str, now_ms: int) -> DataFrame:
    """Jobs of enabled queues that may run: due after their queue's quiet time, retries left, and no lease that still holds."""
    rows = jobs.join(F.broadcast(settings), queue)
    ready = F.col("enabled") & (F.col("at_ms") + F.col("quiet_ms") <= now_ms) & (F.col("attempts") < 8) & F.coalesce(F.col("lease_until_ms") <= now_ms, F.lit(True))
    return rows.where(ready).drop("enabled", "quiet_ms")


def optional_filter(rows: DataFrame, text: Column | None = None, holds: str | None = None, since_ms: int | None = None, kinds: list[str] | None = None) -> DataFrame:
    """``rows`` by filters that may each be absent: a text that holds a literal in any letter case, a time, extensions (blank and repeated ones ignored)."""
    tests = []
    if text is not None and holds and holds.strip():
        tests.append(F.contains(F.lower(text), F.lit(holds.strip().lower())))
    if since_ms is not None:
        tests.append(F.col("modified_ms") >= since_ms)
    wanted = sorted({k.strip().lower() for k in kinds or [] if k.strip()})
    if wanted:
        tests.append(F.lower("extension").isin(*wanted))
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


# proposals

TO_REVIEW = "TO_REVIEW"


def compiled(rows: DataFrame) -> DataFrame:
    """Drafts ``(file_id, folder, name, destination, new_name, kind, confidence, needs_review)`` of where files should go.

    ``rows`` have ``file_id, folder, name, context, party, document_type, year, identifier, confidence, needs_review, duplicate, override``. The
    destination is context, party, type and year; unsure files that need review, and those of unknown or mixed context that do, go to ``TO_REVIEW``.
    The new name is date, party, type and identifier with empty parts left out, for confident files only. The kind follows from what changes.
    """
    unsure = F.col("needs_review") & ((F.col("confidence") < 0.65) | F.coalesce(F.col("context").isin("unknown", "mixed"), F.lit(True)))
    target = F.when(unsure, F.lit(TO_REVIEW)).otherwise(F.concat_ws("/", "context", "party", "document_type", "year"))
    ending = F.regexp_extract("name", r"([.][^.]+)$", 1)
    renamed = F.concat(F.concat_ws("_", "year", F.regexp_replace("party", "[^A-Za-z0-9]+", "-"), "document_type", "identifier"), ending)
    name = F.when((F.col("confidence") >= 0.85) & ~unsure, renamed).otherwise(F.col("name"))
    out = rows.withColumns({"destination": target, "new_name": name})
    same_place, same_name = F.lower("folder") == F.lower("destination"), F.lower("name") == F.lower("new_name")
    kind = (
        F.when(F.col("duplicate"), "no_action").when(F.col("override").isin("keep", "reject"), "keep_in_place").when(F.col("destination") == TO_REVIEW, "to_review")
        .when(same_place & same_name, "keep_in_place").when(same_place, "rename").otherwise("move")
    )
    return out.withColumn("kind", kind).select("file_id", "folder", "name", "destination", "new_name", "kind", "confidence", "needs_review")


def proposal_summary(drafts: DataFrame) -> DataFrame:
    """One row: operations by kind, low and high confidence, reviews and folders."""
    kinds = ("move", "rename", "keep_in_place", "to_review", "no_action")
    return drafts.agg(
        F.count("*").alias("operations"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.count_if(F.col("confidence") >= 0.85).alias("confident"),
        F.count_if("needs_review").alias("reviews"), F.count_distinct(F.when(F.col("kind") == "move", F.col("destination"))).alias("folders"),
    )


def proposal_page(drafts: DataFrame, limit: int) -> DataFrame:
    """What a screen shows: the first operations that change something, by destination and id."""
    return drafts.where(F.col("kind").isin("move", "rename", "to_review")).orderBy("destination", "file_id").limit(limit)


def proposal_tree(drafts: DataFrame) -> DataFrame:
    """``(node, files, reviews, conflicts)`` of every destination folder and all above it; a conflict is a name that several files want in one folder."""
    wanted = Window.partitionBy(F.lower("destination"), F.lower("new_name"))
    rows = drafts.where("kind <> 'no_action'").withColumn("_clash", F.count("*").over(wanted) > 1)
    parts = F.split("destination", "/")
    nodes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return rows.select(F.explode(nodes).alias("node"), "needs_review", "_clash").groupBy("node").agg(
        F.count("*").alias("files"), F.count_if("needs_review").alias("reviews"), F.count_if("_clash").alias("conflicts")
    )


def proposal_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: files added, deleted, moved elsewhere than before, renamed, and reviews settled or new between two proposals."""
    a = before.select("file_id", F.col("destination").alias("_d"), F.col("new_name").alias("_n"), F.col("needs_review").alias("_r"))
    b = after.select("file_id", F.col("destination").alias("_d2"), F.col("new_name").alias("_n2"), F.col("needs_review").alias("_r2"))
    rows = a.join(b, "file_id", "full")
    both = F.col("_d").isNotNull() & F.col("_d2").isNotNull()
    return rows.agg(
        F.count_if(F.col("_d").isNull()).alias("added"), F.count_if(F.col("_d2").isNull()).alias("deleted"), F.count_if(both & (F.col("_d") != F.col("_d2"))).alias("moved"),
        F.count_if(both & (F.col("_n") != F.col("_n2"))).alias("renamed"), F.count_if(both & F.col("_r") & ~F.col("_r2")).alias("settled"), F.count_if(both & ~F.col("_r") & F.col("_r2")).alias("reopened"),
    )
