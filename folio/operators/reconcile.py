"""Listings of what is there against the catalog of what was: whole roots, directories that changed, and all roots after a restart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.detection import excluded
from folio.plans.sizes import small

EVENT = ["root", "path_before", "path_after", "kind"]


def ancestors(path: Column) -> Column:
    """The folders above a relative path, the root as an empty string first; a path without folders has the root alone."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>")))


def _allowed(rows: DataFrame, exclusions: DataFrame | None) -> DataFrame:
    """Compared rows without those listed that the defaults or a user's folder exclude; ``exclusions`` are ``(root, folder)``, a null root means all."""
    rows = rows.where(F.col("now").isNull() | ~excluded(F.col("now")))
    if exclusions is None:
        return rows
    ways = F.concat(ancestors(F.lower("now")), F.array(F.lower("now")))
    folders = small(exclusions.select(F.col("root").alias("_r"), F.lower("folder").alias("folder")))
    hits = rows.where("now is not null").select("root", "now", F.explode(ways).alias("folder")).join(folders, "folder")
    hits = hits.where(F.col("_r").isNull() | (F.col("_r") == F.col("root"))).select("root", "now").distinct()
    return rows.join(hits, ["root", "now"], "left_anti")


def _compared(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(root, was, now, kind)`` of paths, whatever their case, that differ between what was and what is listed now."""
    stamp = F.struct("byte_size", "modified_ms")
    a = listing.groupBy("root", F.lower("path").alias("_k")).agg(F.max_by(F.struct("path", stamp.alias("s")), F.struct("modified_ms", "path")).alias("_now"))
    b = catalog.groupBy("root", F.lower("path").alias("_k")).agg(F.max_by(F.struct("path", stamp.alias("s")), F.struct("modified_ms", "path")).alias("_was"))
    rows = a.join(b, ["root", "_k"], "full")
    kind = F.when(F.col("_was").isNull(), "created").when(F.col("_now").isNull(), "removed").when(~F.col("_now.s").eqNullSafe(F.col("_was.s")), "modified")
    return rows.select("root", F.col("_was.path").alias("was"), F.col("_now.path").alias("now"), kind.alias("kind")).where("kind is not null")


def _events(rows: DataFrame) -> DataFrame:
    return rows.select("root", F.when(F.col("kind") == "removed", F.col("was")).alias("path_before"), F.when(F.col("kind") != "removed", F.col("now")).alias("path_after"), "kind")


def root_gaps(listing: DataFrame, catalog: DataFrame, roots: DataFrame, exclusions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(events, states)`` of enabled roots whose whole listing is compared with the catalog.

    ``listing`` and ``catalog`` are ``(root, path, byte_size, modified_ms)``, ``roots`` ``(root, enabled, complete, entry_limit)``: ``complete`` says that
    the listing was neither cut short nor met errors. Paths are equal whatever their case. Excluded paths that are listed give
    no event. Absence is only proven where the listing is complete and the catalog holds fewer than ``entry_limit`` files; other roots
    are ``overflowed`` and give no removals. A root without events is ``reconciled``, others are ``reconciling`` until these are done.
    """
    on = roots.where("enabled").select("root", "complete", "entry_limit")
    counts = catalog.groupBy("root").agg(F.count("*").alias("_n"))
    known = on.join(counts, "root", "left").select("root", (F.col("complete") & (F.coalesce("_n", F.lit(0)) < F.col("entry_limit"))).alias("proven"))
    known = small(known)
    mine = lambda df: df.join(known.select("root"), "root", "left_semi")
    rows = _allowed(_compared(mine(listing), mine(catalog)), exclusions).join(known, "root").where((F.col("kind") != "removed") | F.col("proven"))
    events = _events(rows)
    found = events.groupBy("root").agg(F.count("*").alias("_e"))
    state = F.when(~F.col("proven"), "overflowed").when(F.coalesce("_e", F.lit(0)) == 0, "reconciled").otherwise("reconciling")
    return events, known.join(found, "root", "left").select("root", F.coalesce("_e", F.lit(0)).alias("events"), state.alias("state"))


def _covered(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Distinct ``rows`` whose path is one of the scopes ``(root, folder)`` or lies below one: each path meets its own ancestors, never other folders."""
    ways = F.concat(ancestors(F.col("path")), F.array("path"))
    near = rows.select("*", F.explode(ways).alias("folder")).join(scopes, ["root", "folder"], "left_semi").drop("folder")
    return near.distinct()


def directory_gaps(listing: DataFrame, catalog: DataFrame, changes: DataFrame, exclusions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(events, states)`` of directories that changed: ``changes`` are ``(root, folder_before, folder_after, complete)``.

    Of each change the listing below ``folder_after`` is compared with the catalog below either folder; a change with neither means the
    whole root. Changes may nest and repeat; a path that several cover is compared once. Nothing comes of a change whose listing is not
    ``complete``: its state is ``overflowed``, and its root has to be compared as a whole.
    """
    done = changes.where("complete")
    either = lambda c: F.coalesce(c, F.lit(""))
    whole = F.col("folder_before").isNull() & F.col("folder_after").isNull()
    after = done.where(whole | F.col("folder_after").isNotNull()).select("root", either(F.col("folder_after")).alias("folder")).distinct()
    both = after.unionByName(done.where("folder_before is not null").select("root", F.col("folder_before").alias("folder"))).distinct()
    rows = _allowed(_compared(_covered(listing, after), _covered(catalog, both)), exclusions)
    states = changes.select("root", "folder_before", "folder_after", F.when(F.col("complete"), "reconciling").otherwise("overflowed").alias("state"))
    return _events(rows), states


def startup(listing: DataFrame, catalog: DataFrame, roots: DataFrame, exclusions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(events, states)`` after a restart: every enabled root once, all in one plan; roots that overflowed are ``deferred`` and compared again later, disabled ones are ``skipped``."""
    events, states = root_gaps(listing, catalog, roots, exclusions)
    rows = roots.select("root", "enabled").join(states, "root", "left")
    state = F.when(~F.col("enabled"), "skipped").when(F.col("state") == "overflowed", "deferred").otherwise(F.col("state"))
    return events, rows.select("root", F.coalesce("events", F.lit(0)).alias("events"), state.alias("state"))
