"""Keyed merges, history, decisions and derived tables that stay in step with their sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.plans.lineage import store
from folio.plans.sizes import small


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: list[str], removed: Column | None = None) -> DataFrame:
    """``current`` with ``changes`` applied: the last row by ``order`` of each key stands, keys whose last row is ``removed`` go.

    Repeated and late changes do no harm, so applying the same changes again changes nothing. Other columns than those of
    ``current`` are left out.
    """
    rows = current.unionByName(changes.select(*current.columns))
    values = [c for c in current.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last")).select(*key, "_last.*")
    return (last if removed is None else last.where(~F.coalesce(removed, F.lit(False)))).select(*current.columns)


def scd2_merge(history: DataFrame, observed: DataFrame, key: list[str], at: str, values: list[str]) -> DataFrame:
    """Type-2 ``history`` ``(key, values, version, valid_from, valid_to)`` after newer observations ``(key, at, values)``.

    An observation that repeats the open row's values leaves it open; another closes it and opens the next version. Observations
    come after the open row; those of one time and key count once, the greatest values first.
    """
    opened = history.where("valid_to is null")
    seeds = opened.select(*key, F.col("valid_from").alias("_at"), F.struct(*values).alias("_v"), F.col("version").alias("_version"))
    fresh = observed.groupBy(*key, F.col(at).alias("_at")).agg(F.max(F.struct(*values)).alias("_v")).withColumn("_version", F.lit(None).cast("long"))
    over = Window.partitionBy(*key).orderBy("_at", F.col("_version").isNull())
    rows = seeds.unionByName(fresh.select(*seeds.columns)).withColumn("_before", F.lag("_v").over(over))
    kept = rows.where(F.col("_version").isNotNull() | ~F.col("_v").eqNullSafe(F.col("_before")))
    base = F.coalesce(F.max("_version").over(Window.partitionBy(*key)), F.lit(0))
    step = F.row_number().over(over) - F.max(F.when(F.col("_version").isNotNull(), 1).otherwise(0)).over(Window.partitionBy(*key))
    done = kept.select(
        *key, *[F.col("_v")[c].alias(c) for c in values], (base + step).cast("long").alias("version"),
        F.col("_at").alias("valid_from"), F.lead("_at").over(over).alias("valid_to"),
    )
    return history.where("valid_to is not null").select(*done.columns).unionByName(done)


def overlay(machine: DataFrame, corrections: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """``machine`` with ``value`` replaced by the last correction of its key, and ``corrected``; corrections without a machine row do nothing."""
    last = corrections.groupBy(*key).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_c"))
    rows = machine.join(last, key, "left")
    mine = F.col("_c").isNotNull()
    return rows.withColumns({value: F.when(mine, F.col(f"_c.{value}")).otherwise(F.col(value)), "corrected": mine}).drop("_c")


def drift(planned: DataFrame, current: DataFrame, key: list[str], stamp: list[str]) -> DataFrame:
    """``(key, reason)`` of planned rows that no longer hold: ``missing``, or the stamps that changed, comma-joined."""
    a = planned.select(*key, F.struct(*stamp).alias("_a"))
    rows = a.join(current.select(*key, F.struct(*stamp).alias("_b")), key, "left")
    changed = F.concat_ws(",", *[F.when(~F.col("_a")[c].eqNullSafe(F.col("_b")[c]), c) for c in stamp])
    reason = F.when(F.col("_b").isNull(), "missing").otherwise(changed)
    return rows.select(*key, reason.alias("reason")).where("reason <> ''")


def replaced_index(index: DataFrame, changed: DataFrame, id_col: str, rebuild) -> DataFrame:
    """``index`` (any rows by ``id_col``) with the rows of changed documents rebuilt: old ones out by id, ``rebuild(changed)`` in."""
    kept = index.join(changed.select(id_col).distinct(), id_col, "left_anti")
    return kept.unionByName(rebuild(changed).select(*index.columns))


def index_differences(index: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that only one of two indexes has, with ``side`` (stale or absent); repeated rows count."""
    columns = index.columns
    signed = index.select(*columns, F.lit(1).alias("_n")).unionByName(expected.select(*columns, F.lit(-1).alias("_n")))
    rows = signed.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return rows.select(*columns, F.when(F.col("_n") > 0, "stale").otherwise("absent").alias("side"))


def document_differences(index: DataFrame, expected: DataFrame, id_col: str, rows: str) -> DataFrame:
    """``index_differences`` of two indexes of one row a document, whose list ``rows`` has what it holds, in order.

    Documents are compared by a digest of their list first; only those that differ are taken apart and compared row by row.
    """
    digest = F.sha2(F.to_json(F.struct(rows)).cast("binary"), 256)
    signed = index.select(id_col, digest.alias("_d"), F.lit(1).alias("_n")).unionByName(expected.select(id_col, digest.alias("_d"), F.lit(-1).alias("_n")))
    odd = small(store(signed.groupBy(id_col, "_d").agg(F.sum("_n").alias("_n")).where("_n <> 0").select(F.col(id_col).alias("_odd")).distinct(), "odd-documents"))
    apart = lambda side: side.join(odd, F.col(id_col).eqNullSafe(F.col("_odd")), "left_semi").select(id_col, F.inline(rows))
    return index_differences(apart(index), apart(expected))


def reuse(wanted: DataFrame, stored: DataFrame, id_col: str, digest: str, value: str) -> DataFrame:
    """``(id_col, digest, value, reused)``: what is stored for equal content; a null ``value`` has to be computed, once a digest."""
    known = stored.groupBy(digest).agg(F.max(value).alias(value))
    rows = wanted.select(id_col, digest).join(known, digest, "left")
    return rows.select(id_col, digest, value, F.col(value).isNotNull().alias("reused"))


def to_process(sources: DataFrame, done: DataFrame, key: list[str], versions: list[str]) -> DataFrame:
    """Source rows without a finished row, or whose finished row has any other version; null versions equal each other."""
    seen = done.select(*key, F.struct(*versions).alias("_done"))
    rows = sources.join(seen, key, "left")
    stale = reduce(lambda a, b: a | b, [~F.col(v).eqNullSafe(F.col("_done")[v]) for v in versions])
    return rows.where(F.col("_done").isNull() | stale).drop("_done")


def neighbourhood(keys: DataFrame, dirty: DataFrame, id_col: str) -> DataFrame:
    """Distinct ``id_col`` that share a dependency key ``(kind, key)`` with a dirty row, the dirty ones included; one hop.

    Keys of the dirty rows are made distinct before they meet all others, so a key that most rows hold costs a row each and no pairs.
    """
    touched = keys.join(dirty.select(id_col).distinct(), id_col, "left_semi").select("kind", "key").distinct()
    near = keys.join(touched, ["kind", "key"], "left_semi").select(id_col)
    return near.unionByName(dirty.select(id_col)).distinct()


def precedence(candidates: DataFrame, id_col: str, ladder: list[str]) -> DataFrame:
    """``(id_col, value, source)`` of the candidate whose ``source`` stands first in ``ladder``, then by ``position`` and ``rule_id``; others are ignored."""
    rank = F.array_position(F.array(*map(F.lit, ladder)), F.col("source"))
    best = F.min(F.struct(rank.alias("_r"), "position", "rule_id", "value", "source")).alias("b")
    rows = candidates.where(F.col("source").isin(*ladder)).groupBy(id_col).agg(best)
    return rows.select(id_col, F.col("b.value").alias("value"), F.col("b.source").alias("source"))


def review_groups(items: DataFrame, group: str, score: str, name: str, conflict: Column) -> DataFrame:
    """``(group, items, top_score, first_name, conflicting)`` of each review group."""
    return items.groupBy(group).agg(
        F.count("*").alias("items"), F.max(score).alias("top_score"), F.min(name).alias("first_name"), F.bool_or(F.coalesce(conflict, F.lit(False))).alias("conflicting"),
    )


def vetoed(pairs: DataFrame, rejections: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` without those that were rejected, whichever side is named first."""
    sides = lambda x, y: [F.least(x, y).alias("_x"), F.greatest(x, y).alias("_y")]
    rejected = rejections.select(*sides(a, b)).distinct()
    rows = pairs.withColumns({"_x": F.least(a, b), "_y": F.greatest(a, b)})
    return rows.join(rejected, ["_x", "_y"], "left_anti").select(*pairs.columns)


def synchronised(stored: DataFrame, wanted: DataFrame, key: list[str], value: str) -> DataFrame:
    """``(key, value, action)``: insert, update, retire or keep, so that ``stored`` becomes ``wanted``."""
    a, b = stored.select(*key, F.struct(value).alias("_a")), wanted.select(*key, F.struct(value).alias("_b"))
    action = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "retire").when(F.col("_a").eqNullSafe(F.col("_b")), "keep").otherwise("update")
    return a.join(b, key, "full").select(*key, F.coalesce("_b", "_a")[value].alias(value), action.alias("action"))
