"""Moves that a watcher reports by halves: paired by the file's own key within a short time, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio.streaming.watch import merged_kind

TTL_MS = 250
HINT = ["root", "native", "path_before", "path_after", "kind", "scope", "at_ms", "seq"]


def bounded(kind: Column, before: Column, after: Column) -> Column:
    """The kind of a change as a root sees it that a move may cross: entering creates, leaving removes; other kinds stay."""
    moved = kind == "moved"
    return F.when(moved & before.isNull() & after.isNotNull(), "created").when(moved & before.isNotNull() & after.isNull(), "removed").otherwise(kind)


def crossing(moves: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root, native, path_before, path_after, kind, scope, at_ms, seq)``: what each root sees of moves with both paths known.

    ``moves`` have absolute ``before`` and ``after``, ``roots`` ``(root, folder)``. A path lies in the roots that are its ancestors, found by an
    equi-join of the folders on its way; paths become relative. A root with one end sees a creation or removal, one with both a move.
    """

    def inside(path: str) -> DataFrame:
        parts = F.split(path, "/")
        ways = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        rows = moves.where(F.size(parts) > 1).select("seq", F.col(path).alias("_p"), F.explode(ways).alias("folder"))
        return rows.join(roots, "folder").select("seq", "root", F.substring(F.col("_p"), F.length("folder") + 2, F.length("_p")).alias(f"path_{path}"))

    seen = inside("before").join(inside("after"), ["seq", "root"], "full")
    rows = seen.join(moves.select("seq", "native", "scope", "at_ms"), "seq")
    kind = bounded(F.lit("moved"), F.col("path_before"), F.col("path_after"))
    return rows.withColumn("kind", kind).select(*HINT)


def _halves(hints: DataFrame) -> Column:
    return (F.col("kind") == "moved") & (F.col("path_before").isNull() != F.col("path_after").isNull())


def merged_scope(a: Column, b: Column) -> Column:
    """Equal scopes stay, an unknown one yields, different ones are unknown."""
    return F.when(a == b, a).when(a == "unknown", b).when(b == "unknown", a).otherwise("unknown")


def paired(hints: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """Hints with halves of moves put together; halves that stay alone become rescans of unknown scope.

    Halves of one root and native key are taken in order of time. A half waits for the next one of its key: if that is the other side and comes
    within ``ttl_ms`` they are one move, else the waiting half is given up and the next one waits. Runs of halves that alternate in time pair
    by their places, so windows decide it without a fold. Halves without a native key wait for nothing. Other hints pass.
    """
    half = _halves(hints)
    alone = F.col("native").isNull()
    rest = hints.where(~F.coalesce(half, F.lit(False)) | alone)
    given_up = half & alone
    rest = rest.withColumns({"kind": F.when(given_up, "rescan").otherwise(F.col("kind")), "scope": F.when(given_up, "unknown").otherwise(F.col("scope"))})
    rows = hints.where(half & ~alone).withColumn("_side", F.col("path_after").isNotNull())
    order = Window.partitionBy("root", "native").orderBy("at_ms", "seq")
    fits = (F.lag("_side").over(order) != F.col("_side")) & (F.col("at_ms") - F.lag("at_ms").over(order) <= ttl_ms)
    rows = rows.withColumn("_new", F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("root", "native", "_run").orderBy("at_ms", "seq"))
    rows = rows.withColumn("_pair", F.floor((place - 1) / 2))
    pair = Window.partitionBy("root", "native", "_run", "_pair").orderBy("at_ms", "seq")
    later = [F.lead(c).over(pair).alias(f"_{c}") for c in ("path_before", "path_after", "scope", "at_ms", "seq")]
    rows = rows.select("*", *later, F.row_number().over(pair).alias("_n")).where("_n = 1")
    both = F.col("_seq").isNotNull()
    made = rows.select(
        "root", "native", F.coalesce("path_before", "_path_before").alias("path_before"), F.coalesce("path_after", "_path_after").alias("path_after"),
        F.when(both, "moved").otherwise("rescan").alias("kind"), F.when(both, merged_scope(F.col("scope"), F.col("_scope"))).otherwise("unknown").alias("scope"),
        F.coalesce("_at_ms", "at_ms").alias("at_ms"), F.coalesce("_seq", "seq").alias("seq"),
    )
    return rest.select(*HINT).unionByName(made)


PAIRED = "root long, native string, path_before string, path_after string, kind string, scope string, at_ms long, seq long"
STATE = "path_before array<string>, path_after array<string>, scope array<string>, at_ms array<long>, seq array<long>"


def paired_stream(hints: DataFrame, ttl_ms: int = TTL_MS, late: str = "1 second") -> DataFrame:
    """The stream of ``paired``, over ``hints`` with their time as timestamp ``ts`` besides ``at_ms``.

    State holds the halves of a key that are still open. A half is settled once the watermark says that nothing older can come, so partners that
    come out of order are still paired; a half whose time has run out fires a timer and leaves as a rescan. A key without open halves has no state.
    """
    half = F.coalesce(_halves(hints), F.lit(False))
    marked = hints.withWatermark("ts", late)
    given_up = half & F.col("native").isNull()
    rest = marked.where(~half | F.col("native").isNull())
    rest = rest.withColumns({"kind": F.when(given_up, "rescan").otherwise(F.col("kind")), "scope": F.when(given_up, "unknown").otherwise(F.col("scope"))}).select(*HINT)

    def settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["path_before", "path_after", "scope", "at_ms", "seq"]
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for frame in frames:
            for row in frame[names].itertuples(index=False):
                before, after, scope, at, seq = row
                held.append((before if isinstance(before, str) else None, after if isinstance(after, str) else None, scope, int(at), int(seq)))
        held.sort(key=lambda h: (h[3], h[4]))
        known = state.getCurrentWatermarkMs()  # older hints are dropped before they come here
        out = []
        while held:
            first = held[0]
            second = held[1] if len(held) > 1 and held[1][3] - first[3] <= ttl_ms else None
            if second and second[3] < known and (first[1] is None) != (second[1] is None):
                scope = first[2] if first[2] == second[2] else second[2] if first[2] == "unknown" else first[2] if second[2] == "unknown" else "unknown"
                out.append((*key, first[0] or second[0], first[1] or second[1], "moved", scope, second[3], second[4]))
                held = held[2:]
            elif first[3] + ttl_ms < known or (second and second[3] < known):
                out.append((*key, first[0], first[1], "rescan", "unknown", first[3], first[4]))
                held = held[1:]
            else:
                break
        if held:
            state.update(tuple(list(c) for c in zip(*held, strict=True)))
            state.setTimeoutTimestamp(max(held[0][3] + ttl_ms + 1, known + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=HINT)

    open_halves = marked.where(half & F.col("native").isNotNull()).groupBy("root", "native")
    made = open_halves.applyInPandasWithState(settle, PAIRED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return rest.unionByName(made)


def coalesced_hints(hints: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """``(root, native, path_before, path_after, hints, kind, scope)``: one change for each file and pair of paths of a poll, moves paired first.

    A rescan without a path stands for its whole root: hints of that root before it are dropped, and those after it too.
    """
    rows = paired(hints, ttl_ms)
    whole = (F.col("kind") == "rescan") & F.col("path_before").isNull() & F.col("path_after").isNull()
    roots = rows.where(whole).select("root").distinct().withColumn("_whole", F.lit(True))
    rows = rows.join(roots, "root", "left").where(whole | F.col("_whole").isNull())
    key = ["root", "native", "path_before", "path_after"]
    listed = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at_ms", "seq", "kind", "scope"))).alias("e"))
    rest = F.slice("e", 2, F.size("e"))
    kind = F.aggregate(rest, F.get("e", F.lit(0))["kind"], lambda a, e: merged_kind(a, e["kind"]))
    scope = F.aggregate(rest, F.get("e", F.lit(0))["scope"], lambda a, e: merged_scope(a, e["scope"]))
    return listed.select(*key, F.size("e").cast("long").alias("hints"), kind.alias("kind"), scope.alias("scope"))
