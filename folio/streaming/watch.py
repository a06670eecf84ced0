"""Change events: sequences, debounced sessions, stability and coalescing, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.maintenance import upsert


def numbered(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``events`` with ``number``, from 0 within each key."""
    return events.withColumn("number", (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("long"))


def debounced(events: DataFrame, key: list[str], at: str, seq: str, quiet_ms: int) -> DataFrame:
    """``(key, started, ready, hints, kind)``: runs of events with gaps under ``quiet_ms``; the last event's kind wins.

    A late event after a quiet gap opens a new run and never reopens an old one.
    """
    order = Window.partitionBy(*key).orderBy(at, seq)
    gap = F.coalesce(F.col(at) - F.lag(at).over(order) >= quiet_ms, F.lit(True)).cast("int")
    runs = events.withColumn("_new", gap).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*key, "_run").agg(
        F.min(at).alias("started"), (F.max(at) + quiet_ms).alias("ready"), F.count("*").alias("hints"),
        F.max_by("kind", F.struct(at, seq)).alias("kind"),
    )
    return out.drop("_run")


def debounced_stream(events: DataFrame, key: list[str], ts: str, seq: str, quiet: str, late: str) -> DataFrame:
    """The streaming twin of ``debounced`` over a timestamp column: session windows, closed once the watermark passes."""
    sessions = F.session_window(ts, quiet)
    return events.withWatermark(ts, late).groupBy(*key, sessions.alias("w")).agg(
        F.count("*").alias("hints"), F.max_by("kind", F.struct(ts, seq)).alias("kind")
    ).select(*key, F.col("w.start").alias("started"), F.col("w.end").alias("ready"), "hints", "kind")


def merged_kind(old: Column, new: Column) -> Column:
    """What two successive changes of one path amount to."""
    either = lambda kind: (old == kind) | (new == kind)
    fresh = F.array_contains(F.array(F.lit("created"), F.lit("modified")), old) & F.array_contains(F.array(F.lit("created"), F.lit("modified")), new)
    return (
        F.when(either("rescan"), "rescan").when(either("overflow"), "overflow").when(old == new, old).when(old == "metadata", new).when(new == "metadata", old)
        .when(fresh, "created").when(new == "removed", "removed").when((old == "removed") & (new == "created"), "modified").otherwise(new)
    )


def coalesced(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``(key, hints, kind)``: one change per key, its events merged in order. For the events of one poll, so keys hold few."""
    listed = events.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, "kind"))).alias("e"))
    kinds = F.transform("e", lambda e: e["kind"])
    folded = F.aggregate(F.slice(kinds, 2, F.size(kinds)), F.get(kinds, 0), merged_kind)
    return listed.select(*key, F.size("e").cast("long").alias("hints"), folded.alias("kind"))


def coalesced_stream(events: DataFrame, key: list[str], ts: str, seq: str, quiet: str, late: str) -> DataFrame:
    """The streaming form of ``coalesced``: the events of a path up to a quiet gap are one poll, emitted once the watermark passes.

    State holds a path's open run alone; Spark keeps and expires it.
    """
    runs = events.withWatermark(ts, late).groupBy(*key, F.session_window(ts, quiet).alias("w"))
    listed = runs.agg(F.array_sort(F.collect_list(F.struct(ts, seq, "kind"))).alias("e"))
    kinds = F.transform("e", lambda e: e["kind"])
    folded = F.aggregate(F.slice(kinds, 2, F.size(kinds)), F.get(kinds, 0), merged_kind)
    return listed.select(*key, F.col("w.start").alias("started"), F.size("e").cast("long").alias("hints"), folded.alias("kind"))


def maintained(events: DataFrame, key: list[str], order: list[str], folder: str, checkpoint: str):
    """Keep the last event of each of a stream's keys as parquet below ``folder``; returns the started query, which stops once it caught up.

    Batch ``n`` reads the state of the last batch before it and writes ``state=n``, so a batch that is run again after a failure
    writes the same rows over its own. Removals stay as their key's last event, so an older event that comes late cannot
    bring the key back.
    """

    def merge(batch: DataFrame, number: int) -> None:
        known = batch.sparkSession
        before = known.read.schema(batch.schema).parquet(f"{folder}/state={number - 1}") if number else batch.limit(0)
        upsert(before, batch, key, order).write.mode("overwrite").parquet(f"{folder}/state={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stable(samples: DataFrame, key: list[str], at: str, seq: str, value: str, apart_ms: int) -> DataFrame:
    """Samples that repeat the value of the sample before them at least ``apart_ms`` later."""
    order = Window.partitionBy(*key).orderBy(at, seq)
    rows = samples.withColumns({"_v": F.lag(value).over(order), "_t": F.lag(at).over(order)})
    return rows.where((F.col("_v") == F.col(value)) & (F.col(at) - F.col("_t") >= apart_ms)).drop("_v", "_t")


def retry_at(failed_ms: Column, attempt: Column, most: int = 8) -> Column:
    """When a failed job is due again: a second doubled up to six times; null once ``most`` attempts are used."""
    return F.when(attempt < most, failed_ms + (1000 * F.pow(F.lit(2.0), F.least(attempt, F.lit(6)))).cast("long"))


def due(jobs: DataFrame, queue: str, due_ms: Column, order: list[str], now_ms: int | None, most: int) -> DataFrame:
    """The first ``most`` jobs of each queue that are due by ``now_ms``; a page of work, the rest stays for the next."""
    ready = jobs.where(due_ms <= F.lit(now_ms).cast("long"))
    over = Window.partitionBy(queue).orderBy(*order)
    return ready.withColumn("_n", F.row_number().over(over)).where(F.col("_n") <= most).drop("_n")
