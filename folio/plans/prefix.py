"""Running totals and row numbers over groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.names import free_name


def running_total(
    df: DataFrame, group: list[str], bucket: Column, order: list[str], amount: Column, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over all rows of the same group that come before a row.

    ``bucket`` must be monotone or constant in the order wanted between buckets: rows come by
    bucket, then by ``order``. Each (group, bucket) is one window partition, so a group that
    holds most rows is still dealt over as many tasks as it has buckets; only one number per
    bucket meets in the window that adds the buckets up. Groups may be null. Columns of ``df`` keep their
    names and values, whatever they are called; one called ``name`` is replaced.
    """
    kept = [c for c in df.columns if c != name]
    at, worth, own = (free_name(df.columns, n) for n in ("bucket", "amount", "own"))
    rows = df.withColumns({at: bucket, worth: amount})
    inside = Window.partitionBy(*group, at).orderBy(*order)
    sums = rows.groupBy(*group, at).agg(F.sum(worth).alias("_total"))
    over = Window.partitionBy(*group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    names = [free_name(df.columns, f"group{i}") for i in range(len(group))]
    other, start = free_name(df.columns, "of_bucket"), free_name(df.columns, "start")
    starts = sums.select(
        *[F.col(g).alias(n) for g, n in zip(group, names, strict=True)],
        F.col(at).alias(other),
        F.coalesce(F.sum("_total").over(over), F.lit(0)).alias(start),
    )
    same = F.col(at) == F.col(other)
    for g, n in zip(group, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    before = F.sum(worth).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(worth)
    out = rows.withColumn(own, before).join(starts, same)
    return out.select(*kept, (F.col(own) + F.col(start)).alias(name))
