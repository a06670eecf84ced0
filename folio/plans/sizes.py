"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is.

    Rows are counted first (up to one beyond the limit); beyond it Spark shuffles both sides.
    The rows should be short: the limit times their width is what every executor may hold.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hashed(df: DataFrame) -> DataFrame:
    """``df`` marked as the side of a shuffled join that is hashed, so that the other, wide side is not sorted. Rows should be short and keys unique."""
    return df.hint("shuffle_hash")


def split_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner", heavy: int = 10_000) -> DataFrame:
    """``rows`` joined with ``table``, whose column ``weight`` says how many rows hold each of its keys.

    Keys that more than ``heavy`` rows hold meet in a broadcast join and are never gathered in one task; there is at most one such key for
    every ``heavy`` rows. The others are shuffled. ``how`` is inner or left; keys are not null, ``rows`` should be stored.
    """
    hot = table.where(F.col(weight) > heavy)
    met = rows.join(small(hot), on)
    rest = rows.join(small(hot.select(*on)), on, "left_anti").join(table.where(F.col(weight) <= heavy), on, how)
    return met.unionByName(rest)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` over as many tasks as the session shuffles to: for narrow rows that costly expressions follow.

    A scan has a task for so many bytes, so a compact table is few of them, whatever is computed for a row. The number is given, as adaptive
    execution would join parts by their bytes again. Keys should be ids; one that most rows share is one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
