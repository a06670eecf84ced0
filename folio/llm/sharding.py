"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.plans.prefix import running_total


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key by the jump consistent hash of Lamping and Veach (2014).

    A key leaves its shard for the last one with probability 1/n as the n-th shard is appended
    and never moves between older shards. All keys of a batch jump together.
    """
    state = keys.astype(np.int64).view(np.uint64).copy()
    at = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    ahead = np.zeros(len(state), dtype=np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = ahead[live]
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            ahead[live] = ((at[live] + 1).astype(np.float64) * step).astype(np.int64)
            live = live[ahead[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards - 1``, of a long key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf(T.IntegerType())
    def assign(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(dtype=np.int64), shards))

    return assign(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def stable_key(df: DataFrame, key_col: str) -> Column:
    """An integer key as it is, any other through XXH64 of its text."""
    kind = df.schema[key_col].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(key_col).cast("long")
    return F.xxhash64(F.col(key_col).cast("string"))


def assign_shards(df: DataFrame, key_col: str, shards: int, rows_per_bucket: int = 100_000) -> DataFrame:
    """``df`` with ``shard``, ``grown_shard`` (with one more shard) and ``slot``.

    Only the key and the shard count decide the shard, so equal keys share one and a further
    shard takes rows only into itself. Slots count from 0 without gaps in each shard, in the
    order of a hash bucket of the key and then of the key; rows that repeat a key are ordered
    by their remaining columns, maps aside. Buckets grow with the table (one count is read first), so no
    task numbers much more than ``rows_per_bucket`` rows. Columns of these three names that
    ``df`` already has are replaced. A null key goes where 0 goes.
    """
    df = df.drop("shard", "grown_shard", "slot")
    key = stable_key(df, key_col)
    placed = df.withColumn("shard", shard_of(key, shards)).withColumn("grown_shard", shard_of(key, shards + 1))
    buckets = max(1, -(-df.count() // (rows_per_bucket * shards)))
    bucket = F.pmod(F.xxhash64(key_col), F.lit(buckets))
    order = [key_col] + [c for c, k in df.dtypes if c != key_col and "map<" not in k and k != "variant"]
    return running_total(placed, ["shard"], bucket, order, F.lit(1).cast("long"), "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within files; needs ``assign_shards`` first."""
    df.repartition("shard", F.expr("slot div 1000000")).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
