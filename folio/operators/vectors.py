"""Exact nearest neighbours of many query vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.ranking import rank_within
from folio.plans.lineage import store

BLOCK_ROWS, CHUNK = 20_000, 500


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` greatest scores, equal ones by id."""
    held = np.arange(len(ids))
    if len(ids) > k:
        held = np.flatnonzero(scores >= np.partition(scores, len(ids) - k)[len(ids) - k])
    return held[np.lexsort((ids[held], -scores[held]))[:k]]


def _scan(shared: Broadcast, k: int):
    """Task code over the broadcast ids and vectors of a block: the best ``k`` rows a partition has for each query; memory is a batch by ``CHUNK`` scores and ``k`` rows a query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked_ids, asked = shared.value
        ids = [np.empty(0, np.int64)] * len(asked_ids)
        scores = [np.empty(0)] * len(asked_ids)
        for batch in batches:
            mine, vectors = batch["id"].to_numpy(), np.array(batch["v"].tolist(), dtype=float).reshape(len(batch), -1)
            if not len(mine):
                continue
            for start in range(0, len(asked_ids), CHUNK):
                found = np.round(asked[start : start + CHUNK] @ vectors.T, 6)
                for i, row in enumerate(found, start):
                    top = _best(mine, row, k)
                    all_ids, all_scores = np.concatenate([ids[i], mine[top]]), np.concatenate([scores[i], row[top]])
                    keep = _best(all_ids, all_scores, k)
                    ids[i], scores[i] = all_ids[keep], all_scores[keep]
        yield pd.DataFrame({"query_id": np.repeat(asked_ids, [len(x) for x in ids]), "id": np.concatenate(ids), "score": np.concatenate(scores)})

    return run


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, id_col, score, rank)``: for every row of ``queries`` the ``k`` rows of greatest inner product, ties by id.

    Exact, without a join: queries are stored and taken in blocks of about ``block_rows``. A block is broadcast as arrays, scanned against all ``rows``, its
    best ``k`` a query and task are stored, and it is dropped everywhere before the next one is read, so the driver holds one block at a time. Null
    ids and vectors, and vectors that differ from the query's length, take no part.
    """
    held = lambda df: df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    asked, parts = store(held(queries).withColumn("n", F.size("v")), "queries"), []
    context = rows.sparkSession.sparkContext
    for n, count in sorted(tuple(r) for r in asked.groupBy("n").count().collect()):
        blocks = max(1, -(-count // block_rows))
        same = held(rows).where(F.size("v") == n)
        for b in range(blocks):
            block = asked.where((F.col("n") == n) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).select("id", "v").toPandas()
            if not len(block):
                continue
            shared = context.broadcast((block["id"].to_numpy(np.int64), np.array(block["v"].tolist(), dtype=float).reshape(len(block), n)))
            parts.append(store(same.mapInPandas(_scan(shared, k), "query_id long, id long, score double"), "nearest"))
            shared.destroy()
            del block, shared
    if not parts:
        return rows.limit(0).select(F.lit(0).cast("long").alias("query_id"), F.col(id_col).cast("long").alias(id_col), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank"))
    found = reduce(DataFrame.unionByName, parts).withColumnRenamed("id", id_col)
    return rank_within(found, "query_id", [F.desc("score"), F.col(id_col)], k)
