"""Structured filters and relevance over the facts of files, result pages, and retrieval metrics.

Facts are long, a row each, and meet in aggregates that combine map-side; a file with millions of facts is no list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the hybrid score.
LEXICAL, AMOUNT, DATE, PARTY, VECTOR = 0.34, 0.18, 0.12, 0.24, 0.10
CONFIRMED_BONUS, MISMATCH_PENALTY, VECTOR_FLOOR, MIN_SCORE, RULE_BOOST = 0.08, 0.80, 0.18, 0.035, 0.25


def amount_similarity(amount: Column, least: int | None, most: int | None, target: int | None) -> Column:
    """1 inside the range, falling off with the distance to ``target`` if there is one; 0 outside or without an amount."""
    inside = F.lit(True)
    if least is not None:
        inside = inside & (amount >= least)
    if most is not None:
        inside = inside & (amount <= most)
    near = F.lit(1.0) if target is None else F.greatest(F.lit(0.0), 1 - F.abs(amount - target) / float(max(abs(target), 10_000)))
    return F.when(amount.isNotNull() & inside, near).otherwise(0.0)


def names_match(name: Column, wanted: str) -> Column:
    """Equal, or one within the other, letter case and outer spaces aside; an empty or missing name matches nothing."""
    low, want = F.lower(F.trim(name)), wanted.strip().lower()
    return F.coalesce((low != "") & (F.contains(low, F.lit(want)) | F.contains(F.lit(want), low)), F.lit(False)) & F.lit(bool(want))


def fact_scores(facts: DataFrame, id_col: str, intents: dict[str, Column], confirmed: Column) -> DataFrame:
    """``(id_col, <intent>..., <intent>_mismatch...)``: the best score of each intent over a file's facts.

    ``intents`` name a score per fact, above zero where it matches and null where the row is no fact of that kind. Once a
    file has confirmed facts of a kind only these count; if none of them matches that is a mismatch.
    """
    sure = F.coalesce(confirmed, F.lit(False))
    aggregates = []
    for name, score in intents.items():
        aggregates += [F.max(score).alias(f"_any_{name}"), F.max(F.when(sure, score)).alias(f"_sure_{name}")]
    rows = facts.groupBy(id_col).agg(*aggregates)
    best = lambda n: F.coalesce(F.col(f"_sure_{n}"), F.col(f"_any_{n}"), F.lit(0.0)).alias(n)
    wrong = lambda n: (F.coalesce(F.col(f"_sure_{n}"), F.lit(1.0)) <= 0).alias(f"{n}_mismatch")
    return rows.select(id_col, *[best(n) for n in intents], *[wrong(n) for n in intents])


def matching_files(scores: DataFrame, id_col: str, intents: list[str]) -> DataFrame:
    """``id_col`` of files where every intent matches; a missing fact fails its filter."""
    return scores.where(reduce(lambda a, b: a & b, [F.col(n) > 0 for n in intents])).select(id_col)


def hybrid_score(scores: DataFrame, id_col: str, weights: dict[str, float], extra: Column | None = None) -> DataFrame:
    """``(id_col, score)`` of files that match something: weighted intents, less the penalty once for any confirmed mismatch.

    ``extra`` is added before the penalty (lexical or vector parts, rule boosts). Scores under the least are left out; one is the most.
    """
    total = reduce(lambda a, b: a + b, [F.lit(w) * F.col(n) for n, w in weights.items()])
    found = reduce(lambda a, b: a | b, [F.col(n) > 0 for n in weights])
    if extra is not None:
        total, found = total + F.coalesce(extra, F.lit(0.0)), found | (F.coalesce(extra, F.lit(0.0)) > 0)
    wrong = reduce(lambda a, b: a | b, [F.col(f"{n}_mismatch") for n in weights])
    total = total - F.when(wrong, MISMATCH_PENALTY).otherwise(0.0)
    rows = scores.where(found).select(id_col, total.alias("score"))
    return rows.where(F.col("score") >= MIN_SCORE).withColumn("score", F.least("score", F.lit(1.0)))


def vector_part(similarity: Column) -> Column:
    """What a vector's similarity adds to the score: nothing below the floor."""
    return F.when(similarity >= VECTOR_FLOOR, VECTOR * (similarity - VECTOR_FLOOR) / (1 - VECTOR_FLOOR)).otherwise(0.0)


def lexical_part(bm25: Column) -> Column:
    """A BM25 score (higher is better) squashed to between one half and one, weighted."""
    return LEXICAL / (1 + F.exp(-bm25))


def match_source(fields: dict[str, Column], term: str) -> Column:
    """The first field, in the order given, that holds ``term`` in any letter case; null if none does."""
    out = F
    for name, field in fields.items():
        out = out.when(F.contains(F.lower(field), F.lit(term.lower())), name)
    return out


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of ``rows`` with ``total`` and ``has_more``; only a page's rows and one count meet in a task."""
    total = rows.count()
    found = rows.orderBy(*order).offset(offset).limit(limit)
    return found.withColumns({"total": F.lit(total).cast("long"), "has_more": F.lit(offset + limit < total)})


def rank_within(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The top ``k`` of each group with ``rank`` from 1; Spark keeps ``k`` a task before the shuffle."""
    over = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(over).cast("long")).where(F.col("rank") <= k)


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, query: str, id_col: str, k: int) -> DataFrame:
    """``(query, relevant, hit, reciprocal_rank, ndcg)`` of each query that has relevant rows, from ranks 1 to ``k``."""
    wanted = relevant.select(query, id_col).distinct()
    sizes = wanted.groupBy(query).agg(F.count("*").alias("relevant"))
    hits = ranked.where(F.col("rank") <= k).join(wanted, [query, id_col]).groupBy(query).agg(
        F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("gain")
    )
    steps = F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int"))
    ideal = F.aggregate(steps, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = sizes.join(hits, query, "left")
    return rows.select(
        query, "relevant", F.col("first").isNotNull().cast("long").alias("hit"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("gain") / ideal, F.lit(0.0)).alias("ndcg"),
    )
