"""Hybrid search: candidates of several signals, their relevance from evidence, and what explains it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.ranking import AMOUNT, CONFIRMED_BONUS, DATE, LEXICAL, MIN_SCORE, MISMATCH_PENALTY, PARTY, RULE_BOOST, VECTOR, VECTOR_FLOOR

# Weights of type and context, the least confidence that a named party counts with, bounds on candidates.
TYPE, CONTEXT = 0.20, 0.08
PARTY_LEAST, GENERIC_LEAST = 0.70, 0.65
PER_SIGNAL, KEPT, VECTOR_FILES, VECTOR_LEAST, STRUCTURED_ONLY = 2_500, 20_000, 2_000, 0.10, 0.5


def vector_seeds(similarities: DataFrame, id_col: str) -> DataFrame:
    """The best similarity of each file at ``VECTOR_LEAST`` or more, the first ``VECTOR_FILES`` files; a report of top files, as the feature has it."""
    best = similarities.groupBy(id_col).agg(F.max("score").alias("score")).where(F.col("score") >= VECTOR_LEAST)
    return best.orderBy(F.desc("score"), id_col).limit(VECTOR_FILES)


def candidates(lexical: DataFrame, structured: DataFrame, vector: DataFrame, id_col: str, browse: DataFrame | None = None) -> DataFrame:
    """``(id_col, lexical, vector, structured, priority)``: the union of the signals' files, each once.

    Lexical rows carry ``score`` (0 to 1), structured ones their id only. Each signal gives at most ``PER_SIGNAL`` files by id (lexical ones by score),
    the union keeps the ``KEPT`` of highest priority: lexical plus vector, or a fixed value for files that only facts found. Without any, ``browse`` stands in.
    """
    none = F.lit(None).cast("double")
    lex = lexical.orderBy(F.desc("score"), id_col).limit(PER_SIGNAL).select(id_col, F.col("score").alias("lexical"), none.alias("vector"), F.lit(False).alias("structured"))
    facts = structured.select(id_col).distinct().orderBy(id_col).limit(PER_SIGNAL).select(id_col, none.alias("lexical"), none.alias("vector"), F.lit(True).alias("structured"))
    near = vector.select(id_col, none.alias("lexical"), F.col("score").alias("vector"), F.lit(False).alias("structured"))
    seeds = lex.unionByName(facts).unionByName(near)
    if browse is not None and seeds.isEmpty():
        seeds = browse.select(id_col, none.alias("lexical"), none.alias("vector"), F.lit(False).alias("structured"))
    rows = seeds.groupBy(id_col).agg(F.max("lexical").alias("lexical"), F.max("vector").alias("vector"), F.bool_or("structured").alias("structured"))
    own = F.coalesce("lexical", F.lit(0.0)) + F.coalesce("vector", F.lit(0.0))
    rows = rows.withColumn("priority", F.when((own == 0) & F.col("structured"), STRUCTURED_ONLY).otherwise(own))
    return rows.orderBy(F.desc("priority"), id_col).limit(KEPT)


def evidence_scores(evidence: DataFrame, id_col: str, intents: dict[str, Column], confirmed: Column) -> DataFrame:
    """``(id_col, <intent>, <intent>_sure, <intent>_mismatch ...)``: the best score of each intent, whether a confirmed row gives it, and whether confirmed rows deny it.

    ``intents`` score a row of evidence: null where it is of another kind, 0 where it does not match. Confirmed rows of a kind shadow all others.
    """
    sure = F.coalesce(confirmed, F.lit(False))
    rows = evidence.groupBy(id_col).agg(*[F.max(s).alias(f"_any_{n}") for n, s in intents.items()], *[F.max(F.when(sure, s)).alias(f"_own_{n}") for n, s in intents.items()])
    out = []
    for n in intents:
        out += [
            F.coalesce(f"_own_{n}", f"_any_{n}", F.lit(0.0)).alias(n), (F.coalesce(f"_own_{n}", F.lit(0.0)) > 0).alias(f"{n}_sure"),
            (F.coalesce(f"_own_{n}", F.lit(1.0)) <= 0).alias(f"{n}_mismatch"),
        ]
    return rows.select(id_col, *out)


WEIGHTS = {"document_type": TYPE, "context": CONTEXT, "supplier": PARTY, "customer": PARTY, "project": PARTY, "party": PARTY, "amount": AMOUNT, "date": DATE}


def relevance(cands: DataFrame, scores: DataFrame, id_col: str, intents: list[str], boost: Column | None = None) -> DataFrame:
    """``(id_col, relevance, explanation)`` of candidates that match something well enough.

    The lexical score, the vector's part above its floor and every intent's score count with their weights, confirmed intents a bonus more; a rule's
    ``boost`` counts once anything matched; a confirmed mismatch costs its penalty once, after the boost. Parties count with a least confidence.
    """
    rows = cands.join(scores, id_col, "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    value = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    least = {"supplier": PARTY_LEAST, "customer": PARTY_LEAST, "project": PARTY_LEAST, "party": GENERIC_LEAST}
    parts = {
        "lexical": F.least(value("lexical"), F.lit(1.0)) * LEXICAL,
        "vector": F.when(value("vector") >= VECTOR_FLOOR, F.least((value("vector") - VECTOR_FLOOR) / (1 - VECTOR_FLOOR), F.lit(1.0)) * VECTOR).otherwise(0.0),
    }
    for n in intents:
        strength = F.greatest(value(n), F.lit(least[n])) if n in least else value(n)
        parts[n] = F.when(value(n) > 0, strength * WEIGHTS[n] + F.when(flag(f"{n}_sure"), CONFIRMED_BONUS).otherwise(0.0)).otherwise(0.0)
    total = reduce(lambda a, b: a + b, parts.values())
    matched = reduce(lambda a, b: a | b, [p > 0 for p in parts.values()])
    if boost is not None:
        total = total + F.least(F.coalesce(boost, F.lit(0.0)), F.lit(RULE_BOOST))
    wrong = reduce(lambda a, b: a | b, [flag(f"{n}_mismatch") for n in intents], F.lit(False))
    total = total - F.when(wrong, MISMATCH_PENALTY).otherwise(0.0)
    said = F.concat_ws(",", *[F.when(p > 0, n) for n, p in parts.items()], F.when(wrong, "mismatch"))
    found = rows.where(matched).select(id_col, total.alias("relevance"), said.alias("explanation"))
    return found.where((F.col("relevance") >= MIN_SCORE) & (F.col("relevance") > 0)).withColumn("relevance", F.least("relevance", F.lit(1.0)))


def squashed(bm25: Column, plain: bool = False) -> Column:
    """A BM25 score (higher is better) between 0 and 1: ``1 / (1 + exp(-b))``, or ``1 / (1 + 1 / (1 + b))`` for the plainer search."""
    return 1 - 1 / (1 + F.abs(bm25)) if plain else 1 / (1 + F.exp(-bm25))


def sorted_page(rows: DataFrame, how: str, id_col: str, offset: int, limit: int) -> DataFrame:
    """One page by ``relevance``, ``filename``, ``size``, ``newest`` (missing times first), ``oldest`` or, as the plainer list has it, ``newest_last`` (missing times last)."""
    name = F.lower("filename")
    order = {
        "relevance": [F.desc("relevance"), name], "filename": [name], "size": [F.desc_nulls_last("byte_size"), name],
        "newest": [F.desc_nulls_first("modified_ms"), name], "oldest": [F.asc_nulls_last("modified_ms"), name], "newest_last": [F.desc_nulls_last("modified_ms"), name],
    }[how]
    return rows.orderBy(*order, id_col).offset(offset).limit(limit)
