"""The development embedding: hashed words, character trigrams and word pairs with a few local concepts, as sparse vectors, and search by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import bound
from folio.operators.search import tokens
from folio.plans.sizes import small

WORD, TRIGRAM, PAIR = 1.0, 0.35, 0.55
TEXTS_A_TASK = 1_000
"""Texts whose buckets one task holds at once."""
# Words that stand for others, in the order in which these are appended.
CONCEPTS = {
    "facture": ["invoice", "billing"], "devis": ["quote", "estimate"], "contrat": ["contract", "agreement"], "chantier": ["project", "construction"], "projet": ["project"],
    "fournisseur": ["supplier", "vendor"], "client": ["customer"], "photo": ["image", "picture"], "administratif": ["administrative"], "personnel": ["personal", "private"],
}


def expanded(words: Column) -> Column:
    """A text's words, then those that its concepts stand for, in the order of the table."""
    none = F.array().cast("array<string>")
    return F.concat(words, *[F.when(F.array_contains(words, word), F.array(*map(F.lit, others))).otherwise(none) for word, others in CONCEPTS.items()])


def features(words: Column) -> Column:
    """``(feature, weight)`` of a list of words: each word, each run of three characters within one, each two neighbours."""
    entry = lambda c, w: F.struct(c.alias("feature"), F.lit(w).alias("weight"))
    single = F.transform(words, lambda w: entry(w, WORD))
    runs = F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= 3, F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: entry(F.substring(w, i, F.lit(3)), TRIGRAM))).otherwise(F.slice(F.array(entry(w, TRIGRAM)), 1, 0))))
    ahead = F.slice(words, 2, F.size(words))
    pairs = F.transform(F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), ahead.alias("b")), lambda p: entry(F.concat(p["a"], F.lit(":"), p["b"]), PAIR))
    return F.concat(single, runs, pairs)


def development(texts: DataFrame, id_col: str, text_col: str, dimensions: int = 256) -> DataFrame:
    """``(id_col, bucket, weight)``: unit vectors of texts in search form, without their zero buckets.

    Features are hashed to signed buckets: the first two bytes of the MD5 choose the bucket, the third the sign. Weights of one bucket are added
    where the texts are dealt, ``TEXTS_A_TASK`` to a task. Null texts, texts without words and vectors that cancel out give no row. ``dimensions`` are brought to 64 to 512.
    """
    size = min(max(dimensions, 64), 512)
    # a task adds up the buckets of so many texts, however large the files; sums and norms need no other shuffle
    tasks = max(1, -(-texts.count() // TEXTS_A_TASK))
    lists = texts.select(id_col, text_col).repartition(tasks, id_col).select(id_col, bound(tokens(F.col(text_col)), expanded).alias("_w"))
    rows = lists.select(id_col, F.inline(bound(F.col("_w"), features))).withColumn("h", F.md5("feature"))
    bucket = F.conv(F.substring("h", 1, 4), 16, 10).cast("long") % size
    sign = F.when(F.conv(F.substring("h", 5, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    # weights are multiples of .05: sums of whole numbers are exact in any order
    units = F.round(F.col("weight") * 20).cast("long")
    sums = rows.groupBy(id_col, bucket.alias("bucket")).agg(F.sum(sign * units).alias("s")).where("s <> 0")
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy(id_col)))
    return sums.select(id_col, "bucket", (F.col("s") / norm).alias("weight"))


def similar(vectors: DataFrame, asked: DataFrame, id_col: str, query_col: str, most: int) -> DataFrame:
    """``(query_col, id_col, score, rank)``: the ``most`` vectors of greatest positive cosine for every query, ties by id.

    Unit vectors meet in the buckets that both hold; products are added map-side for each pair. Queries are sent to all tasks if they
    are few rows, else both sides are dealt by bucket and the pairs by theirs.
    """
    mine = asked.select(query_col, "bucket", F.col("weight").alias("_q"))
    met = vectors.join(small(mine), "bucket")
    scores = met.groupBy(query_col, id_col).agg(F.round(F.sum(F.col("weight") * F.col("_q")), 9).alias("score")).where("score > 0")
    order = Window.partitionBy(query_col).orderBy(F.desc("score"), id_col)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def with_stored(made: DataFrame, stored: DataFrame, id_col: str) -> DataFrame:
    """``stored`` vectors where there are any, those ``made`` from text for the others; all sparse ``(id_col, bucket, weight)``."""
    return stored.select(id_col, "bucket", "weight").unionByName(made.join(stored.select(id_col).distinct(), id_col, "left_anti"))
