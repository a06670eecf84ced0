"""Lexical retrieval, vector retrieval and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import run_lengths
from folio.plans.sizes import small

K1, B = 1.2, 0.75


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-cased runs of letters and digits of at least ``least`` characters; null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(found, lambda t: F.length(t) >= least)


def token_lists(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, counts)``, one row a document: the ``(token, n)`` of its text in order.

    Tokens are counted within the row. Rows that repeat an id, or have none, are one document: only they are gathered, before they are cut.
    """
    rows = docs.select(id_col, text_col)
    again = small(rows.groupBy(id_col).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(F.col(id_col).alias("_again")))
    same = F.col(id_col).eqNullSafe(F.col("_again"))
    one = rows.join(again, same, "left_anti")
    more = rows.join(again, same, "left_semi").groupBy(id_col).agg(F.concat_ws(" ", F.collect_list(text_col)).alias(text_col))
    counts = F.transform(run_lengths(tokens(F.col(text_col))), lambda x: F.struct(x["value"].alias("token"), x["n"].cast("long").alias("tf")))
    return one.unionByName(more).select(id_col, counts.alias("counts"))


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, token, tf)``."""
    return token_lists(docs, id_col, text_col).select(id_col, F.inline("counts"))


def document_frequency(docs: DataFrame, text_col: str) -> DataFrame:
    """``(token, df)``: distinct tokens are taken inside each row, so one shuffle of counts is all."""
    rows = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("df"))


def tfidf(docs: DataFrame, id_col: str, text_col: str, query: DataFrame) -> DataFrame:
    """``(id_col, score)``: the sum of ``ln((N + 1) / (df + 1)) + 1`` over the query's tokens (column ``token``) that a text holds.

    Presence counts, not frequency; a token that the query repeats counts each time. Only rows of query tokens leave the scan.
    """
    n = docs.count()
    asked = query.groupBy("token").agg(F.count("*").alias("times"))
    rows = docs.select(id_col, F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token")).join(small(asked), "token")
    df = rows.groupBy("token").agg(F.count("*").alias("df"))
    weigh = F.col("times") * (F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1)
    return rows.join(small(df), "token").groupBy(id_col).agg(F.sum(weigh).alias("score"))


def bm25(docs: DataFrame, id_col: str, fields: dict[str, float], query: DataFrame) -> DataFrame:
    """``(id_col, score)``: BM25 over weighted fields, term frequencies weighted by field, lengths over all fields."""

    def weighed(field: str, weight: float) -> Column:
        return F.transform(tokens(F.col(field)), lambda t: F.struct(t.alias("token"), F.lit(float(weight)).alias("w")))

    parts = F.concat(*[weighed(c, w) for c, w in fields.items()])
    cut = docs.select(id_col, parts.alias("parts")).withColumn("length", F.size("parts"))
    n, mean = cut.agg(F.count("*"), F.avg("length")).first()
    asked = small(query.select("token").distinct())
    rows = cut.select(id_col, "length", F.inline("parts")).join(asked, "token")
    tf = rows.groupBy(id_col, "length", "token").agg(F.sum("w").alias("f"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    saturated = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    return tf.join(small(df), "token").groupBy(id_col).agg(F.sum(idf * saturated).alias("score"))


def holds_prefixes(text: Column, prefixes: list[str]) -> Column:
    """Whether every prefix begins some token of the text."""
    held = F.array_distinct(tokens(text, 1))

    def begins(prefix: str) -> Column:
        return F.exists(held, lambda t: F.startswith(t, F.lit(prefix)))

    out = F.lit(True)
    for p in prefixes:
        out = out & begins(p)
    return out


def snippet(text: Column, term: str, before: int = 40, width: int = 240) -> Column:
    """``width`` characters from ``before`` characters ahead of the first hit, or from the start without one."""
    at = F.greatest(F.instr(F.lower(text), term) - before, F.lit(1))
    return F.substring(text, at, F.lit(width))


def ranked(scores: DataFrame, id_col: str, k: int) -> DataFrame:
    """The top ``k`` by score, ties by id, with ``rank`` from 1. Only ``k`` rows of each task meet in one."""
    top = scores.orderBy(F.desc("score"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))


def fuse(rankings: list[DataFrame], id_col: str, k: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion: ``(id_col, score)``, the sum of ``1 / (k + rank)``."""
    rows = None
    for r in rankings:
        part = r.select(id_col, (1.0 / (F.col("rank") + k)).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(id_col).agg(F.sum("s").alias("score"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null unless lengths agree."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, v: s + v))


def quantise(v: Column) -> Column:
    """Signed bytes ``round(127 x)`` of a unit vector, clamped."""
    return F.transform(v, lambda x: F.round(F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) * 127, 0).cast("int"))


def hashed_embedding(docs: DataFrame, id_col: str, text_col: str, dimensions: int = 64) -> DataFrame:
    """``(id_col, bucket, weight)``: tokens hashed to signed buckets, normalised to unit length; zero buckets are left out."""
    rows = docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("t")).withColumn("h", F.md5("t"))
    bucket = F.conv(F.substring("h", 1, 4), 16, 10).cast("long") % dimensions
    sign = F.when(F.conv(F.substring("h", 5, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = rows.groupBy(id_col, bucket.alias("bucket")).agg(F.sum(sign).cast("double").alias("s")).where("s <> 0")
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy(id_col)))
    return sums.select(id_col, "bucket", (F.col("s") / norm).alias("weight"))
