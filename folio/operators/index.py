"""A stored inverted index of several fields, and BM25 and TF-IDF searches that read only their terms' part of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import run_lengths
from folio.operators.search import B, K1, tokens
from folio.plans.sizes import spread

BUCKETS = 64
"""Folders that the postings are dealt over by a hash of their token; more for larger corpora."""


def bucket_of(token: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def build(docs: DataFrame, id_col: str, fields: list[str], path: str, buckets: int = BUCKETS) -> None:
    """Write the index of ``fields`` below ``path``: forms, the lengths of all fields of a document; postings, a field's term frequencies; the corpus's sums.

    A token's occurrences are counted within the row of its document, so postings are not shuffled: texts are dealt over tasks small enough to
    sort theirs in memory, and every task writes a segment of its own, sorted by token, below each bucket's folder. A posting names its document by its form, a hash of id and lengths.
    """
    form, lengths = F.xxhash64(id_col, *[f"{f}_length" for f in fields]), [f"{f}_length" for f in fields]
    cut = spread(docs.select(id_col, *fields), id_col).select(id_col, *[F.size(tokens(F.col(f))).alias(n) for f, n in zip(fields, lengths, strict=True)], *[tokens(F.col(f)).alias(f"{f}_tokens") for f in fields])
    cut.select(form.alias("form"), id_col, *lengths).write.parquet(f"{path}/forms")

    def marked(field: str) -> Column:
        entry = lambda x: F.struct(x["value"].alias("token"), F.lit(field).alias("field"), x["n"].alias("tf"))
        return F.transform(run_lengths(F.col(f"{field}_tokens")), entry)

    rows = cut.select(form.alias("form"), F.inline(F.concat(*map(marked, fields)))).withColumn("bucket", bucket_of(F.col("token"), buckets))
    rows.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/postings")
    sums = docs.sparkSession.read.parquet(f"{path}/forms")
    sums.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in lengths]).write.parquet(f"{path}/sums")


def postings(spark: SparkSession, path: str, asked: list[str], weights: dict[str, float], id_col: str, buckets: int = BUCKETS) -> DataFrame:
    """``(id_col, token, f, length)`` of the ``asked`` tokens in the fields of ``weights``: their frequencies weighted by field, and the length of these fields.

    Only the tokens' buckets' folders are listed and, sorted by token, only their row groups read. Documents of one id and form are one.
    """
    held = sorted({r[0] for r in spark.createDataFrame([(t,) for t in asked], "token string").select(bucket_of(F.col("token"), buckets)).collect()}) if asked else []
    rows = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(held) & F.col("token").isin(asked) & F.col("field").isin(list(weights)))
    weight = F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, float(w))])[F.col("field")]
    found = rows.groupBy("form", "token").agg(F.sum(F.col("tf") * weight).alias("f"))
    forms = spark.read.parquet(f"{path}/forms").select("form", id_col, sum((F.col(f"{c}_length") for c in weights), F.lit(0)).alias("length")).distinct()
    return found.join(forms, "form").select(id_col, "token", "f", "length")


def bm25(spark: SparkSession, path: str, id_col: str, weights: dict[str, float], asked: list[str]) -> DataFrame:
    """``(id_col, score)``: BM25 over the weighted fields of a stored index, term frequencies weighted by field, lengths over these fields."""
    sums = spark.read.parquet(f"{path}/sums").first()
    n, mean = sums["n"], sum(sums[f"{f}_length"] for f in weights) / max(sums["n"], 1)
    rows = postings(spark, path, sorted(set(asked)), weights, id_col)
    df = rows.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    saturated = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))
    return rows.join(F.broadcast(df), "token").groupBy(id_col).agg(F.sum(idf * saturated).alias("score"))


def tfidf(spark: SparkSession, path: str, id_col: str, field: str, asked: list[str]) -> DataFrame:
    """``(id_col, score)``: the sum of ``ln((N + 1) / (df + 1)) + 1`` over the asked tokens, repeats included, that ``field`` holds."""
    n = spark.read.parquet(f"{path}/sums").first()["n"]
    times = {t: asked.count(t) for t in asked}
    rows = postings(spark, path, sorted(times), {field: 1.0}, id_col).select(id_col, "token")
    df = rows.groupBy("token").agg(F.count("*").alias("df"))
    repeats = F.create_map(*[F.lit(x) for pair in times.items() for x in pair]) if times else F.create_map()
    weigh = repeats[F.col("token")] * (F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1)
    return rows.join(F.broadcast(df), "token").groupBy(id_col).agg(F.sum(weigh).alias("score"))
