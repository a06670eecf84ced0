"""Labelled rows for fitting: all documents that may be learned from, or a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
PER_CLASS = 4000
"""At most so many labelled documents of each class are used to fit; where a sample is asked for."""


def held_out(id_col: Column) -> Column:
    """True for the fifth of the ids whose CRC-32, as text, is divisible by five: never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def known_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """``(_id, _label)`` of the ids that may be learned from: null ids or labels and rows held out are left out, an id with several labels counts as its greatest."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    return known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS
) -> tuple[DataFrame, dict[int, int]]:
    """``(_id, _text, _label)`` of at most ``per_class`` rows of each class, and the class counts before that.

    Rows held out, and null ids or labels, are left out; an id with several labels counts as its greatest.
    The sample is the first by hash of the id, so it is the same in every run. At most ``2 * per_class`` ids are
    broadcast; texts stay on the executors. Texts that repeat an id are one row each.
    """
    known = known_labels(labels, label_col, id_col)
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect() if r["_label"] in (0, 1)}
    order = [F.xxhash64("_id"), F.col("_id")]
    picked = None
    for label in (0, 1):
        part = known.where(F.col("_label") == label).orderBy(*order).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return texts.join(F.broadcast(picked), "_id").select("_id", "_text", "_label"), counts
