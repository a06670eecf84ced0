"""Document fingerprints from closed syncmers. Native: SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

K = 4
"""Units of a syncmer; its inner runs are single units."""
PIECE = 5
"""Code points of a unit at most."""
HEX = 7
"""Hexadecimal digits of an anchor's hash."""
UNIT = "[^" + "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + rf"\x{{E00}}-\x{{10FFFF}}]{{1,{PIECE}}}|[^\x09\x0A\x0B\x0C\x0D\x20]"
"""A unit: up to ``PIECE`` letters or digits of a run of these, or any other single code point that is no blank.

Letters and digits are those of ASCII and all from U+0080 to U+0DFF. The scripts beyond, most of which write no blanks or write syllables, give single code points.
"""


def closed_runs(units: Column, k: int) -> Column:
    """The runs of ``k`` units, as structs, that are closed syncmers: the least of their units, by code points, is the first or the last.

    That depends on the run alone, so equal passages have equal anchors wherever they stand. Units that recur in any order are least
    at each place of a run equally often, so a run of four is chosen about every other time.
    """
    n = F.greatest(F.size(units) - (k - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice(units, i + 1, n).alias(f"u{i}") for i in range(k)])

    def closed(run: Column) -> Column:
        middle = [run[f"u{i}"] for i in range(1, k - 1)]
        return F.least(run["u0"], run[f"u{k - 1}"]) <= (F.least(*middle) if len(middle) > 1 else middle[0])

    return F.filter(runs, closed)


def _short(text: Column) -> Column:
    return F.substring(F.md5(text), 1, HEX)


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sorted distinct anchor hashes of a whole text.

    Anchors are the closed syncmers of ``K`` units. Units are short pieces of words, so a text of few words has
    several, and single code points of scripts without blanks; pieces begin anew at every blank and mark, so a passage has the
    same ones wherever it stands. One definition holds for texts of all lengths. Where no run is chosen, there is one anchor
    of all units. A function of the text alone; a null text counts as empty and, like a blank one, has no anchors.
    """
    out = df.withColumn("_u", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(UNIT), F.lit(0)))
    out = out.withColumn("_c", closed_runs(F.col("_u"), K))
    hashed = F.transform("_c", lambda run: _short(F.concat_ws(" ", *[run[f"u{i}"] for i in range(K)])))
    whole = F.when(F.size("_u") > 0, F.array(_short(F.array_join("_u", " ")))).otherwise(F.array().cast("array<string>"))
    return out.withColumn(name, F.sort_array(F.array_distinct(F.when(F.size("_c") > 0, hashed).otherwise(whole)))).drop("_u", "_c")


def print_text(fp: str) -> Column:
    """A fingerprint as one string: its hashes, comma-joined."""
    return F.array_join(fp, ",")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two fingerprints, 0 to 1. Equal fingerprints, empty ones too, have 1; an empty and another one have 0."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def cut_number(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``key``: first among every n-th of them, then among the n that follow, n the root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    rows = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    table = F.transform(F.split(F.lit(";".join(",".join(map(str, r)) for r in rows)), ";"), lambda r: F.split(r, ",").cast("array<bigint>"))
    heads = F.split(F.lit(",".join(str(r[0]) for r in rows)), ",").cast("array<bigint>")
    row = F.size(F.filter(heads, lambda c: c <= key)) - 1
    return F.when(row < 0, F.lit(0)).otherwise(row * step + F.size(F.filter(F.get(table, row), lambda c: c <= key)))


def in_ranges(df: DataFrame, id_col: str, tie: Column, rows_per_bucket: int = 1000, most_buckets: int = 1 << 16) -> tuple[DataFrame, WindowSpec]:
    """``df`` dealt by ranges of the id, and the window in which each row's follower is the next row.

    Ranges are cut at ids that an approximate quantile finds in the table. The first row of a range is sent to
    the range before as well, and the first of all to the last, so each range has all it needs; any
    cuts give the same result. These additional rows have ``_extra`` 1 and must be dropped after the window.
    A null id comes first; rows that repeat an id follow each other by ``tie``. Only ``df``'s columns, ``_extra`` and
    what the window needs are added: ``_bucket``, ``_wrap``, ``_key``, ``_tie``. More than ``most_buckets`` times
    ``rows_per_bucket`` rows make ranges longer; they are sorted with spilling, never held.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    df = df.withColumn("_key", key).withColumn("_tie", tie)
    n, low = df.agg(F.count("*"), F.min("_key")).first()
    buckets = max(1, min(most_buckets, n // rows_per_bucket))
    cuts: list[int] = []
    if buckets > 1:
        steps = [i / buckets for i in range(1, buckets)]
        found = df.agg(F.percentile_approx("_key", steps, 100_000).alias("c")).first()["c"]
        cuts = sorted({c for c in found if c > low})
    first = df.withColumn("_own", cut_number(F.col("_key"), cuts))
    cell = lambda bucket, wrap, extra: F.struct(bucket.alias("_bucket"), F.lit(wrap).alias("_wrap"), F.lit(extra).alias("_extra"))
    nothing = F.array().cast("array<struct<_bucket:int,_wrap:int,_extra:int>>")
    at_cut = (F.col("_own") > 0) & (cut_number(F.col("_key") - 1, cuts) < F.col("_own"))
    ahead = F.when(at_cut, F.array(cell(F.col("_own") - 1, 0, 1))).otherwise(nothing)
    around = F.when(F.col("_key") == F.lit(low), F.array(cell(F.lit(len(cuts)), 1, 1))).otherwise(nothing)
    dealt = first.select("*", F.inline(F.concat(F.array(cell(F.col("_own"), 0, 0)), ahead, around))).drop("_own")
    return dealt, Window.partitionBy("_bucket").orderBy("_wrap", "_key", "_tie")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness to each other and to the next document.

    ``(id_col, n_chars, edited, fp, edited_fp, near_edited, near_next)``. The edited text has its last quarter of
    code points, rounded down, replaced by as many, or all, of the next document's. Null counts as the
    empty text. One row follows itself. Only ids and texts are shuffled, once; fingerprints are made after that.
    """
    slim = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    dealt, order = in_ranges(slim, id_col, F.xxhash64("_text"))
    paired = dealt.withColumn("_next", F.lead("_text").over(order)).withColumn("n_chars", F.length("_text").cast("long"))
    quarter = F.expr("cast(n_chars div 4 as int)")
    kept = F.substring(F.col("_text"), F.lit(1), F.length("_text") - quarter)
    paired = paired.withColumn("edited", F.concat(kept, F.substring(F.col("_next"), F.lit(1), quarter))).drop("_next")
    paired = fingerprint(paired, "_text", "fp").drop("_text").withColumn("_next_fp", F.lead("fp").over(order))
    out = fingerprint(paired.where("_extra = 0"), "edited", "edited_fp")
    return out.select(
        id_col, "n_chars", "edited", "fp", "edited_fp",
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "_next_fp").alias("near_next"),
    )
