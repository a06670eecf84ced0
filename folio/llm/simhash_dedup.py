"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import BLANKS, lower_ascii, split_words
from folio.plans.components import components
from folio.plans.lineage import store
from folio.plans.sizes import split_join

PAIR_MASK = (1 << 32) | 1


def shingles(docs: DataFrame, text_col: str, width: int = 3) -> DataFrame:
    """``docs`` without ``text_col``, once per shingle of ``width`` words, repeats included, as column ``_shingle``.

    Fewer words give the whole sequence as one shingle, no words one null shingle. Each exploded row holds its own words only.
    """
    words = docs.withColumn("_words", split_words(lower_ascii(F.col(text_col)), BLANKS)).drop(text_col)
    n = F.size("_words")
    runs = F.arrays_zip(*[F.slice("_words", i + 1, F.greatest(n - i, F.lit(0))).alias(f"w{i}") for i in range(width)])
    whole = F.slice(runs, 1, F.greatest(n - width + 1, F.least(n, F.lit(1))))
    rows = words.select(*[c for c in words.columns if c != "_words"], F.explode_outer(whole).alias("_run"))
    return rows.withColumn("_shingle", F.when(F.col("_run").isNotNull(), F.concat_ws(" ", *[F.col(f"_run.w{i}") for i in range(width)]))).drop("_run")


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id_col, fp)``: a 64-bit SimHash of every whole text as a signed long.

    A bit is set if it is set in over half of the XXH64 (seed 42) hashes of the shingles.
    Null, empty and blank texts give 0. Rows that repeat both id and text give one row; one
    id with different texts gives a row for each text. Columns besides the two are not read.
    Two counters of 32 bits share each of the 32 sums, so 2**32 shingles a text fit.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    slim = slim.withColumn("_body", F.xxhash64("_text"))
    h = F.xxhash64("_shingle")
    rows = shingles(slim, "_text", width).select("_id", "_body", F.when(F.col("_shingle").isNotNull(), h).alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(PAIR_MASK))).alias(f"s{i}") for i in range(32)]
    counts = rows.groupBy("_id", "_body").agg(F.count("h").alias("n"), *sums)

    def bit(count: Column, at: int) -> Column:
        return F.when(count * 2 > F.col("n"), F.lit((1 << at) - (1 << 64 if at == 63 else 0))).otherwise(F.lit(0))

    fp: Column = F.lit(0).cast("long")
    for i in range(32):
        low = F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"s{i}", 32)
        fp = fp.bitwiseOR(bit(low, i)).bitwiseOR(bit(high, i + 32))
    return counts.select(F.col("_id").alias(id_col), F.when(F.col("n") > 0, fp).otherwise(F.lit(0)).cast("long").alias("fp"))


# 14 sets of four of the eight byte positions; any three positions stand together in exactly one of them.
QUADS = (
    (0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7), (0, 2, 4, 6), (0, 2, 5, 7), (0, 3, 4, 7), (0, 3, 5, 6),
    (1, 2, 4, 7), (1, 2, 5, 6), (1, 3, 4, 6), (1, 3, 5, 7), (2, 3, 4, 5), (2, 3, 6, 7), (4, 5, 6, 7),
)
LEAST_SHARED = {1: 7, 2: 3}
"""Lists that two fingerprints share at least, by the bytes that may differ; with one byte more that differs they share fewer."""
LIST_LIMIT = 16
"""Postings lists up to this length are paired directly, longer ones linked through variants."""


def _byte(fp: Column, at: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * at).bitwiseAND(F.lit(255))


def postings(prints: DataFrame) -> DataFrame:
    """The inverted index ``(key, fp)``: each distinct fingerprint in fourteen lists, one for the values at each of ``QUADS``.

    Lists of single positional bytes hold a 256th of all fingerprints each and their pairs grow with the square; lists of four
    bytes stay short. Fingerprints that share six bytes stand in three lists together, with seven in seven, with five in one.
    """
    keys = []
    for c, quad in enumerate(QUADS):
        key = F.lit(c).cast("long")
        for p in quad:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(F.col("fp"), p))
        keys.append(key)
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def tallied(lists: DataFrame, least: int) -> DataFrame:
    """``(u, v, shared)`` of the pairs that stand together in ``least`` or more of the ``(key, members)`` lists."""
    pairs = lists.select("members", F.explode("members").alias("u")).select("u", F.explode("members").alias("v")).where("u > v")
    return pairs.groupBy("u", "v").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """``(u, v)`` edges that connect distinct fingerprints at ``max_bits`` (0 to 2) or fewer differing bits.

    Pairs are tallied over the lists of the index that hold them. ``max_bits`` bits change at most as many bytes, so a pair that
    qualifies reaches ``LEAST_SHARED``; those that do are verified bit by bit. A list longer than ``LIST_LIMIT`` would give pairs
    without bound and takes no part in the tally: each of its members is put under itself and itself with one of the other 32
    bits flipped instead. Two bits apart or less, members meet under such a variant, and members that meet are never further
    apart, so linking each to the least there is exact. It costs 33 rows a member, and no more than 65 fingerprints meet under one
    variant. A pair that stands together in any long list is linked there, all others have all their lists in the tally. Lists are
    counted with map-side combining; very long ones are never gathered.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    if max_bits == 0:
        return prints.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    index = store(postings(prints.select("fp").distinct()), "postings")
    sizes = store(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    long = sizes.where(F.col("n") > LIST_LIMIT)
    short = index.join(sizes.where(F.col("n") <= LIST_LIMIT).select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("members"))
    pairs = tallied(short, LEAST_SHARED[max_bits])
    pairs = pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).select("u", "v")
    variants = _variants(split_join(index, long, ["key"], "n"))
    if max_bits == 1:  # only the variants that are fingerprints themselves
        known = prints.select(F.col("fp").alias("v")).distinct()
        return pairs.unionByName(variants.join(known, "v", "left_semi").select("u", "v"))
    met = variants.distinct()
    least = met.groupBy("v").agg(F.min("u").alias("least"), F.count("*").alias("n")).where("n > 1").select("v", "least")
    return pairs.unionByName(met.join(least, "v").where("u <> least").select("u", F.col("least").alias("v")).distinct())


def _variants(rows: DataFrame) -> DataFrame:
    """``fp`` as ``u`` with, as ``v``, itself and itself under each one flipped bit outside the bytes of ``key``."""
    which = F.shiftrightunsigned("key", 32)
    flips = None
    for c, quad in enumerate(QUADS):
        free = [8 * p + b for p in range(8) if p not in quad for b in range(8)]
        masks = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in free])
        flips = F.when(which == c, masks) if flips is None else flips.when(which == c, masks)
    return rows.select(F.col("fp").alias("u"), F.explode(flips).alias("_flip")).select(
        "u", F.col("u").bitwiseXOR(F.col("_flip")).alias("v")
    )


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, max_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored ``(id_col, fp)`` of the documents and ``(fp, first, root)`` of their prints, and ``(root, component_id)``."""
    prints = store(simhash(docs, id_col, text_col, width), "simhash")
    roots = components(links(prints, max_bits)).select(F.col("node").alias("fp"), "root")
    least = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    classes = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = store(classes, "classes")
    return prints, classes, classes.groupBy("root").agg(F.min("first").alias("component_id"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2
) -> DataFrame:
    """``(id_col, fp, component_id)``: one row per document with its class, the least id that links reach.

    Only distinct fingerprints are compared, so thousands of copies cost one posting each.
    Documents without words share the fingerprint 0 and are linked like any other. A null id is
    never the least of a class that has another. An empty table gives an empty result.
    """
    prints, classes, of_root = _classes(docs, id_col, text_col, width, max_bits)
    return prints.join(classes.join(of_root, "root").select("fp", "component_id"), "fp").select(
        id_col, "fp", "component_id"
    )


def hex_print(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2
) -> DataFrame:
    """One row of ``docs`` for every near-duplicate class, columns unchanged: that of least id.

    A null id comes after all others. Texts that share the id are told apart by their hash; rows that
    repeat both give the one whose columns hash least. Copies meet before the shuffle, so thousands of
    them are one row a task.
    """
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"))
    _, _, of_root = _classes(docs.select(row.alias("_row"), F.col(text_col)), "_row", text_col, width, max_bits)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = docs.groupBy(row.alias("_row")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_kept"))
    return single.join(of_root.select(F.col("component_id").alias("_row")), "_row", "left_semi").select("_kept.*")
