"""Mixing sources to target weights by a van der Corput schedule of equal-token blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.names import free_name
from folio.plans.lineage import store
from folio.plans.prefix import running_total
from folio.plans.sizes import small

BLOCK_WORDS = 64
"""Words that a block has at least in large corpora."""
LEAST_BITS = 16
"""The schedule has at least 2**16 slots, or as many as there are words to take, so small corpora get smaller blocks."""


@dataclass(frozen=True)
class MixPolicy:
    """Weights go to the sources in code-point order, again and again; null comes last."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    """Words of the mix as a multiple of all words."""
    most_repeats: int = 2
    """No source, and so no document, is taken more often."""


def word_sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``size``: the number of runs free of ASCII white space; null has none."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(text_col, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long"))


def _numbered(own: DataFrame) -> DataFrame:
    """``own`` with ``src``: the source's place in code-point order, from 0, null last; names are numbered by their first letters."""
    first = F.coalesce(F.concat(F.lit("0"), F.substring("source", 1, 3)), F.lit("1"))
    return running_total(own, [], first, ["source"], F.lit(1).cast("long"), "src")


def source_targets(sizes: DataFrame, policy: MixPolicy = MixPolicy()) -> DataFrame:
    """``(src, source, source_size, target)`` from ``(source, size)`` rows, stored.

    Sources share ``share`` times all words by weight; a target stops at ``most_repeats`` times its source's words and
    the excess goes to the others by weight until none is above. Round by round the words left over are shared among the sources
    below their cap; the driver sees two sums of whole numbers a round, and a round without a new capped source is the last.
    """
    own = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    kinds = F.array(*[F.lit(int(w)) for w in policy.weights])
    own = _numbered(own).withColumn("weight", F.get(kinds, (F.col("src") % len(policy.weights)).cast("int")).cast("long"))
    own = store(own.withColumn("cap", (F.col("source_size") * policy.most_repeats).cast("long")), "sources")
    total = (own.agg(F.sum("source_size")).first()[0] or 0) * policy.share
    level, capped = 0.0, None
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        n, caps, weights = own.agg(
            F.sum(full.cast("int")), F.sum(F.when(full, F.col("cap")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        if n == capped or not weights:
            break
        level, capped = (total - caps) / weights, n
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level)))
    return own.select("src", "source", "source_size", target.alias("target"))


def reversed_bits(number: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of a long column in reverse order: a van der Corput point times 2**bits."""
    masks = (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF, 0x0000FFFF0000FFFF, 0x00000000FFFFFFFF)
    out = number
    for k, mask in enumerate(masks):
        keep, width = F.lit(mask).cast("long"), 1 << k
        out = F.shiftleft(out.bitwiseAND(keep), width).bitwiseOR(F.shiftrightunsigned(out, width).bitwiseAND(keep))
    return F.shiftrightunsigned(out, 64 - bits)


def block_plan(total: int) -> tuple[int, int]:
    """``(bits, block)``: 2**bits slots of ``block`` words hold ``total`` words."""
    bits = max(1, (total - 1).bit_length())
    bits = min(bits, max(LEAST_BITS, (-(-total // BLOCK_WORDS) - 1).bit_length()))
    return bits, -(-total // (1 << bits))


def schedule(goals: DataFrame, bits: int, block: int) -> DataFrame:
    """``(src, rank, slot)`` from ``(src, goal)`` in words: which source fills a slot, and its how-manieth it is, from 0.

    Slot j of the 2**``bits`` stands at the van der Corput point of j, a multiple of 2**-bits that no other slot has, and goes to the
    source whose interval of the cumulative goals, in blocks, holds the point. A source so gets its goal to within one block, evenly
    in every prefix of the slots; points beyond the last goal are idle. Sources that many points meet are found through 1,024
    bins by an equi-join. Slots are ranked in chunks of 65,536.
    """
    spans = running_total(goals, [], F.expr("src div 10000"), ["src"], F.col("goal"), "_from")
    upto = lambda c: F.expr(f"({c} + {block - 1}) div {block}")
    spans = spans.withColumns({"lo": upto("_from"), "hi": upto("_from + goal")}).where("hi > lo")
    shift = max(0, bits - 10)
    bins = F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))
    spans = small(spans.select("src", "lo", "hi", F.explode(bins).alias("bin")))
    points = goals.sparkSession.range(1 << bits).select(F.col("id").alias("slot"))
    points = points.withColumn("point", reversed_bits(F.col("slot"), bits)).withColumn("bin", F.shiftright("point", shift))
    filled = points.join(spans, "bin").where("point >= lo and point < hi").select("src", "slot")
    return running_total(filled, ["src"], F.expr("slot div 65536"), ["slot"], F.lit(1).cast("long"), "rank").select("src", "rank", "slot")


def scheduled_blocks(sized: DataFrame, policy: MixPolicy = MixPolicy(), rows_per_bucket: int = 2_000) -> DataFrame:
    """Rows of ``(_id, source, size)``, as ``_sizes`` gives them, with ``source_size``, ``target``, and an entry per block that reads them: ``_read``, ``slot`` and ``words``.

    Each source's documents, shuffled by the MD5 of their id, form a stream that is read up to ``most_repeats`` times and cut into
    blocks of equally many words. The n-th slot of a source takes its n-th block, if the stream reaches so far. Reads
    without a block, and documents without words, have an entry with a null slot. Buckets of the stream grow with the table.
    """
    sources = store(source_targets(sized, policy).withColumn("goal", F.floor(F.col("target") + 0.5)), "targets")
    goal = sources.agg(F.sum("goal")).first()[0]
    bits, block = block_plan(max(goal or 0, 1))
    slots = store(schedule(sources.select("src", "goal"), bits, block), "slots")
    got = slots.groupBy("src").agg(F.count("*").alias("_slots"))
    sources = sources.join(small(got), "src", "left").select("src", "source", "source_size", "target", (F.coalesce("_slots", F.lit(0)) * block).alias("_reach"))
    placed = sized.join(small(sources), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = placed.withColumn("_key", F.md5(F.coalesce(F.col("_id._id").cast("string"), F.lit(""))))
    buckets = max(1, -(-sized.count() // rows_per_bucket))
    bucket = F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets, 32)
    stream = running_total(placed, ["src"], bucket, ["_key", "size", "_id"], F.col("size"), "_at")
    reads = F.explode(F.sequence(F.lit(0), F.lit(policy.most_repeats - 1))).alias("_read")
    parts = stream.select("*", reads).withColumn("_lo", F.col("_at") + F.col("_read") * F.col("source_size"))
    parts = parts.withColumn("_hi", F.least(F.col("_lo") + F.col("size"), F.col("_reach")))
    blocks = F.when(F.col("_hi") > F.col("_lo"), F.sequence(F.expr(f"_lo div {block}"), F.expr(f"(_hi - 1) div {block}")))
    columns = ["_id", "source", "size", "source_size", "target", "src", "_read"]
    parts = parts.select(*columns, "_lo", "_hi", F.explode_outer(blocks).alias("rank"))
    overlap = F.least(F.col("_hi"), (F.col("rank") + 1) * block) - F.greatest(F.col("_lo"), F.col("rank") * block)
    taken = F.when(F.col("slot").isNotNull(), overlap).otherwise(0).cast("long")
    return parts.join(slots, ["src", "rank"], "left").select(*columns, "slot", taken.alias("words"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Stored ``(_id, source, size)`` of all rows; ``_id`` is the id with a number that tells rows apart that repeat it."""
    sized = word_sizes(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.col(text_col).alias("_text")), "_text")
    sized = store(sized.select("_id", "source", "size").withColumn("_row", F.monotonically_increasing_id()), "sizes")
    return sized.select(F.struct("_id", "_row").alias("_id"), "source", "size")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    policy: MixPolicy = MixPolicy(),
) -> DataFrame:
    """``(id_col, source, size, source_size, target, taken, first_slot)``, one row per row of ``docs``.

    ``taken`` adds a document's words in the blocks that the schedule's slots take (``scheduled_blocks``), ``first_slot`` is the first of
    these, null where there is none: documents in the order of their first slots are an even mix at the target weights from
    the start on. A source yields its target to within one block. Documents without words have 0; rows that repeat are separate
    documents; no rows give no rows. Texts are read once, for their sizes.
    """
    found = scheduled_blocks(_sizes(docs, id_col, text_col, source_col), policy)
    taken = found.groupBy("_id", "source", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return taken.select(F.col("_id._id").alias(id_col), "source", "size", "source_size", "target", "taken", "first_slot")


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", policy: MixPolicy = MixPolicy(), slots_per_part: int = 4096
) -> DataFrame:
    """The rows of ``docs`` as often as the mix reads them, whole, each reading in its place in the schedule.

    A document of which a reading takes any word stays whole, once a reading; one that the mix doesn't reach goes. Documents without
    words cannot be taken and stay once. Rows that repeat an id are counted together, and each stays as often as the most taken of
    them. Rows leave in stretches of ``slots_per_part`` slots of the schedule, in its order, so each stretch holds the sources at
    their target weights.
    """
    found = scheduled_blocks(_sizes(docs, id_col, text_col, source_col), policy)
    read = (F.col("words") > 0) | ((F.col("size") == 0) & (F.col("_read") == 0))
    key, part, slot = (free_name(docs.columns, n) for n in ("mixed", "part", "slot"))
    times = found.where(read).groupBy(F.col("_id._id").alias(key), "_read").agg(F.coalesce(F.min("slot"), F.lit(0)).alias(slot)).drop("_read")
    kept = docs.join(times, docs[id_col].eqNullSafe(F.col(key))).withColumn(part, F.expr(f"`{slot}` div {slots_per_part}"))
    return kept.repartition(part).sortWithinPartitions(part, slot).select(*docs.columns)
