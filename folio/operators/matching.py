"""Which candidate pairs are kept, which mention a signal belongs to, and when machine-made candidates go."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.linkage import PER_MENTION
from folio.plans.components import components
from folio.plans.lineage import store
from folio.plans.sizes import hashed, small, spread

# Markers of blocks whose members very likely are one, and which signals a kind of mention can have.
STRONG_BLOCKS = ("company_identifier", "vat_identifier", "email", "phone", "account_identifier", "project_reference")
ALLOWED = {
    "organization": ("company_identifier", "vat_identifier", "email", "domain", "phone", "address", "account_identifier"),
    "person": ("email", "phone", "address"), "project": ("project_reference", "address"),
}
NEAR_CHARS = 500
GROUP_PAIRS, GROUP_MENTIONS, RANGE_PAIRS = 20_000_000, 2_000_000, 2_000_000
"""Pairs of a class that one task reads in order, mentions it counts for, and pairs that a task holds at once where a class is cut into ranges."""
MACHINE = ("candidate", "conflicting")


def block_priority(block_kind: Column) -> Column:
    """0 for blocks of an identifier, address or number, 1 for equal names, 2 for core names, 3 for others; a pair has that of its best block."""
    return F.when(block_kind.isin(*STRONG_BLOCKS), 0).when(block_kind == "name", 1).when(block_kind == "core", 2).otherwise(3)


def _passed(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """What one walk in order over a group's pairs says of the open ones: ``1`` fits at the ends met here, ``-1`` finds one of them full.

    ``rows`` are ``(_p, _m, _t)``, one for each end of a pair that lies in the group. Each mention counts what earlier pairs surely took and what they took
    at most; a pair with a further end elsewhere may still be taken, so it only raises the second count.
    """
    rows = rows.sort_values("_p", kind="stable", ignore_index=True)
    codes, names = pd.factorize(rows["_m"])
    codes, places, taken = codes.tolist(), rows["_p"].tolist(), rows["_t"].tolist()
    least, top = [0] * len(names), [0] * len(names)
    found: list[tuple[int, int, int]] = []
    at, n = 0, len(rows)
    while at < n:
        ends = [codes[at]]
        if at + 1 < n and places[at + 1] == places[at]:
            ends.append(codes[at + 1])
        if not taken[at] and any(least[m] >= most for m in ends):
            found.append((places[at], -1, len(ends)))
        else:
            fits = all(top[m] < most for m in ends)
            if not taken[at] and fits:
                found.append((places[at], 1, len(ends)))
            for m in ends:
                top[m] += 1
                if taken[at] or (fits and len(ends) == 2):
                    least[m] += 1
        at += len(ends)
    return pd.DataFrame(found, columns=["_p", "_v", "_n"]).astype("int64")


def _classes(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root, degree)`` of every mention's hash: the class that pairs put it in, and how many pairs of other mentions it has.

    Each mention is first linked with the least and the greatest hash among its partners, two edges a mention whatever it has. Pairs that still lie between two
    classes then link these. Mentions with equal hashes count as one, which can only join classes.
    """
    ends = pairs.select(F.xxhash64(a).alias("u"), F.xxhash64(b).alias("v")).where("u <> v")
    both = ends.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("o")), F.struct(F.col("v").alias("node"), F.col("u").alias("o")))))
    near = store(both.groupBy("node").agg(F.min("o").alias("low"), F.max("o").alias("high"), F.count("*").alias("degree")), "nearest-partners")
    edges = near.select(F.col("node").alias("u"), F.col("low").alias("v")).unionByName(near.select(F.col("node").alias("u"), F.col("high").alias("v")))
    first = store(components(edges), "first-classes")
    met = ends.join(hashed(first), F.col("u") == F.col("node")).select(F.col("root").alias("u"), "v").distinct()
    met = met.join(hashed(first), F.col("v") == F.col("node")).where("u <> root").select("u", F.col("root").alias("v")).distinct()
    joined = components(met).select(F.col("node").alias("root"), F.col("root").alias("_whole"))
    roots = first.join(joined, "root", "left").select("node", F.coalesce("_whole", "root").alias("root"))
    return store(roots.join(near.select("node", "degree"), "node"), "classes-of-pairs")


def _walked(batches, a: int, b: int, root: int, most: int):
    """The rows that are taken of classes whose rows come one after the other and in order; without the class's column, which is the last."""
    of, held = None, {}
    for batch in batches:
        taken = []
        for i, (r, x, y) in enumerate(zip(batch.column(root).to_pylist(), batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True)):
            if r != of:
                of, held = r, {}
            if held.get(x, 0) < most and held.get(y, 0) < most:
                held[x] = held.get(x, 0) + 1
                held[y] = held.get(y, 0) + 1
                taken.append(i)
        rows = batch.take(pa.array(taken, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(root)], names=rows.schema.names[:root])


def capped(pairs: DataFrame, order: list[str], most: int = PER_MENTION, a: str = "a", b: str = "b", group: int = GROUP_PAIRS) -> DataFrame:
    """``pairs`` that are taken when they come one by one in ``order`` and a mention that has ``most`` of them takes no more.

    Equal to the sequential pass. Mentions that pairs connect never depend on others, so each class of up to ``group`` pairs is sorted and walked in order by
    a task of its own, which holds a number for each mention and reads the pairs as they come. Larger classes are cut into ranges of mentions (``_by_ranges``).
    ``order`` with the two ends is unique, the ends differ and are not null.
    """
    columns = pairs.columns
    pairs = store(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()), "pairs")
    roots = _classes(pairs, a, b)
    sizes = roots.groupBy("root").agg((F.sum("degree") / 2).alias("pairs"), F.count("*").alias("mentions"))
    large = store(sizes.where((F.col("pairs") > group) | (F.col("mentions") > GROUP_MENTIONS)).select(F.col("root").alias("_root"), "pairs"), "large-classes")
    dealt = pairs.withColumn("_node", F.xxhash64(a)).join(hashed(roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))), "_node").select(*columns, "_root")
    lone = spread(dealt.join(small(large.select("_root")), "_root", "left_anti").select(*columns, "_root"), "_root").sortWithinPartitions("_root", *order, a, b)
    at = [columns.index(c) for c in (a, b)]
    taken = store(lone.mapInArrow(lambda batches: _walked(batches, *at, len(columns), most), pairs.schema), "pairs-taken")
    if large.isEmpty():
        return taken
    return taken.unionByName(_by_ranges(dealt.join(small(large.select("_root")), "_root").select(*columns, "_root"), order, most, a, b, min(group, RANGE_PAIRS)))


def _by_ranges(pairs: DataFrame, order: list[str], most: int, a: str, b: str, group: int) -> DataFrame:
    """``capped`` of pairs with their class ``_root``, in rounds over ranges of mentions with about ``group`` pairs.

    A pair is taken once every range that holds an end of it finds room even if all earlier open pairs are taken, it goes once an end is full. The first open
    pair is decided in every round, and a round decides whatever lies within its range, so chains take as many rounds as ranges they cross, not as pairs they
    have. Of a mention's pairs the first ``group`` are walked in a round.
    """
    columns = [c for c in pairs.columns if c != "_root"]
    key = [F.col(c) for c in (*order, a, b)]
    placed = pairs.orderBy(*key).select(F.monotonically_increasing_id().alias("_p"), F.col(a).alias("_a"), F.col(b).alias("_b"), "_root", F.struct(*columns).alias("_row"))
    # numbers of rows grow with their order; written once, they are the order of all that follows
    placed = store(placed, "pairs-in-order")
    ends = lambda df: df.select("_p", F.explode(F.array("_a", "_b")).alias("_m"))
    told = "_p long, _v long, _n long"
    walk = lambda rows: rows.groupBy("_g").applyInPandas(lambda frame: _passed(frame, most), told)
    # ranges of mentions, class by class
    mentions = placed.select("_root", F.explode(F.array("_a", "_b")).alias("_m")).distinct()
    cut = mentions.repartitionByRange(max(2, -(-2 * placed.count() // group)), "_root", "_m").select("_m", F.spark_partition_id().cast("string").alias("_g"))
    cut = store(cut, "ranges-of-mentions")
    open_pairs = store(placed.select("_p", "_a", "_b"), "open-pairs")
    done = open_pairs.limit(0)
    near = F.row_number().over(Window.partitionBy("_m").orderBy("_p"))
    while not open_pairs.isEmpty():
        known = ends(open_pairs).withColumn("_t", F.lit(False)).unionByName(ends(done).withColumn("_t", F.lit(True)))
        known = known.withColumn("_r", near).where(F.col("_r") <= group).drop("_r")
        said = walk(known.join(cut, "_m")).groupBy("_p").agg(F.min("_v").alias("_v"), F.sum("_n").alias("_n"))
        said = store(open_pairs.join(said, "_p", "left"), "pairs-judged")
        fits = F.coalesce((F.col("_v") == 1) & (F.col("_n") == 2), F.lit(False))
        done = store(done.unionByName(said.where(fits).select("_p", "_a", "_b")), "taken-pairs")
        left = said.where(~fits & (F.col("_v").isNull() | (F.col("_v") == 1))).select("_p", "_a", "_b")
        # later pairs of mentions that have as many are decided, also those that were not walked
        full = ends(done).withColumn("_r", near).where(F.col("_r") <= most).groupBy("_m").agg(F.count("*").alias("_c"), F.max("_p").alias("_last")).where(F.col("_c") >= most)
        for end in ("_a", "_b"):
            left = left.join(full.select(F.col("_m").alias(end), "_last"), end, "left").where(F.col("_last").isNull() | (F.col("_p") < F.col("_last"))).drop("_last")
        open_pairs = store(left.select("_p", "_a", "_b"), "open-pairs")
    return placed.join(done.select("_p"), "_p").select("_row.*")


def attached(sources: DataFrame, signals: DataFrame, doc: str, within: int = NEAR_CHARS) -> DataFrame:
    """``(doc, signal_id, source_id)``: the mention that each signal of a document belongs to.

    ``sources`` are ``(doc, source_id, kind, start)``, ``signals`` ``(doc, signal_id, signal, start)``. Only mentions of a kind that can have the
    signal count. The only one of its document takes it wherever it stands; of several the nearest, if it is at most ``within``
    characters away and no other is as near. Signals without any go. Positions may be null and repeat.

    Mentions and signals are dealt once, by document; all that follows are windows within it, so nothing is shuffled again and no rows are joined.
    Mentions are counted a position, and every signal looks back and ahead along its document for the next position that has any.
    """
    kind, types = F.col("kind"), dict(sources.dtypes) | dict(signals.dtypes)
    can = F.array().cast("array<string>")
    for k, held in ALLOWED.items():
        can = F.when(kind == k, F.array(*map(F.lit, held))).otherwise(can)
    ours = sources.select(doc, "source_id", F.lit(None).cast(types["signal_id"]).alias("signal_id"), can.alias("_s"), F.col("start").cast("long").alias("start"), F.lit(True).alias("_able"))
    asks = signals.select(doc, F.lit(None).cast(types["source_id"]).alias("source_id"), "signal_id", F.array("signal").alias("_s"), F.col("start").cast("long").alias("start"), F.lit(False).alias("_able"))
    rows = spread(ours.unionByName(asks).where(F.col(doc).isNotNull()), doc)
    rows = rows.select(doc, "source_id", "signal_id", "start", "_able", F.explode("_s").alias("signal"))
    of, place = Window.partitionBy(doc, "signal"), Window.partitionBy(doc, "signal", "start")
    rows = rows.withColumns({"_n": F.count_if("_able").over(of), "_sole": F.min("source_id").over(of), "_here": F.count_if("_able").over(place), "_first": F.min("source_id").over(place)})
    position = F.struct("start", F.col("_here").alias("n"), F.col("_first").alias("source_id"))
    rows = rows.withColumn("_p", F.when(F.col("_able") & F.col("start").isNotNull(), position))
    till = lambda order: of.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_back": F.last("_p", True).over(till(F.asc("start"))), "_ahead": F.last("_p", True).over(till(F.desc("start")))}).where(~F.col("_able"))
    back, ahead = F.col("start") - F.col("_back.start"), F.col("_ahead.start") - F.col("start")
    nearer = F.when(back.isNull() | (ahead < back), F.col("_ahead")).otherwise(F.col("_back"))
    tied = (back == ahead) & (F.col("_back.start") != F.col("_ahead.start"))
    far = F.least(F.coalesce(back, ahead), F.coalesce(ahead, back))
    sole = F.col("_n") == 1
    fits = F.coalesce((far <= within) & ~F.coalesce(tied, F.lit(False)) & (nearer["n"] == 1), F.lit(False))
    # a signal's row that has its only mention stands for all rows of its id
    rows = rows.select(doc, "signal_id", sole.alias("_alone"), fits.alias("_fits"), F.when(sole, F.col("_sole")).otherwise(nearer["source_id"]).alias("source_id"))
    rows = rows.withColumn("_any", F.max("_alone").over(Window.partitionBy(doc, "signal_id")) & F.col("signal_id").isNotNull())
    return rows.where(F.col("_alone") | (F.col("_fits") & ~F.col("_any"))).select(doc, "signal_id", "source_id")


def superseded(candidates: DataFrame, occurrences: DataFrame, changed: DataFrame, version: str) -> DataFrame:
    """``candidates`` with those retired that the machine made and that no longer stand, and ``retired_for``.

    ``candidates`` are ``(candidate, a, b, status, active, version, review_group)``, ``occurrences`` ``(identity, active)``, ``changed`` identities
    ``(identity)``. An active candidate that awaits a decision goes for the first of these reasons that holds: an end has ``changed``, it was
    made by another ``version`` (outdated), or an end has no active occurrence left (orphaned). What users decided, and automatic links, stay.
    """
    waiting = F.col("active") & F.col("status").isin(*MACHINE)
    live = occurrences.where("active").select("identity").distinct()
    new = changed.select("identity").distinct()
    rows = candidates
    for end in ("a", "b"):
        rows = rows.join(new.select(F.col("identity").alias(end), F.lit(True).alias(f"_new_{end}")), end, "left")
        rows = rows.join(live.select(F.col("identity").alias(end), F.lit(True).alias(f"_live_{end}")), end, "left")
    fresh = F.col("_new_a").isNotNull() | F.col("_new_b").isNotNull()
    dead = F.col("_live_a").isNull() | F.col("_live_b").isNull()
    why = F.when(~waiting, None).when(fresh, "changed").when(~F.col("version").eqNullSafe(F.lit(version)), "outdated").when(dead, "orphaned")
    rows = rows.withColumn("retired_for", why)
    gone = F.col("retired_for").isNotNull()
    rows = rows.withColumns({"status": F.when(gone, "superseded").otherwise(F.col("status")), "active": F.col("active") & ~gone})
    return rows.select(*candidates.columns, "retired_for")


def refreshed_groups(candidates: DataFrame) -> DataFrame:
    """``(review_group, waiting, state)`` of all review groups: how many active candidates await a decision, and whether that leaves it open."""
    waiting = F.col("active") & F.col("status").isin(*MACHINE)
    rows = candidates.groupBy("review_group").agg(F.count_if(waiting).alias("waiting"), F.count_if(waiting & (F.col("status") == "conflicting")).alias("_clash"))
    state = F.when(F.col("waiting") == 0, "resolved").when(F.col("_clash") > 0, "conflicting").otherwise("open")
    return rows.select("review_group", "waiting", state.alias("state"))


def merged_candidates(stored: DataFrame, found: DataFrame, key: list[str], provenance: list[str]) -> DataFrame:
    """``stored`` candidates after a run ``found`` some: a pair that waits takes the new values and ``provenance``, a decided or retired one stays, new ones come in."""
    values = [c for c in found.columns if c not in key]
    rows = stored.join(found.select(*key, F.struct(*values).alias("_f")), key, "full")
    mine = F.col("status").isNull()
    renew = F.col("_f").isNotNull() & (mine | (F.col("active") & F.col("status").isin(*MACHINE)))
    kept = set(values) | set(provenance)
    out = [F.when(renew, F.col(f"_f.{c}")).otherwise(F.col(c)).alias(c) if c in kept and c in values else F.col(c) for c in stored.columns if c not in key]
    rows = rows.select(*key, *out)
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    return rows.where(~missing).select(*stored.columns)
