"""Near duplicates through an LSH forest: signature orders whose regions are cut as deep as their sizes ask."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.plans.components import components
from folio.plans.lineage import store
from folio.plans.sizes import small, split_join

WIDTH = 5
LEAST_PERCENT = 85
VALUES = 96
"""Values of a signature."""
ORDERS = 24
"""Orders of the forest; each begins elsewhere in the signature and goes round it."""
DEPTHS = (2, 3, 4, 6, 8, 12, 16, 24, 48, VALUES)
"""Lengths of the common prefix at which regions are cut; the first finds a pair at the threshold in some order but for one in 10**13."""
REGION = 32
"""Texts of a region up to which it is not cut any deeper."""
LEAST_ALIKE = 60
"""Values that agree in the signatures of a pair that is compared in full: six deviations below the mean at the threshold."""
BUCKETS = 512
"""Ranges of hashes that a set's profile counts, a power of two."""

MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_draw = np.random.Generator(np.random.PCG64(11))
FACTORS = _draw.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _draw.integers(0, 1 << 63, VALUES, dtype=np.uint64)
PLACES = _draw.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h + MIX[0]
    h = (h ^ (h >> np.uint64(30))) * MIX[1]
    h = (h ^ (h >> np.uint64(27))) * MIX[2]
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes.

    Words are runs without blanks, A-Z lower-cased. ``WIDTH`` of them are a shingle, fewer words one of their own, no words none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    held = np.empty(len(words), dtype=object)
    held[:] = words
    h = pd.util.hash_array(held, categorize=False)
    width = min(WIDTH, len(words))
    whole = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        whole += h[i : len(h) - width + 1 + i] * PLACES[i]
    return np.unique(_mixed(whole))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of the least values of ``VALUES`` linear maps of a set that is not empty."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[at : at + 4096, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("sig", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(SKETCH)
def _sketched(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(t) for t in texts]
    return pd.DataFrame({"n": [len(s) for s in sets], "sig": [signature(s) if len(s) else np.empty(0, np.int32) for s in sets]})


@F.pandas_udf(T.BinaryType())
def _low_bytes(sigs: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(s, dtype=np.int32).astype(np.uint8).tobytes() for s in sigs])


def _prefix(depth: int) -> Column:
    """A hash of the first ``depth`` values of the signature in the order ``t``."""
    twice = F.concat("sig", "sig")
    return F.xxhash64("t", F.slice(twice, F.col("t") * (VALUES // ORDERS) + 1, depth))


def _behind(depth: int) -> Column:
    """The value behind that prefix."""
    return F.element_at("sig", ((F.col("t") * (VALUES // ORDERS) + depth) % VALUES + 1).cast("int"))


def forest(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions of stored ``(node, sig)`` texts: ``(key, behind, node)`` of those with up to ``REGION`` members, and twice ``(key, node)`` of the rest.

    A region holds the texts that share a prefix of one order; it is cut by longer prefixes while it has more members. Texts alone in
    theirs drop out. Regions that even whole signatures leave too large are the second result, the same ones in all orders. The third
    are the regions that were cut, as they were before: cuts part pairs, and ``parted`` finds those again.
    Rows are counted with map-side combining and only regions known to be small are ever gathered.
    """
    rows = texts.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("t"))
    done = cut = None
    for depth in DEPTHS:
        keyed = store(rows.select("node", "t", _prefix(depth).alias("key"), _behind(depth).alias("behind")), "orders")
        sizes = store(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "regions")
        few = keyed.join(small(sizes.where(F.col("n") <= REGION).select("key")), "key").select("key", "behind", "node")
        done = few if done is None else done.unionByName(few)
        over = sizes.where(F.col("n") > REGION)
        if over.isEmpty():
            none = keyed.select("key", "node").limit(0)
            return done, none, none if cut is None else cut
        left = store(split_join(keyed, over, ["key"], "n").select("key", "node", "t"), "orders-left")
        cut = left.select("key", "node") if cut is None else cut
        if depth == DEPTHS[-1]:
            return done, left.where("t = 0").select("key", "node"), cut
        rows = left.select("node", "t").join(texts, "node")
    raise AssertionError("the last depth returns")


PAIRS = "u long, v long"


def _alike(regions: Iterator[pd.DataFrame], chained: bool) -> Iterator[pd.DataFrame]:
    """Pairs of a region's neighbours, or of all its members of different classes, whose sizes and signatures allow a link."""
    for frame in regions:
        found = [np.empty((0, 2), dtype=np.int64)]
        for nodes, sizes, classes, low in zip(frame["node"], frame["n"], frame["root"], frame["low"], strict=True):
            nodes, sizes, classes = (np.asarray(x, dtype=np.int64) for x in (nodes, sizes, classes))
            low = np.frombuffer(b"".join(low), dtype=np.uint8).reshape(len(nodes), VALUES)
            a, b = (np.arange(len(nodes) - 1), np.arange(1, len(nodes))) if chained else np.triu_indices(len(nodes), 1)
            a, b = (x[classes[a] != classes[b]] for x in (a, b))
            fit = 100 * np.minimum(sizes[a], sizes[b]) >= LEAST_PERCENT * np.maximum(sizes[a], sizes[b])
            fit[fit] = (low[a[fit]] == low[b[fit]]).sum(axis=1) >= LEAST_ALIKE
            u, v = nodes[a[fit]], nodes[b[fit]]
            found.append(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1))
        yield pd.DataFrame(np.concatenate(found), columns=["u", "v"])


def _met(regions: DataFrame, texts: DataFrame, roots: DataFrame | None, chained: bool) -> DataFrame:
    rows = regions.join(texts.select("node", "n", "low"), "node")
    root = F.col("node")
    if roots is not None:
        rows, root = rows.join(roots, "node", "left"), F.coalesce("root", "node")
    member = F.struct("behind", "node", "n", root.alias("root"), "low")
    grouped = rows.groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("m"))
    lists = grouped.where(F.size(F.array_distinct("m.root")) > 1).select(*[F.col(f"m.{c}").alias(c) for c in ("node", "n", "root", "low")])
    return lists.mapInPandas(lambda frames: _alike(frames, chained), PAIRS).distinct()


def profile(shingles: np.ndarray) -> bytes:
    """How many shingles of a set lie in each of ``BUCKETS`` ranges of their hashes; empty if one holds more than a byte can say."""
    n = np.bincount((shingles >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), minlength=BUCKETS)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


def may_link(first: pd.Series, second: pd.Series) -> pd.Series:
    """Whether two sets can be alike enough by their profiles: they share at most the lesser number in each range. Sets without a profile can."""
    may = (first.str.len() == BUCKETS) & (second.str.len() == BUCKETS)
    a, b = (np.frombuffer(b"".join(x[may]), np.uint8).reshape(-1, BUCKETS) for x in (first, second))
    both = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    fits = 100 * both >= LEAST_PERCENT * (a.sum(axis=1, dtype=np.int64) + b.sum(axis=1, dtype=np.int64) - both)
    out = np.ones(len(first), dtype=bool)
    out[may.to_numpy()] = fits
    return pd.Series(out)


_may_link = F.pandas_udf(may_link, T.BooleanType())


@F.pandas_udf(T.StructType([T.StructField("s", T.BinaryType()), T.StructField("profile", T.BinaryType())]))
def _coded(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(t) for t in texts]
    return pd.DataFrame({"s": [s.tobytes() for s in sets], "profile": [profile(s) for s in sets]})


def _confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        keep = []
        for first, second in zip(frame["first"], frame["second"], strict=True):
            a, b = np.frombuffer(first, np.uint64), np.frombuffer(second, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= LEAST_PERCENT * (len(a) + len(b) - both))
        yield frame.loc[keep, ["u", "v"]]


def _held(nodes: DataFrame, texts: DataFrame, bodies: DataFrame) -> DataFrame:
    """``(node, text)`` of some nodes."""
    wanted = nodes.join(texts.select("node", "body", "first"), "node")
    met = bodies.alias("b").join(small(wanted).alias("w"), (F.col("b.body") == F.col("w.body")) & F.col("b.id").eqNullSafe(F.col("w.first")))
    return met.groupBy("node").agg(F.first("text").alias("text"))


def confirmed(pairs: DataFrame, texts: DataFrame, bodies: DataFrame) -> DataFrame:
    """The ``(u, v)`` pairs whose whole texts have sets alike enough. Only texts of some pair are read beyond their hash.

    Profiles of the sets, of one size whatever the texts', come first: only pairs that these allow carry both sets.
    """
    pairs = store(pairs, "candidates")
    held = _held(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), texts, bodies)
    held = store(held.select("node", _coded("text").alias("c")).select("node", "c.s", "c.profile"), "candidate-sets")
    side = lambda end, c, name: held.select(F.col("node").alias(end), F.col(c).alias(name))
    both = pairs.join(side("u", "profile", "_a"), "u").join(side("v", "profile", "_b"), "v")
    near = store(both.where(_may_link("_a", "_b")).select("u", "v"), "near-candidates")
    sides = near.join(side("u", "s", "first"), "u").join(side("v", "s", "second"), "v")
    return store(sides.select("u", "v", "first", "second").mapInPandas(_confirm, PAIRS), "links")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).view(np.int64) for t in texts])


@F.pandas_udf(T.IntegerType())
def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum()) for x, y in zip(a, b, strict=True)], dtype="int32")


def parted(cut: DataFrame, texts: DataFrame, bodies: DataFrame, roots: DataFrame) -> DataFrame:
    """All ``(u, v)`` candidates between texts of different classes in the stored regions ``(key, node)`` that were cut.

    Exact, whatever the regions' sizes: sets that are alike enough share one of their rarest shingles, so many as may be missing and one
    more, and those are joined. Rarity is counted over the texts of these regions. Pairs are made of classes first and of their members
    then, so a crowd in one class makes none; none is dropped but by sizes or signatures.
    """
    placed = cut.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where("a <> b").select("key", "n")
    nodes = store(split_join(cut, store(mixed, "mixed-regions"), ["key"], "n").select("node").distinct(), "parted-texts")
    held = _held(nodes, texts, bodies).select("node", _shingles("text").alias("s"))
    rows = store(held.select("node", F.size("s").alias("n"), F.explode("s").alias("s")), "parted-shingles")
    rarity = store(rows.groupBy("s").agg(F.count("*").alias("held_by")), "rarity")
    ranked = split_join(rows, rarity, ["s"], "held_by")
    ranked = ranked.withColumn("_at", F.row_number().over(Window.partitionBy("node").orderBy("held_by", "s")))
    least = F.ceil(F.col("n") * LEAST_PERCENT / 100)
    rare = ranked.where((F.col("_at") <= F.col("n") - least + 1) & (F.col("held_by") > 1)).select("s", "node", "n")
    rare = store(rare.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rare-shingles")
    classes = rare.select("s", "root").distinct()
    met = classes.withColumnRenamed("root", "a").join(classes.withColumnRenamed("root", "b"), "s").where("a < b")
    side = lambda c: rare.select("s", F.col("root").alias(c), F.col("node").alias(f"{c}_node"), F.col("n").alias(f"{c}_n"))
    pairs = met.join(side("a"), ["s", "a"]).join(side("b"), ["s", "b"])
    pairs = pairs.where(100 * F.least("a_n", "b_n") >= LEAST_PERCENT * F.greatest("a_n", "b_n"))
    pairs = pairs.select(F.greatest("a_node", "b_node").alias("u"), F.least("a_node", "b_node").alias("v")).distinct()
    low = lambda c: texts.select(F.col("node").alias(c), F.col("low").alias(f"{c}_low"))
    return pairs.join(low("u"), "u").join(low("v"), "v").where(_agreeing("u_low", "v_low") >= LEAST_ALIKE).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)``, one row for every row of ``docs``.

    Rows whose sets of shingles overlap by ``LEAST_PERCENT`` of their union are linked; ``component_id`` is the least id that links
    reach, ``kept`` that it is the row's own. Rows without words are linked with nothing. Null ids are never least beside another.
    Rows that repeat an id with other words are texts of their own. Other columns are not read. An empty table gives no row.

    Equal texts are one node from the start. The forest's neighbours in their regions are compared in full first and give classes;
    then all pairs of a region that are still in different classes. A crowd of near copies is thus linked by some pairs a member and never
    pair by pair. Texts with one and the same signature, too many for a region, are compared with the first of them, and those that it
    does not link with all others. Last come the pairs that the cuts of crowded regions parted and that are still in different classes
    (``parted``). No pair is dropped but by its sizes or by signatures that agree in under ``LEAST_ALIKE`` values.
    """
    bodies = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.md5(F.col(text_col).cast("binary")).alias("body"))
    rows = bodies.select("id", "body", _sketched("text").alias("s")).select("id", "body", F.col("s.n").alias("n"), F.col("s.sig").alias("sig"))
    rows = store(rows, "signatures")
    texts = rows.where("n > 0").groupBy("body").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # numbers of rows differ from run to run; written once, they are the nodes of all that follows
    texts = store(texts.withColumns({"node": F.monotonically_increasing_id(), "low": _low_bytes("sig")}), "distinct-texts")
    regions, crowds, cut = forest(texts.select("node", "sig"))
    regions, crowds = store(regions, "leaf-regions"), store(crowds, "crowds")

    heads = crowds.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("n"))
    stars = split_join(crowds, heads, ["key"], "n").where("node <> v").select(F.col("node").alias("u"), "v")
    links = confirmed(_met(regions, texts, None, True).unionByName(stars).distinct(), texts, bodies)
    roots = store(components(links), "first-classes")

    pairs = _met(regions, texts, roots, False)
    placed = crowds.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = store(placed, "crowd-classes")
    of_head = placed.groupBy("key").agg(F.min_by("root", "node").alias("_head"), F.count("*").alias("n"))
    odd = split_join(placed, of_head, ["key"], "n").where(F.col("root") != F.col("_head"))
    odd = odd.select("key", F.col("node").alias("a"), F.col("root").alias("_root"))
    rest = placed.join(small(odd), "key").where(F.col("root") != F.col("_root"))
    rest = rest.select(F.greatest("a", "node").alias("u"), F.least("a", "node").alias("v"))
    more = confirmed(pairs.unionByName(rest).distinct(), texts, bodies)
    # the first classes stand for the links that made them
    joined = lambda links: store(components(links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))), "classes")
    if not more.isEmpty():
        roots = joined(more)
    last = None if cut.isEmpty() else confirmed(parted(cut, texts, bodies, roots), texts, bodies)
    if last is not None and not last.isEmpty():
        roots = joined(last)

    classes = texts.select("body", "node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = store(classes, "texts-of-classes")
    sizes = rows.where("n > 0").groupBy("body").agg(F.count("*").alias("copies"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select("body", "component_id").join(sizes, "body")
    full, none = rows.where("n > 0").select("id", "body", "n"), rows.where("n = 0").select("id", "n")
    full = split_join(full, named, ["body"], "copies").select("id", "n", "component_id")
    out = full.unionByName(none.withColumn("component_id", F.col("id")))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
