"""Prefix tries over the turns of conversations, built group by group and put together from below."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import BLANKS, split_words
from folio.plans.lineage import store
from folio.plans.sizes import split_join

MOST_TURNS = 4096
"""Turns of distinct conversations that one subtrie may hold before it is dealt again by its next turn."""
BUCKET_TURNS = 16 * MOST_TURNS
"""Turns that the subtries of one bucket hold together, about."""
ID_RANGE = 4096
"""Ids of this many consecutive numbers are joined to one text before a node's ids are hashed."""
NO_IDS = hashlib.sha256(b"").hexdigest()


def turn_lists(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, seq)``: the turns of every conversation in order, each as ``(digest, words)`` of its role and text.

    Null turns come first, equal ones by the MD5 of role and text; null roles and texts are empty, rows without an id are left out, rows that
    repeat are turns of their own. Ids are integers. A turn takes some 30 bytes, a conversation is one row.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.size(split_words(text, BLANKS)).cast("long")
    row = F.struct(F.col(turn_col).alias("turn"), F.md5(role.cast("binary")).alias("role"), F.md5(text.cast("binary")).alias("text"), digest.alias("digest"), words.alias("words"))
    listed = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv"), row.alias("row")).groupBy("conv")
    ordered = F.sort_array(F.collect_list("row"))
    return listed.agg(F.transform(ordered, lambda r: F.struct(r["digest"].alias("digest"), r["words"].alias("words"))).alias("seq"))


def rebuilt(lists: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """``lists`` with the head of every conversation replaced by that of the first id of its block.

    A head is as many turns as the CRC-32 of the decimal id leaves modulo ``most``. A conversation whose block's first id is absent
    loses its own head and gets none.
    """
    heads = lists.where(F.col("conv") % block == 0).select(F.col("conv").alias("of"), F.slice("seq", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    rows = lists.withColumns({"of": F.col("conv") - F.col("conv") % block, "h": h}).join(heads, "of", "left")
    none = F.slice("seq", 1, 0)
    return rows.select("conv", F.concat(F.coalesce(F.slice("head", 1, F.col("h")), none), F.slice("seq", F.col("h") + 1, F.size("seq"))).alias("seq"))


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the pieces of each ``body``, which come together and in order; only the running state is held."""
    body, state = None, None
    for frame in frames:
        done = []
        for key, ids in zip(frame["body"], frame["ids"], strict=True):
            if key != body:
                if state is not None:
                    done.append((body, state.hexdigest()))
                body, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        yield pd.DataFrame(done, columns=["body", "ends"])
    if state is not None:
        yield pd.DataFrame([(body, state.hexdigest())], columns=["body", "ends"])


def distinct_lists(lists: DataFrame) -> DataFrame:
    """``(seq, n, conv, ends)``: each distinct list of turns with its conversations' number, least id and the hash of their ids.

    Copies meet before the shuffle, so thousands of them are one row a task. Ids are joined by ranges of ``ID_RANGE`` numbers, also
    before the shuffle's last step; the pieces of one list stream through a hash, since SHA-256 has to read them in order.
    """
    keyed = store(lists.withColumn("body", F.md5(F.array_join(F.transform("seq", lambda t: F.hex(t["digest"])), "").cast("binary"))), "turn-lists")
    same = keyed.groupBy("body").agg(F.min_by("seq", "conv").alias("seq"), F.count("*").alias("n"), F.min("conv").alias("conv"))
    ranges = keyed.groupBy("body", F.expr(f"conv div {ID_RANGE}").alias("range")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    pieces = ranges.select("body", "range", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    ends = pieces.repartition("body").sortWithinPartitions("body", "range").select("body", "ids").mapInPandas(_hashed, "body string, ends string")
    return same.join(ends, "body").select("seq", "n", "conv", "ends")


@dataclass
class Node:
    """One prefix: its members, the words of its last turn, and what its subtree adds up to."""

    words: int
    conv: int | None = None
    n: int = 0
    ends: str = NO_IDS
    leaves: int = 0
    saved: int = 0
    next: dict[bytes, Node] = field(default_factory=dict)


def build(lists: list[tuple[list[tuple[bytes, int]], int, int, str]]) -> Node:
    """The trie of ``(turns, n, conv, ends)`` lists under a textless top, summed up from the leaves without recursion."""
    top = Node(0)
    for turns, n, conv, ends in lists:
        node = top
        for digest, words in [(b"", 0), *turns]:
            if digest:
                node = node.next.setdefault(digest, Node(words))
            node.n += n
            node.conv = conv if node.conv is None else min(node.conv, conv)
        node.ends = ends
    order, waiting = [], [top]
    while waiting:
        order.append(node := waiting.pop())
        waiting.extend(node.next.values())
    for node in reversed(order):
        below = node.next.values()
        node.leaves = sum(c.leaves for c in below) or 1
        node.saved = sum(c.saved for c in below) + (node.n - 1) * node.words
    return top


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"


def _subtries(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of a bucket's subtries. Each hangs on a node ``(base, parent)`` above, which gets no row here; ``top`` marks those next to it."""
    found = []
    for (base, parent), part in rows.groupby(["base", "parent"], sort=False):
        turns = [[(bytes(t["digest"]), int(t["words"])) for t in seq[base:]] for seq in part["seq"]]
        top = build(list(zip(turns, part["n"], part["conv"], part["ends"], strict=True)))
        waiting = [(c, base + 1, parent) for c in top.next.values()]
        while waiting:
            node, depth, above = waiting.pop()
            found.append((node.conv, depth, above, node.n, len(node.next), node.leaves, node.saved, node.ends, depth == base + 1))
            waiting.extend((c, depth + 1, node.conv) for c in node.next.values())
    return pd.DataFrame(found, columns=[c.split()[0] for c in NODES.split(", ")])


def _shared(rows: Column, other: Column) -> Column:
    """How many leading turns two lists have in common."""
    least = F.least(F.size(rows), F.size(other))
    differ = F.transform(F.arrays_zip(F.slice(rows, 1, least).alias("a"), F.slice(other, 1, least).alias("b")), lambda p: p["a"]["digest"] != p["b"]["digest"])
    at = F.array_position(differ, True)
    return F.when(at > 0, at - 1).otherwise(least).cast("int")


def prefix_trie(lists: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """One row for every distinct prefix of the ``(conv, seq)`` lists of turns, the root included.

    ``conv_id`` is the least member, ``parent_conv_id`` that of the prefix one turn shorter; with ``depth`` they name a node and its
    parent. ``n_convs`` counts members, ``n_children`` the nodes one deeper, ``n_leaves`` the childless nodes of the subtree,
    ``saved_tokens`` the words that members need not repeat, ``ends_sha256`` hashes the ids that end here. No list gives no row; lists
    without turns are members of the root.

    Equal lists become one row first. Subtries are dealt by a hash of their first turn and built in buckets. One of over
    ``most_turns`` turns, however few first turns there are, is not built at once: the turns that all its lists share become a stem of
    nodes without branches, and its lists are dealt again by the turn behind the stem. Each such round ends at a branching, so equal
    openings of any length take one. Stems are put together from below by sums over their branches.
    """
    spark = lists.sparkSession
    rows = store(distinct_lists(lists).withColumn("base", F.lit(0)), "distinct-lists")
    whole = rows.agg(F.sum("n").alias("n"), F.min("conv").alias("conv")).first()
    if not whole["n"]:
        return spark.createDataFrame([], NODES).drop("top")
    # stems: (base, parent) they hang on, their last depth, members, least member, turns, ends of the last node; the root is one without turns
    ended = rows.where(F.size("seq") == 0).agg(F.max("ends").alias("ends"))
    root = ended.select(
        F.lit(-1).alias("base"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("last"), F.lit(whole["n"]).alias("n"),
        F.lit(whole["conv"]).alias("conv"), F.array().cast("array<struct<digest:binary,words:bigint>>").alias("stem"), "ends",
    )
    stems, built = [root], []
    open_rows = rows.where(F.size("seq") > 0).withColumn("parent", F.lit(whole["conv"]))
    while True:
        open_rows = open_rows.withColumn("next", F.element_at("seq", F.col("base") + 1)["digest"])
        on = ["base", "parent", "next"]
        sizes = open_rows.groupBy(*on).agg(F.sum(F.size("seq") - F.col("base")).alias("turns"), F.count("*").alias("kinds"), F.sum("n").alias("members"), F.min("conv").alias("least"))
        sizes = store(sizes, "subtries")
        large = (F.col("turns") > most_turns) & (F.col("kinds") > 1)
        total = sizes.agg(F.sum(F.when(~large, F.col("turns"))).alias("left"), F.count(F.when(large, 1)).alias("large")).first()
        buckets = 1 + (total["left"] or 0) // BUCKET_TURNS
        hot = sizes.where(large)
        left = open_rows.join(hot.select(*on), on, "left_anti") if total["large"] else open_rows
        slim = left.select(F.pmod(F.xxhash64(*on), F.lit(buckets)).alias("bucket"), "base", "parent", "seq", "n", "conv", "ends")
        built.append(store(slim.groupBy("bucket").applyInPandas(_subtries, NODES), "subtries-built"))
        if not total["large"]:
            break
        dealt = store(split_join(open_rows, hot, on, "kinds"), "subtries-large")
        model = dealt.groupBy(*on).agg(F.min_by("seq", "conv").alias("model"), F.first("kinds").alias("kinds"))
        dealt = split_join(dealt.drop("kinds"), model, on, "kinds").withColumn("_same", _shared(F.col("seq"), F.col("model")))
        stem = dealt.groupBy(*on).agg(F.min("_same").alias("last"), F.first("members").alias("n"), F.first("least").alias("conv"), F.first("model").alias("model"), F.first("kinds").alias("kinds"))
        dealt = store(split_join(dealt.drop("kinds", "model"), stem.select(*on, "last", "kinds"), on, "kinds"), "subtries-dealt")
        over = dealt.where(F.size("seq") == F.col("last")).groupBy(*on).agg(F.max("ends").alias("ends"))
        stem = stem.withColumn("stem", F.slice("model", F.col("base") + 1, F.col("last") - F.col("base"))).join(over, on, "left")
        stems.append(store(stem.select("base", "parent", "last", "n", "conv", "stem", "ends"), "stems"))
        deeper = dealt.where(F.size("seq") > F.col("last"))
        open_rows = deeper.select("seq", "n", "conv", "ends", F.col("last").cast("int").alias("base"), F.col("least").alias("parent"))
    tops = built[-1]  # subtries that hang on the last round's stems
    out = list(built)
    for at in range(len(stems) - 1, -1, -1):
        below = tops.where("top").groupBy(F.col("parent_conv_id").alias("conv"), (F.col("depth") - 1).alias("last")).agg(
            F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below")
        )
        joined = stems[at].withColumn("last", F.col("last").cast("long")).join(below, ["conv", "last"], "left")
        nodes = store(_stem_nodes(joined), "stem-nodes")
        out.append(nodes)
        if at:
            tops = built[at - 1].unionByName(nodes)
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result.drop("top")


def _stem_nodes(stems: DataFrame) -> DataFrame:
    """The nodes of stems whose branches are summed up; ``top`` marks those that hang on an earlier stem."""
    n, last, size = F.col("n"), F.col("last"), F.size("stem")
    stem = F.when(size > 0, F.col("stem")).otherwise(F.array(F.struct(F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("words"))))
    rows = stems.select("*", F.posexplode(stem).alias("_at", "_turn"))
    rest = F.aggregate(F.slice(stem, F.col("_at") + 1, F.size(stem)), F.lit(0).cast("long"), lambda s, t: s + t["words"])
    end = F.col("_at") + 1 == F.size(stem)
    depth = last - F.size(stem) + F.col("_at") + 1
    return rows.select(
        F.col("conv").alias("conv_id"), depth.alias("depth"),
        F.when(F.col("_at") == 0, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), n.alias("n_convs"),
        F.when(end, F.coalesce("children", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (F.coalesce("below", F.lit(0)) + (n - 1) * rest).alias("saved_tokens"),
        F.when(end, F.coalesce("ends", F.lit(NO_IDS))).otherwise(F.lit(NO_IDS)).alias("ends_sha256"), (F.col("_at") == 0).alias("top"),
    )
