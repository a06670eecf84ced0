"""Whether a taxonomy has cycles, and which of its nodes lie on or between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.plans.lineage import store


def _hanging(edges: DataFrame) -> DataFrame:
    """Nodes of ``(u, v)`` edges that hang on a node without parents by single parents alone, through any length, or so on one without children.

    Each node with one parent points at it, each with one child at that; pointers are doubled until none moves on, which takes as many steps as the
    longest chain has digits. A pointer that moves for longer goes round a cycle.
    """
    both = edges.select(F.lit("up").alias("d"), F.col("v").alias("n"), F.col("u").alias("p")).unionByName(edges.select(F.lit("down").alias("d"), F.col("u").alias("n"), F.col("v").alias("p")))
    near = store(both.groupBy("d", "n").agg(F.count("*").alias("k"), F.min("p").alias("p")), "neighbours")
    starts = store(both.select("d", F.col("p").alias("n")).distinct().join(near.select("d", "n"), ["d", "n"], "left_anti"), "ends")
    pointers = store(near.where("k = 1").select("d", "n", "p"), "pointers")
    left = pointers.count()
    while left:
        ahead = pointers.select("d", F.col("n").alias("p"), F.col("p").alias("q"))
        moved = store(pointers.join(ahead, ["d", "p"], "left").select("d", "n", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "pointers")
        pointers = moved.drop("moved")
        left = 0 if moved.where("moved").isEmpty() else left >> 1
    return pointers.join(starts.select("d", F.col("n").alias("p")), ["d", "p"], "left_semi").select("n").unionByName(starts.select("n")).distinct()


def cyclic(edges: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """``(parent, child)`` edges of a taxonomy that lie on a cycle or between two; none if it has no cycle.

    Edges that hold a null are ignored, repeated ones count once, a node that is its own parent is a cycle. Nodes without parents, or without
    children, can be on no cycle: they go, with all that hang on them by single steps, so a chain of any length goes in one round by
    pointer doubling. What is left when nothing goes any more has a parent and a child left for each node.
    """
    left = store(edges.select(F.col(parent).alias("u"), F.col(child).alias("v")).where("u is not null and v is not null").distinct(), "taxonomy")
    count = left.count()
    while count:
        free = store(_hanging(left), "acyclic-nodes")
        rest = left.join(free.select(F.col("n").alias("u")), "u", "left_anti").join(free.select(F.col("n").alias("v")), "v", "left_anti")
        left = store(rest.select("u", "v"), "taxonomy")
        now = left.count()
        if now == count:
            break
        count = now
    return left.select(F.col("u").alias(parent), F.col("v").alias(child))


def unknown_codes(nodes: DataFrame, edges: DataFrame, code: str = "code", parent: str = "parent", child: str = "child") -> DataFrame:
    """``(code)`` that edges name and ``nodes`` lack."""
    named = edges.select(F.explode(F.array(parent, child)).alias(code)).where(F.col(code).isNotNull()).distinct()
    return named.join(nodes.select(code), code, "left_anti")
