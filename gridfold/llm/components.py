"""Connected components over an edge table, by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import broadcast_if_small, spread_join, written

#: Edges up to which a round's joins are by broadcast.
MOST_BROADCAST = 1_000_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with an edge, ``root`` the smallest node of its component.

    ``edges`` has two long columns ``a`` and ``b``; order, repeats and self-loops don't matter. Each
    round hangs larger neighbours on the smallest one (large star), then each node and its smaller
    neighbours on the smallest (small star), so long chains take a logarithmic number of rounds. Every
    round is written; only one count reaches the driver. No edges: no rows.
    """
    star = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        small = star.count() <= MOST_BROADCAST
        # A node with very many neighbours is a hot key.
        hang = (lambda rows, low: rows.join(F.broadcast(low), "u")) if small else (lambda rows, low: spread_join(rows, low, "u"))
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = hang(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = written(hang(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct())
        several = star.groupBy("u").count().where("count > 1").select("u")
        hanging = star.join(star.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
        if several.union(hanging).isEmpty():
            return star.select(F.col("u").alias("node"), F.col("v").alias("root")).union(star.select(F.col("v"), F.col("v")).distinct())


def merged_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, root)`` after more ``edges`` between nodes of known components; nodes that ``roots`` lacks are their own; written."""
    known = broadcast_if_small(roots)
    own = lambda c: F.coalesce(F.col(f"{c}_root"), F.col(c)).alias(c)
    ends = edges
    for c in ("a", "b"):
        ends = ends.join(known.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    moved = written(connected_components(ends.select(own("a"), own("b"))))
    every = roots.union(moved.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    further = moved.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return written(every.join(broadcast_if_small(further), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
