"""Connected components of an edge table by repeated contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from halocline.llm.frames import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node that has an edge, with the smallest node it can reach. Edges are (u, v) of longs, in any order.

    Each round points every node at the smallest of its neighbours and itself, follows pointers until they end in
    roots, and replaces edges by edges between roots. Groups are only reduced by min, so a node with very many edges
    is pre-aggregated; the number of rounds is logarithmic in the longest path.
    """
    edges = kept(edges.select("u", "v").filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        jump = kept(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "jump")
        while True:
            up = jump.select(F.col("node").alias("root"), F.col("root").alias("above"))
            far = kept(jump.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "jump")
            jump = far.select("node", "root")
            if far.filter("moved").isEmpty():
                break
        if labels is None:
            labels = jump
        else:
            step = jump.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = kept(labels.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels")
        a, b = (jump.select(F.col("node").alias(c), F.col("root").alias(r)) for c, r in (("u", "ru"), ("v", "rv")))
        edges = kept(edges.join(a, "u").join(b, "v").filter("ru != rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        if edges.isEmpty():
            return labels
