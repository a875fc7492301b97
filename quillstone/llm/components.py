"""Connected components by contraction: minimum parents, pointer jumping, and edges between what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, drop


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, root) of every node that an edge touches; root is the smallest node of its component.

    Each round gives every node its smallest neighbour as parent, follows parents to their roots, and keeps the edges
    between different roots, once each; so the edges shrink from round to round, and a dense group is read twice only.
    Nothing but row counts reaches the driver: all joins sort, none sends a side whole. Edges with a null end or equal ends are ignored; no edges give no rows.
    """
    one = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col("a") != F.col("b"))
    left, found = cut(one.distinct(), f"{name}-edges"), None
    if not left.limit(1).count():
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        parents = cut(ends.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), f"{name}-parents")
        while True:
            above = parents.select(F.col("node").alias("root"), F.col("root").alias("next")).hint("merge")
            jumped = cut(parents.join(above, "root").select("node", F.col("root").alias("was"), F.col("next").alias("root")), f"{name}-parents")
            drop(parents)
            moved = jumped.where(F.col("was") != F.col("root")).limit(1).count()
            parents = jumped.select("node", "root")
            parents.cut_path = jumped.cut_path
            if not moved:
                break
        last = found
        if found is None:
            found = parents
        else:
            above = parents.select(F.col("node").alias("root"), F.col("root").alias("next")).hint("merge")
            found = cut(found.join(above, "root", "left").select("node", F.coalesce("next", "root").alias("root")), f"{name}-found")
            drop(last)
        of = lambda end: parents.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")).hint("merge")
        across = left.join(of("a"), "a").join(of("b"), "b").where(F.col("root_a") != F.col("root_b"))
        rest = cut(across.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), f"{name}-edges")
        drop(left)
        left = rest
        if not left.limit(1).count():
            return found
