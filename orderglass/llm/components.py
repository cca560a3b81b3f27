"""Connected components of a graph given by its edges, by contraction; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderglass.session import stage


def relabelled(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges (a, b) between different roots, once each, the smaller root first."""
    tops = [roots.select(F.col("node").alias(f"of_{side}"), F.col("root").alias(f"top_{side}")) for side in "ab"]
    met = edges.select("a", "b").join(tops[0], F.col("a") == F.col("of_a"), "left").join(tops[1], F.col("b") == F.col("of_b"), "left")
    a, b = F.coalesce("top_a", "a"), F.coalesce("top_b", "b")
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct()


def refined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of the components of ``roots`` after ``edges`` join some; nodes may be new."""
    between = stage(relabelled(edges, roots), "edges")
    above = connected_components(between).select(F.col("node").alias("was"), F.col("root").alias("now"))
    named = roots.join(above, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
    fresh = above.join(roots, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("root"))
    return stage(named.unionAll(fresh), "roots")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node it can reach.

    In a round every node hooks onto the smallest of its smaller neighbours, which gives one edge per node whatever
    its degree; these trees are flattened by pointer jumping. Only edges between different trees go on, as edges
    between their roots, once each. A star, however large, is done in one round.
    """
    rest = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
    nodes = rest.select(F.col("a").alias("node")).unionAll(rest.select(F.col("b").alias("node"))).distinct()
    roots = stage(nodes.select("node", F.col("node").alias("root")), "roots")
    while rest.limit(1).count():
        # Minima are combined before they are shuffled.
        trees = stage(rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "trees")
        while True:
            up = trees.select(F.col("node").alias("above"), F.col("root").alias("top"))
            jumped = trees.join(up, F.col("root") == F.col("above"), "left")
            trees = stage(jumped.select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "trees")
            moved, trees = trees.filter("moved").limit(1).count(), trees.select("node", "root")
            if not moved:
                break
        up = trees.select(F.col("node").alias("was"), F.col("root").alias("now"))
        roots = stage(roots.join(up, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root")), "roots")
        rest = stage(relabelled(rest, trees), "edges")
    return roots
