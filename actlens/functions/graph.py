"""Connected components and pointer doubling over tables of 64-bit ids.

Both take a number of joins that grows with the logarithm of the longest
path, not with the path: labels don't travel link by link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.session import materialize


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, parent), whose roots are their own parents; parents are nodes.

    Each round every node takes its parent's parent, so depths halve."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        parents = materialize(parents.join(up, "parent").select(
            "node", F.col("root").alias("parent"), (F.col("root") != F.col("parent")).alias("moved")), "roots")
        if parents.where("moved").isEmpty():
            return parents.select("node", F.col("parent").alias("root"))
        parents = parents.drop("moved")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable through ``links`` (a, b); nodes without links are their own.

    Each round every root hooks onto its smallest neighbour if that is smaller, the trees are flattened by ``roots``,
    and links are drawn anew between the trees that are left; a tree with a link to another never stays alone twice."""
    label = nodes.select("node", F.col("node").alias("component"))
    between = links.select("a", "b")
    while True:
        both = between.where("a <> b")
        both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("b")), "hooks")
        if least.isEmpty():
            return label
        tree = roots(least.select(F.col("a").alias("node"), F.least("a", "b").alias("parent")))
        label = materialize(label.join(tree.select(F.col("node").alias("component"), "root"), "component", "left").select(
            "node", F.coalesce("root", "component").alias("component")), "components")
        side = lambda c: tree.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        between = materialize(between.where("a <> b").join(side("a"), "a").join(side("b"), "b").where("root_a <> root_b").select(
            F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "links")
