"""Taxonomy trees and the climb with confidence back-off (H1-H6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(paths: DataFrame, root: str = "root") -> DataFrame:
    """H2, H5: (node, parent, level) of (grp, category, leaf) rows; a category without leaf is a leaf itself."""
    rows = paths.select(F.explode(F.array(
        F.struct(F.lit(root).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level")),
        F.struct(F.col("grp").alias("node"), F.lit(root).alias("parent"), F.lit(1).alias("level")),
        F.struct(F.col("category").alias("node"), F.col("grp").alias("parent"), F.lit(2).alias("level")),
        F.struct(F.col("leaf").alias("node"), F.col("category").alias("parent"), F.lit(3).alias("level")),
    )).alias("e")).select("e.*")
    return rows.where("node IS NOT NULL").distinct()


def closure(paths: DataFrame, root: str = "root") -> DataFrame:
    """H3, H4: (ancestor, leaf, level, category): every leaf below every node, itself included."""
    leaf = F.coalesce("leaf", "category")
    up = F.array(F.struct(F.lit(root).alias("a"), F.lit(0).alias("l")), F.struct(F.col("grp").alias("a"), F.lit(1).alias("l")), F.struct(F.col("category").alias("a"), F.lit(2).alias("l")), F.struct(F.col("leaf").alias("a"), F.lit(3).alias("l")))
    return paths.select(leaf.alias("leaf"), "category", F.explode(up).alias("x")).select(F.col("x.a").alias("ancestor"), "leaf", F.col("x.l").alias("level"), "category").where("ancestor IS NOT NULL").distinct()


def climb(probs: DataFrame, tree: DataFrame, threshold: float = 0.5, weights: bool = False) -> DataFrame:
    """H1: (query_id, leaf, p) rows -> the node nearest to the best leaf whose leaves reach the threshold, else the root.

    Leaves below the same nodes share a path, named by its first leaf, so that rows stay small; they are dealt by query once:
    for its total (where p are weights instead of shares), for its best leaf, and for the sums of that leaf's nodes alone."""
    node = F.when(F.col("ancestor") != F.col("leaf"), F.col("ancestor"))
    above = tree.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("level", node.alias("node")))).alias("up"))
    paths = above.groupBy("up").agg(F.min("leaf").alias("path"))
    rows = probs.where("query_id IS NOT NULL").join(above.join(paths, "up").select("leaf", "path"), "leaf", "left")
    of = Window.partitionBy("query_id")
    if weights:
        rows = rows.withColumn("p", F.col("p") / F.sum("p").over(of))
    # Highest first: NaN, then numbers, then nulls; of equals the first leaf.
    order = F.coalesce(F.when(F.isnan("p"), F.lit(float("-inf"))).otherwise(-F.col("p")), F.lit(float("inf")))
    best = rows.withColumn("_b", F.min(F.struct(order.alias("o"), "leaf", "path")).over(of)).select("query_id", "leaf", "path", "p", F.col("_b.leaf").alias("best"), F.col("_b.path").alias("best_path"))
    nodes = F.filter(F.transform("up", lambda x: x["node"]), lambda x: x.isNotNull())
    ends = paths.select(F.col("path").alias("best_path"), nodes.alias("nodes"), (F.size(nodes) < F.size("up")).alias("own"))
    name = lambda x: F.coalesce(x["node"], F.col("leaf"))
    common = F.filter("up", lambda x: F.array_contains("nodes", name(x)) | (F.col("own") & (name(x) == F.col("best"))))
    shared = best.join(paths, "path").join(ends, "best_path").select("query_id", "leaf", "best", "p", F.explode(common).alias("n"))
    mass = shared.groupBy("query_id", "best", name(F.col("n")).alias("node"), F.col("n.level").alias("level")).agg(F.round(F.sum("p"), 12).alias("p"))
    stop = F.min_by(F.struct("node", "level", "p"), F.when((F.col("p") >= threshold) | (F.col("level") == 0), -F.col("level")))
    return mass.groupBy("query_id", "best").agg(stop.alias("s")).select("query_id", "best", F.col("s.node").alias("node"), F.col("s.level").alias("level"), F.col("s.p").alias("p"))


def tree(rows: DataFrame, group: str, category: str, leaf: str) -> DataFrame:
    """Per group the number of its categories, and each with its distinct leaves, both in order."""
    leaves = rows.groupBy(group, category).agg(F.array_sort(F.collect_set(leaf)).alias("leaves"))
    return leaves.groupBy(group).agg(F.count(F.lit(1)).alias("n_categories"), F.array_sort(F.collect_list(F.struct(F.col(category).alias("category"), "leaves"))).alias("categories"))
