"""Connected components of an edge table.

Defined results: an edge with a null end or of a node with itself joins nothing; repeated and turned edges count once; an
empty table has no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import kept


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of all ends of (a, b) edges; the component is its smallest node.

    Each round a node takes the smallest label among its own and its neighbours', then its label's label; rounds grow
    with the logarithm of a component's diameter.  Labels are written to the shared folder each round, and sums by node
    are formed before the shuffle, so a node with very many edges is no hot spot."""
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), name)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        taken = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("further"))
        new = kept(taken.join(jump, taken.component == jump.via, "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")), name)
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels
