"""Connected components by smallest label, in rounds of joins whose tables are written between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleepsignal.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node of the component.

    A round gives each node the smallest label among its neighbours and itself, then the label of that label;
    paths shrink by half or better, so a component of diameter d takes about log2 d rounds. Edges inside one
    component are dropped as soon as their ends agree. Nodes must be comparable and not null.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    pairs = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = pairs.join(labels, pairs["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        new = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("root", F.coalesce("near", "root")).alias("low"), F.col("root").alias("was"))
        new = cut(new)
        up = new.select(F.col("node").alias("_n"), F.col("low").alias("_up"))
        jumped = new.join(up, new["low"] == up["_n"], "left").select("node", F.least("low", F.coalesce("_up", "low")).alias("root"), "was")
        labels = cut(jumped)
        if labels.filter("root <> was").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
