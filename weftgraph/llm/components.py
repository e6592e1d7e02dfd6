"""Connected components by repeated contraction, over tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import materialize


def _parents(edges: DataFrame) -> DataFrame:
    """(u, p): for each end u of the contracted edges its root after following smallest neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    parents = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "components-parents")
    while True:  # pointers go to smaller names, so this ends; the depth halves each time
        up = parents.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jumped = materialize(parents.join(up, "p", "left").select("u", F.col("p").alias("old"), F.coalesce("q", "p").alias("p")), "components-jumped")
        if jumped.where("old <> p").isEmpty():
            return jumped.select("u", "p")
        parents = jumped.select("u", "p")


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node that each end of an edge (a, b) can reach.

    ``labels`` are components of earlier edges, which the new edges join; nodes without a row are alone.
    """
    spark = edges.sparkSession
    if labels is None:
        labels = spark.createDataFrame([], "node long, component long")
    while True:
        a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        between = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
        between = materialize(between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components-between")
        if between.isEmpty():
            return labels
        parents = _parents(between)
        moved = labels.join(parents.withColumnRenamed("u", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        # ends that had no label yet are named by themselves
        new = parents.join(labels.select(F.col("node").alias("u")), "u", "left_anti").select(F.col("u").alias("node"), F.col("p").alias("component"))
        labels = materialize(moved.union(new), "components-labels")
