"""Connected components of an edge table, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import discard, hot_join, hot_keys, written


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node reachable, for every node of ``edges`` (a, b).

    In each round a node and the node that it is labelled by take the least
    label among the node's neighbours, and then their label's own label, so
    whole trees are hooked and paths halve: rounds grow with the logarithm of
    the nodes.  Every round is written to the shared folder, so lineage stays
    short.  Labels only fall, so a round without change is the last.  Rows of
    a hub are not gathered in a task.
    """
    one = edges.select("a", "b").where("a <> b")
    both = written(one.union(one.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    hubs, nodes = hot_keys(both, "b", both.count()), labels.count()
    while True:
        near = hot_join(both, labels.toDF("b", "label"), "b", hubs).groupBy("a").agg(F.min("label").alias("near"))
        low = written(labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("near")))
        hooked = low.groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hooked"))
        new = written(low.join(hooked, "node", "left").select("node", F.col("label").alias("old"), F.least("near", "hooked").alias("low")))
        to = new.select(F.col("node").alias("low"), F.col("low").alias("label"))
        last, labels = labels, written(hot_join(new, to, "low", hot_keys(new, "low", nodes)).select("node", "old", "label"))
        done = labels.where("old <> label").isEmpty()
        discard(last, low, new)
        path, labels = labels._tabkit_path, labels.select("node", "label")
        labels._tabkit_path = path
        if done:
            discard(both)
            return labels
