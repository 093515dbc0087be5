"""Connected components of a link table, without ever gathering it in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import discard, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node.

    Each round a node takes the least label among its neighbours' and hands it to the node whose label
    it had, so whole trees are hooked, not only their rims; then it takes the label of its label.
    Labels only fall, and rounds (some 15 for a chain of 100,000 nodes in any order) go on until none
    does. A round is written to the shared folder, so a lost executor costs that
    round only. Partial aggregation thins out hubs, and joins on a hub's key are inner joins of one
    row against many that adaptive execution may split. Nulls link nothing; self-links give a node
    its own component.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = materialise(ends.union(ends.select("b", "a")).distinct(), "links")
    lows = both.groupBy("a").agg(F.min("b").alias("low"))
    labels = materialise(lows.select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    while True:
        said = labels.select(F.col("node").alias("b"), F.col("component").alias("said"))
        heard = both.join(said, "b").groupBy("a").agg(F.min("said").alias("said"))
        low = labels.join(heard, labels["node"] == heard["a"]).select("node", F.col("component").alias("old"), F.least("component", "said").alias("low"))
        hooked = low.where("low < old").groupBy("old").agg(F.min("low").alias("hook")).withColumnRenamed("old", "h")
        lower = materialise(low.join(hooked, low["node"] == hooked["h"], "left").select("node", "old", F.least("low", "hook").alias("low")), "lows")
        discard(labels)
        root = lower.select(F.col("node").alias("r"), F.col("low").alias("rlow"))
        new = materialise(lower.join(root, lower["low"] == root["r"]).select("node", "old", F.col("rlow").alias("component")), "labels")
        discard(lower)
        labels = new
        if new.where("old <> component").isEmpty():
            discard(both)
            return new.select("node", "component")
