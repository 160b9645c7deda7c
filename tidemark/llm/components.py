"""Connected components of a link table, by minimum labels and pointer jumping; nothing gathers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """links (a, b), both long, in any direction: node, label (a written table): every node that has a link, with the smallest of its component.

    Each round a node takes the smallest label among itself and its neighbours, then its label's label. Hubs are no
    problem: minima are partially aggregated, and Spark splits a skewed side of the join.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = label.join(near, label["node"] == near["a"], "left").select("node", F.least("label", F.coalesce("m", "label")).alias("n"), F.col("label").alias("old"))
        jump = label.select(F.col("node").alias("n"), F.col("label").alias("further"))
        new = materialize(step.join(jump, "n", "left").select("node", F.least("n", F.coalesce("further", "n")).alias("label"), "old"), "labels")
        changed = new.where("label <> old").count()
        discard(label)
        label = new
        if not changed:
            discard(both)
            return label
