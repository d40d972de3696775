"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that can be reached, for each node of ``links(a, b)``.

    Each round takes the smallest label of a node's neighbours and then the label of its label, so chains
    shorten by half; every round is a written table. No links give no rows; loops and repeated links are
    harmless; links with a null end are ignored.
    """
    links = links.where(F.col("a") != F.col("b"))
    both = scratch.written(links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select("b", "a")).distinct(), "links")
    labels = scratch.written(both.groupBy("node").agg(F.least(F.first("node"), F.min("near")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("near"), "label"), "near").groupBy("node").agg(F.min("label").alias("found"))
        best = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "found").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = scratch.written(best.join(up, "label").select("node", F.least("label", "above").alias("label"), (F.least("label", "above") < F.col("before")).alias("changed")), "labels")
        scratch.discard(labels)
        labels = new
        if new.where("changed").isEmpty():
            return new.select("node", "label")
