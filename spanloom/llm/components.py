"""Connected components of a link table, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, label)`` for every id of ``links(a, b)``; label is the smallest id reachable.

    Each round takes the least label among neighbours and then the label of
    that label, so chains shrink by doubling. Hubs only ever meet partial
    aggregates or joins that adaptive execution may split. Labels only fall, so the
    rounds end by themselves.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    both = scratch.save(both.distinct(), "edges")
    labels = scratch.save(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("m"))
        step = labels.join(near, "id", "left").select("id", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = scratch.save(step.join(up, "label", "left").select("id", "was", F.least("label", "up").alias("label")), "labels")
        changed = new.where("label <> was").limit(1).count()
        scratch.drop(labels)
        labels = new.select("id", "label")
        labels._scratch_path = new._scratch_path
        if not changed:
            scratch.drop(both)
            return labels
