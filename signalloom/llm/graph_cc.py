"""Connected components of a link table, for the deduplication operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, hot_keys, materialize


def components(links: DataFrame) -> DataFrame:
    """Label every node of ``links`` (a long, b long) with the smallest node it reaches.

    Min-label propagation with pointer jumping: each round a node takes the least label among
    its neighbours' and then that label's own label.  Nodes with very many links and labels of very
    many nodes are dealt over tasks; each round is written to the shared folder.
    Returns (node, comp).  No links: no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = materialize(both.distinct(), "cc-links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp"))
    labels = materialize(labels, "cc-labels")
    hubs = hot_keys(both, "b")
    while True:
        near = hot_join(both, labels.select(F.col("node").alias("b"), "comp"), "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        better = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), (F.col("near") < F.col("comp")).alias("moved"))
        roots = labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        jumped = hot_join(better, roots, "comp", hot_keys(labels, "comp"), "left").select("node", F.least("comp", "root").alias("comp"), (F.col("moved") | (F.col("root") < F.col("comp"))).alias("moved"))
        jumped = materialize(jumped, "cc-labels")
        labels = jumped.select("node", "comp")
        if jumped.where("moved").isEmpty():
            return labels
