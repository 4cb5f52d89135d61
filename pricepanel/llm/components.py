"""Connected components of a link table by minimum labels with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for the nodes of ``links(a, b)``; the label is the smallest node reachable.

    Minima are taken before the shuffle and both sides of each join are plain tables, so a hub's links are split over
    tasks. Labels only fall; the rounds end when none does, in a number that grows with the logarithm of the diameter.
    """
    both = written(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        met = written(labels.join(heard, F.col("node") == F.col("a")).select("node", "label", F.least("label", "heard").alias("met")), "labels")
        further = met.select(F.col("node").alias("via"), F.col("met").alias("beyond"))
        after = written(met.join(further, F.col("met") == F.col("via")).select("node", "label", F.least("met", "beyond").alias("next")), "labels")
        moved = after.where("next <> label").limit(1).count()
        labels = after.select("node", F.col("next").alias("label"))
        if not moved:
            return labels
