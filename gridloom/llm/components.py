"""Connected components of a links table: minimum label propagation with pointer jumping, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, materialize, written


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) for every node of `links` (a, b).

    Labels only fall and every round also follows the label's own label, so chains shorten by half or more. Each round
    is written to the shared folder and all but the last deleted; the driver sees one count a round. Aggregations are by partial minimum and joins
    are plain, so a node with very many links is split like any skewed key.
    """
    before = written()
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("heard")), "b").groupBy(F.col("a").alias("node")).agg(F.min("heard").alias("heard"))
        near = labels.join(heard, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialize(near.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        if not new.where("label <> old").limit(1).count():
            discard(links.sparkSession, before, keep=1)
            return new.select("node", "label")
        labels = new.select("node", "label")
