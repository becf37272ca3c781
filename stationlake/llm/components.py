"""Connected components of a link table, as Spark jobs over labels kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.session import stored


def connected(links: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Rows (node, component) for every node of the links; a component is its smallest node.

    Each round gives a node the smallest label among its own, its neighbours' and its label's
    label, so distances are about halved; the loop ends when no label changes.  A node with very
    many links is combined before shuffles.  No links give no rows.
    """
    ways = links.select(F.col(low).alias("node"), F.col(high).alias("other"))
    ways = stored(ways.unionByName(links.select(F.col(high).alias("node"), F.col(low).alias("other"))).distinct(), "links")
    labels = stored(
        ways.groupBy("node").agg(F.min("other").alias("least"))
        .select("node", F.least("node", "least").alias("component"), F.lit(True).alias("moved")), "labels",
    )
    while labels.where("moved").take(1):
        near = ways.join(labels.select(F.col("node").alias("other"), "component"), "other")
        near = near.groupBy("node").agg(F.min("component").alias("near"))
        above = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        least = F.least("component", "near", "above")
        labels = stored(
            labels.join(near, "node").join(above, "component")
            .select("node", least.alias("component"), (least < F.col("component")).alias("moved")), "labels",
        )
    return labels.select("node", "component")
