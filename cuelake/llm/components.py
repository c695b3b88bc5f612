"""Connected components of a table of links, in rounds over DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.plans.cut import durable


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the links (a, b); the component is its smallest node.

    Each round gives a node the least label among itself and its neighbours, then replaces labels by the labels of
    the nodes they name, so paths shorten by halves.  A node's many links meet in partial minima and in joins that
    AQE may split; every round is cut at a checkpoint.  Self-links and null ends are left out.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = durable(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
                     .withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("least"))
        near = (labels.join(seen.withColumnRenamed("a", "node"), "node")
                .select("node", F.col("label").alias("old"), F.least("label", "least").alias("label")))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        moved = durable(near.join(far, "label").select("node", "old", F.least("label", "jump").alias("label")))
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
