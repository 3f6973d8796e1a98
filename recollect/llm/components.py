"""Connected components of links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of links (a, b).

    Labels fall to the least label next door, then to their label's own label,
    until nothing changes; every round is cut off from its lineage.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    both = checkpointed(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpointed(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("theirs")), "v").groupBy("u").agg(F.min("theirs").alias("theirs"))
        step = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("further"))
        step = checkpointed(step.join(jump, "label").select("u", "old", F.least("label", "further").alias("label")))
        labels = step.select("u", "label")
        if step.where("old <> label").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
