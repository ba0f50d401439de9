"""Connected components of a table of links, by minimum labels with pointer jumping; nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, forget, replaced, small


def components(links: DataFrame) -> DataFrame:
    """links (a, b), as cut() has written them, to v, label: every vertex of a link with the smallest vertex that it reaches."""
    both = links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(links.select("b", "a"))
    labels = counted(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("label")))
    while True:
        # the least and the largest label of a vertex and its neighbours: where no two differ, labels are those of components
        of = small(labels).select(F.col("v").alias("w"), "label")
        near = both.join(of, "w").select("v", "label").union(labels).groupBy("v").agg(F.min("label").alias("label"), F.max("label").alias("high"))
        nearer = counted(near)
        if nearer.where("label < high").isEmpty():
            forget(nearer)
            return labels
        root = small(nearer).select(F.col("v").alias("r"), F.col("label").alias("up"))
        after = counted(nearer.join(root, F.col("label") == F.col("r"), "left").select("v", F.least("label", F.coalesce("up", "label")).alias("label")))
        labels = replaced(after, nearer, labels)
