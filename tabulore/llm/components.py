"""Connected components of a graph of links, by hooking and pointer jumping over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulore.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """node, label: for every node of links (src, dst, both not null), the least node reachable.

    Each round, a node sees the least label among its neighbours', every label takes the least that its nodes saw,
    and nodes follow their label's label. Rounds grow with the logarithm of the longest path; each is checkpointed,
    and only the number of changed nodes comes to the driver. Repeated links and loops change nothing.
    """
    both = cut(links.select("src", "dst").union(links.select("dst", "src")).distinct())
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        seen = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("seen"))
        nodes = cut(labels.join(seen, labels["node"] == seen["src"]).select("node", "label", F.least("label", "seen").alias("seen")))
        hooked = nodes.groupBy("label").agg(F.min("seen").alias("hooked"))
        moved = cut(nodes.select("node", "label").join(hooked, "label").select("node", F.col("label").alias("was"), F.col("hooked").alias("label")))
        # a label is itself a node, so its own label is one jump further
        to = moved.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = cut(moved.join(to, "label").select("node", "was", F.least("label", "further").alias("label")))
        changed = labels.filter(F.col("label") != F.col("was")).count()
        labels = labels.select("node", "label")
        if not changed:
            return labels
