"""Connected components of links between classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.support import staged


def connected(edges: DataFrame) -> DataFrame:
    """node and the least node of its component, for all nodes of ``edges`` (left, right).

    Each step takes the least label of the neighbours and then the label of that label, so paths
    shorten by half; the steps end when no label changes. Labels are combined before they move.
    """
    both = staged(edges.select("left", "right").unionByName(edges.select(F.col("right").alias("left"), F.col("left").alias("right"))).where("left != right").distinct())
    labels = staged(both.groupBy(F.col("left").alias("node")).agg(F.least(F.min("right"), F.min("left")).alias("label")))
    while True:
        near = both.join(labels, F.col("right") == F.col("node")).groupBy("left").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("left")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # A label's own new label; labels are few, so they are looked up once each.
        hooked = staged(hooked)
        jump = hooked.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = staged(hooked.join(jump, F.col("label") == F.col("at")).select("node", "old", F.least("label", "further").alias("label")))
        if moved.where("old != label").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def merged(nodes: DataFrame, components: DataFrame | None, links: DataFrame) -> DataFrame:
    """(class, component) of all ``nodes`` (class) after ``links`` (left, right) between classes joined components."""
    links = staged(links)
    before = nodes.select("class", F.col("class").alias("component")) if components is None else components
    if links.isEmpty():
        return staged(before) if components is None else components
    of = before.select(F.col("class").alias("at"), F.col("component").alias("of"))
    ends = links.join(of, F.col("left") == F.col("at")).select(F.col("of").alias("left"), "right").join(of, F.col("right") == F.col("at")).select("left", F.col("of").alias("right"))
    labels = connected(ends.distinct())
    return staged(before.join(labels, F.col("component") == F.col("node"), "left").select("class", F.coalesce("label", "component").alias("component")))
