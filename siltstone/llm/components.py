"""Connected components of an edge table by minimum labels and pointer jumping, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, label for every end of an edge (a, b): label is the smallest node of its component.

    A round takes the smallest label among the neighbours and then the label of the label, so a path of n nodes needs
    about log n rounds. Labels of a round are written to the shared folder; a round that changes nothing is the last.
    """
    both = common.stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "components-edges")
    labels = common.stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "components-labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("offered")), "b").groupBy(F.col("a").alias("node")).agg(F.min("offered").alias("offered"))
        hooked = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "offered").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = hooked.join(target, "label", "left").select("node", "old", F.least("label", "further").alias("label"))
        moved = common.stored(jumped, "components-labels")
        labels = moved.select("node", "label")
        if not moved.where("label < old").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")
