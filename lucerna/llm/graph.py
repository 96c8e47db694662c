"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import drop_shared, write_shared

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (a, b), for every node of an edge.

    Every round takes the least label among neighbours and then the label's own label, so the
    number of rounds grows with the logarithm of a component's width.  Rounds are written to the
    shared folder; the driver only learns how many labels changed.
    """
    spark = edges.sparkSession
    both, edge_path = write_shared(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels, path = write_shared(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        # A root that is offered a smaller label passes it on to everything below it.
        lower = hooked.groupBy(F.col("label").alias("root")).agg(F.min("new").alias("lower"))
        step = hooked.join(lower, hooked["label"] == lower["root"]).select("node", "label", F.least("new", "lower").alias("new"))
        step, next_path = write_shared(step, "labels")
        drop_shared(spark, path)
        path = next_path
        changed = step.filter("label <> new").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            drop_shared(spark, edge_path)
            return labels
    raise RuntimeError("components did not settle")
