"""Connected components of an edge table, by rounds of minimum labels with shortcuts.

Nothing is gathered on the driver but one count a round. A round combines messages to a
node on the map side, so a hub costs one row a task. Each round's labels are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small


#: Most nodes whose labels (about 50 bytes each) are broadcast in a round; beyond it the joins shuffle.
BROADCAST_NODES = 300_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is the least node of its component.

    Takes any orderable node type. Rows with a null end and self edges only add their node.
    An empty table has no components. Raises where ``rounds`` don't settle the labels. The tables of
    the rounds before the last are deleted.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    both = materialize(both.where("node is not null"), "edges")
    least = F.min(F.least("node", F.coalesce("other", "node")))
    labels = materialize(both.groupBy("node").agg(least.alias("label")).withColumn("old", F.col("node")), "labels")
    for _ in range(rounds):
        # nodes whose label is new tell their neighbours; the others have done so
        sent = (
            both.join(small(labels.where("label <> old").select("node", "label"), BROADCAST_NODES), "node")
            .where("other is not null")
            .groupBy(F.col("other").alias("node"))
            .agg(F.min("label").alias("seen"))
        )
        offered = labels.join(sent, "node", "left").select("node", "label", F.least("label", F.coalesce("seen", "label")).alias("next"))
        jump = small(labels.select(F.col("node").alias("next"), F.col("label").alias("beyond")), BROADCAST_NODES)
        jumped = offered.join(jump, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("label"), F.col("label").alias("old"))
        moved = materialize(jumped, "labels")
        discard(labels)
        labels = moved
        if labels.where("label <> old").limit(1).count() == 0:
            discard(both)
            out = labels.select("node", "label")
            out._written = labels._written
            return out
    raise RuntimeError("the components have not settled")
