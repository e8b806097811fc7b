"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.plans.storage import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node that an edge names; component is the smallest node of its component.

    Self-loops, repeated edges and either direction are harmless; edges with a null end are ignored; an empty table gives
    an empty result. In each round a node takes the smallest label among its neighbours, hands it to the node that its own
    label names, so that whole trees move at once, and then jumps along the labels: a path of n nodes needs about log n
    rounds. Every round is written to the shared folder, and what it was made of is deleted. Labels are never broadcast: small as
    Parquet, they take many times that in the driver.
    """
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    e = e.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
    e = materialize(e.select("e.src", "e.dst").distinct(), "edges")
    labels = materialize(e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    for _ in range(max_rounds):
        near = e.join(labels.select(F.col("node").alias("dst"), "label").hint("merge"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        told = F.array(F.struct("node", F.least("label", "near").alias("label"), F.col("label").alias("before")), F.struct(F.col("label").alias("node"), F.col("near").alias("label"), F.lit(None).alias("before")))
        step = labels.join(near.hint("merge"), "node").select(F.explode(told).alias("t")).groupBy("t.node").agg(F.min("t.label").alias("label"), F.min("t.before").alias("before"))
        step = materialize(step, "labels")
        roots = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = materialize(step.join(roots.hint("merge"), "label").select("node", F.least("label", "root").alias("label"), "before"), "labels")
        changed = jumped.where("label <> before").limit(1).count()
        discard(step, labels)
        labels = jumped
        if not changed:
            discard(e)
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.drop("before")
        labels._materialized = jumped._materialized
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
