"""Choosing in order: a row is kept unless one that was kept before is too like it.

The rule is sequential, but a row only waits for the earlier rows it is like. Each round keeps the rows
that wait for none any more and drops those that are like a kept one, all at once; a chain of rows that are
alike in turn takes as many rounds as it is long, and everything else a few. Rounds are joins of tables
in the work folder; the driver learns only whether rows are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import staged


def kept_in_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): those of ``nodes`` (id) that the walk in order keeps; ``edges`` (earlier, later) are pairs that are alike. Ids of edges
    must be among the nodes, and "earlier" must be an order: without cycles."""
    edges = staged(edges.select("earlier", "later").distinct(), "alike")
    undecided = staged(nodes.join(edges.select(F.col("later").alias("id")).distinct(), "id", "left_semi"), "undecided")
    new = nodes.join(undecided, "id", "left_anti").select("id")
    kept = [new]
    while not undecided.isEmpty():
        gone = staged(edges.join(new, edges["earlier"] == new["id"], "left_semi").select(F.col("later").alias("id")).distinct(), "gone")
        # what is decided neither waits nor is waited for
        edges = edges.join(gone, edges["later"] == gone["id"], "left_anti")
        edges = staged(edges.join(gone, edges["earlier"] == gone["id"], "left_anti"), "alike")
        left = staged(undecided.join(gone, "id", "left_anti"), "left")
        waits = edges.select(F.col("later").alias("id")).distinct()
        new = staged(left.join(waits, "id", "left_anti"), "kept")
        undecided = staged(left.join(waits, "id", "left_semi"), "undecided")
        kept.append(new)
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, leader): in order, a node joins the first leader that is like it, or else leads. ``nodes`` has id and place (its order),
    ``edges`` earlier and later."""
    lead = staged(kept_in_order(nodes.select("id"), edges), "leaders").withColumnRenamed("id", "_lead")
    near = edges.join(lead, edges["earlier"] == lead["_lead"]).select(F.col("later").alias("id"), F.col("earlier").alias("leader"))
    near = near.join(nodes.select(F.col("id").alias("leader"), F.col("place").alias("_place")), "leader").groupBy("id").agg(F.min_by("leader", "_place").alias("leader"))
    near = near.join(lead, near["id"] == lead["_lead"], "left_anti")
    return nodes.select("id").join(near, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))
