"""Graphs of records: closure, reachability and the impact of a change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.session import cut


def reach(edges: DataFrame, seeds: DataFrame, forward: bool = True) -> DataFrame:
    """(node): the seeds and all nodes they reach; edges (parent, child), backward goes from child to parent.

    Semi-naive rounds: only the newest nodes are joined, and visited ones are taken out. Loops end.
    """
    a, b = ("parent", "child") if forward else ("child", "parent")
    e = edges.where("parent is not null and child is not null").select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    seen = frontier = cut(seeds.select("node").where("node is not null").distinct())
    while True:
        new = frontier.join(e, "node").select(F.col("next").alias("node")).distinct()
        frontier = cut(new.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))


def impact(edges: DataFrame, universe: DataFrame, changed: DataFrame, protected: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(node, impact) of each node of the universe: ambiguous before protected before affected before unaffected.

    affected: reached from a changed node. The classes are disjoint and cover the universe.
    """
    flag = lambda df, name: df.select("node").distinct().withColumn(name, F.lit(True))
    hit = reach(edges, changed)
    u = universe.select("node").distinct().join(flag(ambiguous, "a"), "node", "left").join(flag(protected, "p"), "node", "left").join(flag(hit, "h"), "node", "left")
    return u.select("node", F.when(F.col("a"), "ambiguous").when(F.col("p"), "protected").when(F.col("h"), "affected").otherwise("unaffected").alias("impact"))


def execution(impacts: DataFrame, produced: DataFrame, base: DataFrame) -> DataFrame:
    """(node, outcome): affected nodes not yet produced are regenerated; unaffected and protected ones that exist are reused."""
    have = produced.select("node").union(base.select("node")).distinct().withColumn("have", F.lit(True))
    made = produced.select("node").distinct().withColumn("made", F.lit(True))
    j = impacts.join(have, "node", "left").join(made, "node", "left")
    outcome = F.when((F.col("impact") == "affected") & F.col("made").isNull(), "regenerated").when(F.col("impact").isin("unaffected", "protected") & F.col("have"), "reused")
    return j.select("node", outcome.alias("outcome")).where("outcome is not null")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): ends of edges that are no node, both sides; null ends are none."""
    ends = edges.select(F.col("parent").alias("node")).union(edges.select(F.col("child").alias("node"))).distinct().where("node is not null")
    return ends.join(nodes.select("node"), "node", "left_anti")
