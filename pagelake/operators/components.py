"""Connected components by contraction: each round hooks every node to its least neighbour and shrinks the links.

A node left after a round stands for a group, so the links of the next round are those between groups: at least half of the
nodes go each round, and all rounds together cost little more than the first. When at most ``finish`` links are left (they
are counted) one task ends with union-find. Labels are put together backwards through the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.session import cut

#: Links that one task may end with.
FINISH = 20_000


def _union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of all links of the task, by union-find with the least node as root."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for x, y in zip(b["a"].tolist(), b["b"].tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "root": pd.Series([root(x) for x in nodes], dtype="int64")})


def components(links: DataFrame, finish: int = FINISH) -> DataFrame:
    """(node, root) for each node of ``links`` (a long, b long) that has a link to another: root is one node of its component.

    Null ends and links of a node to itself are left out; repeated links count once. No links give no rows.
    """
    left = cut(links.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while left.count() > finish:
        both = left.union(left.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"))
        hook = cut(hook)
        jump = hook.select(F.col("node").alias("up"), F.col("up").alias("far"))
        label = cut(hook.join(jump, "up").select("node", F.col("far").alias("root")))
        rounds.append(label)
        for end in "ab":
            left = left.join(label.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        left = cut(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = cut(left.coalesce(1).mapInPandas(_union, "node long, root long"))
    for label in reversed(rounds):
        over = known.select(F.col("node").alias("root"), F.col("root").alias("far"))
        known = label.join(over, "root", "left").select("node", F.coalesce("far", "root").alias("root"))
        # a node that was only named as a root of this round is in the next rounds' labels or its own root
        known = cut(known)
    return known
