"""Parent-child rows to full hierarchies: path, depth, roots, descendants and loops.

Bottom-up leaf peeling: a node whose children are all taken off is taken off itself and hands its descendants and subtree
size to its parents; the reverse of the peel order gives roots, depths and paths. What the peel leaves has a loop in it or
below it: of that, a walk from the top settles the nodes above the loops, and the rest is looped.

Connected components are peeled side by side, each in one task as long as it has at most ``limit`` edges (counted). Larger ones
are peeled by distributed rounds: runs of nodes with one parent and one child are first contracted by pointer doubling, so
that a long chain costs few rounds; then each round takes off one level, and only that level is shuffled: edges know the
ranks of both ends, and what is handed on waits, unshuffled, for the round of its receiver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.operators.components import FINISH, components
from pagelake.session import cut

CYCLE = "cycle"
#: Edges of a component that one task peels, rows of a task's output at a time.
LIMIT, CHUNK = 50_000, 20_000
PLACED = "graph string, node_id string, root_id string, depth int, path string"
PAIRS = "graph string, node_id string, descendant_id string, distance int"
SIZES = "graph string, node_id string, subtree long"


def edges_of(df: DataFrame, child: str, parent: str, graph: str) -> DataFrame:
    """Distinct edges (graph, child, parent). Rows with a null or blank end are no edges; other columns are ignored."""
    c, p = F.trim(df[child].cast("string")), F.trim(df[parent].cast("string"))
    return (
        df.select(F.lit(graph).alias("graph"), c.alias("child"), p.alias("parent"))
        .where("child is not null and parent is not null and child <> '' and parent <> ''")
        .distinct()
    )


# --- one component in one task ------------------------------------------------------------------------------------------


def peel_order(edges: list[tuple[str, str]]) -> tuple[list[str], set[str], dict[str, list[str]], dict[str, list[str]]]:
    """(nodes in the order in which they are taken off, nodes left, parents by node, children by node) of (child, parent) edges."""
    parents: dict[str, list[str]] = {}
    children: dict[str, list[str]] = {}
    for c, p in edges:
        parents.setdefault(c, []).append(p)
        parents.setdefault(p, [])
        children.setdefault(p, []).append(c)
        children.setdefault(c, [])
    open_ = {n: len(cs) for n, cs in children.items()}
    order = sorted(n for n, k in open_.items() if not k)
    for n in order:
        for p in parents[n]:
            open_[p] -= 1
            if not open_[p]:
                order.append(p)
    return order, open_.keys() - set(order), parents, children


def place(edges: list[tuple[str, str]], paths: bool) -> Iterator[tuple[str, str, int, str | None]]:
    """(node, root, depth, path) of each node with a parent, by the reverse of the peel order."""
    order, left, parents, children = peel_order(edges)
    placed: dict[str, dict[str, tuple[int, str]]] = {}
    waits = {n: len(parents[n]) for n in left}
    top = sorted(n for n, k in waits.items() if not k)
    for n in top:
        for c in children[n]:
            if c in waits:
                waits[c] -= 1
                if not waits[c]:
                    top.append(c)
    looped = left - set(top)
    for n in (*top, *reversed(order)):
        if any(p in looped for p in parents[n]):
            looped.add(n)
            continue
        mine: dict[str, tuple[int, str]] = {} if parents[n] else {n: (0, n if paths else "")}
        for p in parents[n]:
            for r, (d, way) in placed[p].items():
                now = (d + 1, f"{way}/{n}" if paths else "")
                if r not in mine or now < mine[r]:
                    mine[r] = now
        placed[n] = mine
        if parents[n]:
            for r, (d, way) in mine.items():
                yield n, r, d, way if paths else None
    for n in looped:
        yield n, CYCLE, -1, None


def below(edges: list[tuple[str, str]]) -> Iterator[tuple[str, dict[str, int]]]:
    """(node, {descendant: fewest steps}) of each node with a child; a list is handed to the parents and then let go."""
    order, left, parents, children = peel_order(edges)
    lists: dict[str, dict[str, int]] = {}
    wanted = {n: len(parents[n]) for n in order}
    for n in order:
        mine: dict[str, int] = {}
        for c in children[n]:
            for x, d in ((c, 0), *lists[c].items()):
                if d + 1 < mine.get(x, d + 2):
                    mine[x] = d + 1
            wanted[c] -= 1
            if not wanted[c]:
                del lists[c]
        lists[n] = mine
        if mine:
            yield n, mine
    for n in left:
        mine, level, d = {}, [n], 0
        while level:
            d += 1
            level = [c for c in dict.fromkeys(c for m in level for c in children[m]) if c != n and c not in mine]
            mine.update(dict.fromkeys(level, d))
        if mine:
            yield n, mine


def _in_tasks(edges: DataFrame, rows: Callable[[list[tuple[str, str]]], Iterator[tuple]], schema: str) -> DataFrame:
    """``rows`` of each component of (graph, child, parent, comp); a task holds one component at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in schema.split(", ")]
        flat = (r for b in batches for r in zip(b["comp"], b["graph"], b["child"], b["parent"]))
        out: list[tuple] = []
        for (_, graph), group in groupby(flat, key=lambda r: r[:2]):
            for row in rows([r[2:] for r in group]):
                out.append((graph, *row))
                if len(out) >= CHUNK:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        yield pd.DataFrame(out, columns=columns)

    return edges.repartition("comp").sortWithinPartitions("comp", "graph").mapInPandas(run, schema)


def _by_component(edges: DataFrame, limit: int, finish: int) -> tuple[DataFrame, DataFrame | None]:
    """(edges of components of at most ``limit`` edges with their component, edges of larger ones or None)."""
    node = lambda c: F.xxhash64("graph", c)  # noqa: E731 - a clash of hashes only puts two components together
    e = cut(edges.select("graph", "child", "parent", node("child").alias("a"), node("parent").alias("b")))
    e = e.join(components(e, finish), F.col("a") == F.col("node"), "left").select("graph", "child", "parent", F.coalesce("root", "a").alias("comp"))
    e = cut(e)
    large = e.groupBy("comp").count().where(F.col("count") > limit).select("comp")
    large = cut(large)
    if large.isEmpty():
        return e, None
    return e.join(large, "comp", "left_anti"), e.join(large, "comp", "left_semi").select("graph", "child", "parent")


# --- a component of any size in rounds --------------------------------------------------------------------------------------


def _ranked(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(edges with the rank, by peel round, of both ends; edges between nodes that are never taken off; rounds)."""
    left, ranks, n = cut(edges), [], 0
    while True:
        parents = left.select("graph", F.col("parent").alias("child")).distinct()
        off = cut(left.join(parents, ["graph", "child"], "left_anti").select("graph", "child").distinct())
        if off.isEmpty():
            break
        ranks.append(off.withColumn("rank", F.lit(n)))
        left = cut(left.join(off, ["graph", "child"], "left_anti"))
        n += 1
    if not ranks:
        return edges.withColumn("cr", F.lit(0)).withColumn("pr", F.lit(0)).limit(0), left, 0
    rank = cut(reduce(DataFrame.unionByName, ranks))
    r = edges.join(rank.withColumnRenamed("rank", "cr"), ["graph", "child"])
    r = r.join(rank.select("graph", F.col("child").alias("parent"), F.col("rank").alias("pr")), ["graph", "parent"], "left")
    return cut(r), left, n


def _near(up: DataFrame) -> DataFrame:
    """The nearest way of each node to each root; only the loop for nodes that have a parent on or below one."""
    near = up.groupBy("graph", "node_id", "root_id").agg(F.min(F.struct("depth", "path")).alias("m"))
    looped = near.where(F.col("root_id") == CYCLE).select("graph", "node_id").distinct().withColumn("looped", F.lit(True))
    near = near.join(looped, ["graph", "node_id"], "left").where((F.col("root_id") == CYCLE) | F.col("looped").isNull())
    return near.select("graph", "node_id", "root_id", F.col("m.depth").cast("int").alias("depth"), F.col("m.path").alias("path"))


def _handed(edges: DataFrame, placed: DataFrame, paths: bool, *more: str) -> DataFrame:
    """What ``placed`` parents hand down (graph, parent, child, steps, way) edges; a parent that is not placed is a root."""
    p = placed.select("graph", F.col("node_id").alias("parent"), "root_id", "depth", "path")
    looped = F.coalesce(F.col("root_id") == CYCLE, F.lit(False))
    way = F.when(~looped, F.concat_ws("/", F.coalesce("path", "parent"), "way")) if paths else F.lit(None).cast("string")
    depth = F.when(looped, -1).otherwise(F.coalesce(F.col("depth"), F.lit(0)) + F.col("steps"))
    j = edges.join(p, ["graph", "parent"], "left")
    return j.select("graph", F.col("child").alias("node_id"), F.coalesce("root_id", "parent").alias("root_id"), depth.alias("depth"), way.alias("path"), *more)


def _settle_from_top(edges: DataFrame, paths: bool) -> DataFrame:
    """What the peel leaves, by rounds from the roots down; what never gets ready is looped."""
    spark = edges.sparkSession
    placed, left = spark.createDataFrame([], PLACED), edges
    while True:
        undone = left.select("graph", F.col("child").alias("parent")).distinct()
        waiting = left.join(undone, ["graph", "parent"], "left_semi").select("graph", "child").distinct()
        ready = cut(left.join(waiting, ["graph", "child"], "left_anti"))
        if ready.isEmpty():
            break
        placed = cut(placed.unionByName(_near(_handed(ready, placed, paths))))
        left = cut(left.join(waiting, ["graph", "child"], "left_semi"))
    loops = left.select("graph", F.col("child").alias("node_id")).distinct()
    return placed.unionByName(loops.select("graph", "node_id", F.lit(CYCLE).alias("root_id"), F.lit(-1).alias("depth"), F.lit(None).cast("string").alias("path")))


def contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges (graph, child, parent, steps, way) between nodes that are no inner ones, inner nodes (graph, node_id, top, steps, way)).

    An inner node has one parent and one child. Pointers double until they reach a node that is no inner one; the top of a
    loop of inner nodes alone is null.
    """
    one = lambda a, b: edges.groupBy("graph", F.col(a).alias("node_id")).agg(F.count("*").alias("n"), F.min(b).alias("other")).where("n = 1").select("graph", "node_id", "other")
    up, down = one("child", "parent"), one("parent", "child")
    inner = up.withColumnRenamed("other", "top").join(down.select("graph", "node_id"), ["graph", "node_id"], "left_semi")
    inner = cut(inner.select("graph", "node_id", "top", F.lit(1).alias("steps"), F.col("node_id").alias("way")))
    left = inner.count()
    while left:
        far = inner.select("graph", F.col("node_id").alias("top"), F.col("top").alias("far"), F.col("steps").alias("more"), F.col("way").alias("on"))
        now = inner.join(far, ["graph", "top"], "left")
        now = now.select("graph", "node_id", F.coalesce("far", "top").alias("top"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.concat_ws("/", "on", "way").alias("way"), F.col("far").isNotNull().alias("moved"))
        inner = cut(now.drop("moved"))
        left //= 2
    known = inner.select("graph", F.col("node_id").alias("top"))
    inner = cut(inner.join(known.withColumn("loop", F.lit(True)), ["graph", "top"], "left").withColumn("top", F.when(F.col("loop").isNull(), F.col("top"))).drop("loop"))
    rest = edges.join(inner.select("graph", F.col("node_id").alias("child")), ["graph", "child"], "left_anti")
    over = inner.select("graph", F.col("node_id").alias("parent"), "top", F.col("steps").alias("more"), F.col("way").alias("on"))
    rest = rest.join(over, ["graph", "parent"], "left").select("graph", "child", F.coalesce("top", "parent").alias("parent"), (F.coalesce("more", F.lit(0)) + 1).alias("steps"), F.concat_ws("/", "on", "child").alias("way"))
    rest = rest.groupBy("graph", "child", "parent").agg(F.min(F.struct("steps", "way")).alias("m")).select("graph", "child", "parent", "m.steps", "m.way")
    return cut(rest), inner


def _rounds(edges: DataFrame, paths: bool) -> DataFrame:
    """The hierarchy of components of any size: contracted, peeled level by level, placed in the reverse order."""
    rest, inner = contract(edges)
    ranked, left, n = _ranked(rest)
    done = [cut(_settle_from_top(left, paths))]
    # the way down: what a placed node hands on waits for its receiver's round; parents without a rank are settled or roots
    inbox = [cut(_handed(ranked.where("pr is null"), done[0], paths, "cr"))]
    for r in range(n - 1, -1, -1):
        now = cut(_near(reduce(DataFrame.unionByName, inbox).where(F.col("cr") == r).drop("cr")))
        done.append(now)
        inbox.append(cut(_handed(ranked.where(F.col("pr") == r), now, paths, "cr")))
    placed = cut(reduce(DataFrame.unionByName, done))
    loops = inner.where("top is null").select("graph", "node_id", F.lit(CYCLE).alias("root_id"), F.lit(-1).alias("depth"), F.lit(None).cast("string").alias("path"))
    within = _handed(inner.where("top is not null").select("graph", F.col("node_id").alias("child"), F.col("top").alias("parent"), "steps", "way"), placed, paths)
    return placed.unionByName(loops).unionByName(within)


def hierarchy(edges: DataFrame, paths: bool = True, limit: int = LIMIT, finish: int = FINISH) -> DataFrame:
    """Each node with a parent, once per root it reaches: (graph, node_id, root_id, depth, path).

    ``edges``: (graph, child, parent) as from :func:`edges_of`. depth is the fewest steps to that root, path
    the ids from root to node joined by '/' (of several shortest ones the least). A node on a loop, or with an
    ancestor on one, has one row with root 'cycle', depth -1 and no path; a self-parent is a loop. No edges
    give no rows. Repeated edges count once. ``limit`` and ``finish`` change the cost, not the rows.
    """
    small, large = _by_component(edges.distinct(), limit, finish)
    found = _in_tasks(small, lambda e: place(e, paths), PLACED)
    return found if large is None else found.unionByName(_rounds(large, paths))


def _pairs_in_rounds(edges: DataFrame) -> DataFrame:
    """Descendants of components of any size: each level hands its lists to its parents, as rows."""
    ranked, left, n = _ranked(edges)
    step = lambda e, *more: e.select("graph", F.col("parent").alias("node_id"), F.col("child").alias("descendant_id"), F.lit(1).alias("distance"), *more)
    least = lambda df: df.groupBy("graph", "node_id", "descendant_id").agg(F.min("distance").alias("distance"))

    def through(e: DataFrame, lists: DataFrame, *more: str) -> DataFrame:
        b = lists.select("graph", F.col("node_id").alias("child"), "descendant_id", F.col("distance").alias("d"))
        return e.join(b, ["graph", "child"]).select("graph", F.col("parent").alias("node_id"), "descendant_id", (F.col("d") + 1).cast("int").alias("distance"), *more)

    inbox, done = [cut(step(ranked, "pr"))], []
    for r in range(n):
        now = cut(least(reduce(DataFrame.unionByName, inbox).where(F.col("pr") == r).drop("pr")))
        done.append(now)
        inbox.append(cut(through(ranked.where(F.col("cr") == r), now, "pr")))
    # what is left: a walk inside it, and what the peeled nodes handed to it
    inside = cut(_reach(step(left), left, through, least))
    handed = cut(least(reduce(DataFrame.unionByName, inbox).where("pr is null").drop("pr")))
    b = handed.select("graph", F.col("node_id").alias("descendant_id"), F.col("descendant_id").alias("far"), F.col("distance").alias("d"))
    lower = inside.join(b, ["graph", "descendant_id"]).select("graph", "node_id", F.col("far").alias("descendant_id"), (F.col("distance") + F.col("d")).cast("int").alias("distance"))
    rest = least(inside.unionByName(handed).unionByName(lower)).where("node_id <> descendant_id")
    return reduce(DataFrame.unionByName, [*done, rest])


def descendants(edges: DataFrame, limit: int = LIMIT, finish: int = FINISH) -> DataFrame:
    """Every (graph, node_id, descendant_id, distance): descendants below each node, fewest steps.

    Lists are handed upwards as rows in the rounds, so that a root over a third of all rows is no large value. A node on a loop is
    not its own descendant.
    """
    small, large = _by_component(edges.distinct(), limit, finish)
    found = _in_tasks(small, lambda e: ((n, x, d) for n, mine in below(e) for x, d in mine.items()), PAIRS)
    return found if large is None else found.unionByName(_pairs_in_rounds(large))


def subtree_sizes(edges: DataFrame, limit: int = LIMIT, finish: int = FINISH) -> DataFrame:
    """(graph, node_id, subtree) of each node with a child: how many descendants it has."""
    small, large = _by_component(edges.distinct(), limit, finish)
    found = _in_tasks(small, lambda e: ((n, len(mine)) for n, mine in below(e)), SIZES)
    return found if large is None else found.unionByName(_pairs_in_rounds(large).groupBy("graph", "node_id").agg(F.count("*").alias("subtree")))


def _reach(pairs: DataFrame, edges: DataFrame, through, least) -> DataFrame:
    """Every pair of a remainder of any size by rounds of joins of the newest pairs, one more edge a round."""
    known = frontier = cut(least(pairs))
    while True:
        new = least(through(edges, frontier).where("node_id <> descendant_id"))
        frontier = cut(new.join(known.select("graph", "node_id", "descendant_id"), ["graph", "node_id", "descendant_id"], "left_anti"))
        if frontier.isEmpty():
            return known
        known = cut(known.unionByName(frontier))
