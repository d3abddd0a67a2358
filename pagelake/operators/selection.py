"""Selections from records: first matches, winners, latest plans, rollups, memo tables and record scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.operators.similar import near_hashes
from pagelake.operators.terms import greedy_batches
from pagelake.session import cut

#: Rounds after which a consolidation that still has several batches is given up.
ROUNDS = 8


def winners(entries: DataFrame, sources: str, tier: str, rank: str, ident: str) -> DataFrame:
    """One row for each set of source forms: the entry of least tier, then rank, then id. Equal sets in another order are one."""
    key = F.array_sort(F.array_distinct(sources))
    rest = [c for c in entries.columns if c != sources]
    w = entries.where(F.col(sources).isNotNull()).groupBy(key.alias(sources)).agg(F.min_by(F.struct(*rest), F.struct(tier, rank, ident)).alias("w"), F.count("*").alias("variants"))
    return w.select(sources, *[F.col(f"w.{c}").alias(c) for c in rest], "variants")


def latest(rows: DataFrame, group: list[str], basis: str, ident: str) -> DataFrame:
    """(group, ident, basis): of each group the row with the largest basis, of equal ones the greatest id; never by age."""
    return rows.groupBy(*group).agg(F.max(F.struct(F.col(basis).alias("b"), F.col(ident).alias("i"))).alias("m")).select(*group, F.col("m.i").alias(ident), F.col("m.b").alias(basis))


def first_near(requests: DataFrame, stored: DataFrame, column: str, context: list[str], result: str, radius: int = 5) -> DataFrame:
    """``requests`` with the result of the first stored hash within ``radius`` and of equal context: least distance, then least result."""
    hashes = requests.select(column).union(stored.select(column))
    pairs = near_hashes(hashes, column, radius)
    both = pairs.union(pairs.select("b", "a", "distance")).toDF("_h", column + "_s", "distance")
    same = requests.select(F.lower(column).alias("_h")).distinct().select("_h", F.col("_h").alias(column + "_s"), F.lit(0).alias("distance"))
    s = stored.where(F.col(result).isNotNull()).select(F.lower(column).alias(column + "_s"), *context, F.col(result).alias("_r"))
    met = requests.withColumn("_h", F.lower(column)).join(both.union(same), "_h").join(s, [column + "_s", *context])
    keys = [c for c in requests.columns]
    best = met.groupBy(*keys).agg(F.min(F.struct("distance", "_r")).alias("m"))
    return best.select(*keys, F.col("m._r").alias("result"), F.col("m.distance").alias("distance"))


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """``stored`` with the incoming rows in the place of those of equal key; of several incoming ones the last by ``order``."""
    rest = [c for c in incoming.columns if c not in key]
    new = incoming.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.hash(*rest))).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
    return stored.join(new.select(*key), key, "left_anti").unionByName(new)


def holding(records: DataFrame, kind: str, is_kind: str, text: str, ids: DataFrame, ident: str) -> DataFrame:
    """Records of a kind with each id of ``ids`` that their JSON text names as a value.

    Ids are pulled out of the text, so a record meets only ids that it may hold, by an equi-join; what was pulled is checked against the
    values of the parsed text.
    """
    r = records.where(F.col(kind) == is_kind)
    values = F.map_values(F.from_json(text, "map<string,string>"))
    met = r.select("*", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("([0-9a-f]{64})"), F.lit(1)))).alias("_id"))
    met = met.join(ids.select(F.col(ident).alias("_id")).distinct(), "_id")
    return met.where(F.exists(values, lambda v: v == F.col("_id"))).withColumnRenamed("_id", "held_id")


def any_true(rows: DataFrame, levels: list[list[str]], flag: Column) -> DataFrame:
    """(level, key, flagged, of): for each level, coarse to fine as lists of columns, whether any row under a key is flagged, and of how many."""
    one = rows.groupBy(*levels[-1]).agg(F.count_if(flag).alias("n"), F.count("*").alias("k"))
    out = None
    for cols in levels:
        part = one.groupBy(*cols).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        part = part.select(F.lit("/".join(cols) or "run").alias("level"), F.concat_ws("/", *cols).alias("key"), (F.col("n") > 0).alias("flagged"), F.col("k").alias("of"))
        out = part if out is None else out.unionByName(part)
    return out


def partition_check(parts: DataFrame, universe: DataFrame, node: str) -> DataFrame:
    """One row (universe, assigned, twice, missing, strange, exact): whether ``parts`` are disjoint and cover the universe, no more and no less."""
    p = parts.groupBy(node).agg(F.count("*").alias("n"))
    u = universe.select(node).distinct().withColumn("in_universe", F.lit(True))
    j = p.join(u, node, "full_outer")
    c = j.agg(
        F.count_if(F.col("in_universe")).alias("universe"), F.count_if(F.col("in_universe") & (F.col("n") > 0)).alias("assigned"), F.count_if(F.col("n") > 1).alias("twice"),
        F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("in_universe").isNull()).alias("strange"),
    )
    return c.withColumn("exact", (F.col("twice") == 0) & (F.col("missing") == 0) & (F.col("strange") == 0))


def two_relation_closure(depends: DataFrame, found: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, what): artifacts and findings that the seed artifacts need.

    depends: (artifact, needs), found: (artifact, finding, subject): a finding of an artifact needs its subject artifact in turn.
    Rounds of the newest rows only, until none is new.
    """
    seen = frontier = cut(seeds.select(F.col("artifact").alias("id")).where("id is not null").distinct())
    findings = cut(found.select(F.col("finding").alias("id")).limit(0))
    d, f = (x.distinct() for x in (depends, found))
    while True:
        now = f.join(frontier.withColumnRenamed("id", "artifact"), "artifact").where("finding is not null").select(F.col("finding").alias("id"), "subject").distinct()
        new_findings = cut(now.join(findings, "id", "left_anti"))
        findings = cut(findings.unionByName(new_findings.select("id").distinct()))
        needs = d.join(frontier.withColumnRenamed("id", "artifact"), "artifact").select(F.col("needs").alias("id"))
        frontier = cut(needs.union(new_findings.select(F.col("subject").alias("id"))).where("id is not null").distinct().join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            return seen.withColumn("what", F.lit("artifact")).unionByName(findings.withColumn("what", F.lit("finding")))
        seen = cut(seen.unionByName(frontier))


class NoProgress(RuntimeError):
    """A consolidation whose round did not shrink, or that did not end."""


def consolidate(groups: DataFrame, group: str, order: str, size: str, budget: int, call: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(consolidated groups, (batches, groups, tokens) of each round): batches within the budget go through ``call`` until one is left for each key.

    call: batched groups to groups of the same columns. A round must be less than the one before, compared as (batches, groups,
    tokens), and there are at most ``rounds``; else nothing is given.
    """
    seen: list[tuple[int, int, int]] = []
    for _ in range(rounds):
        batched = cut(greedy_batches(groups, group, order, size, budget))
        at = batched.groupBy(group).agg(F.max("batch").alias("b"), F.count("*").alias("n"), F.sum(size).alias("s"))
        got = at.agg(F.coalesce(F.sum(F.col("b") + 1), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.max("b"), F.lit(0))).first()
        now = tuple(int(x) for x in got[:3])
        if seen and now >= seen[-1]:
            raise NoProgress(f"the round went from {seen[-1]} to {now}")
        seen.append(now)
        groups = cut(call(batched).select(*groups.columns))
        if got[3] == 0:
            return groups, seen
    raise NoProgress(f"{rounds} rounds were not enough")
