"""Immutable corrections laid over records: resolution, application and splices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(records: DataFrame) -> DataFrame:
    """(correction_id, outcome) for records (correction_id, kind, scope, replacement, supersedes_id).

    superseded: another record supersedes it. invalid: blank replacement or no scope. conflict: of those left, several
    with one kind and scope; all of them drop. active: the rest.
    """
    r = records.dropDuplicates(["correction_id"])
    over = records.where("supersedes_id is not null and supersedes_id <> '' and supersedes_id <> correction_id").select(F.col("supersedes_id").alias("correction_id")).distinct().withColumn("superseded", F.lit(True))
    r = r.join(over, "correction_id", "left")
    bad = F.col("replacement").isNull() | (F.trim("replacement") == "") | F.col("scope").isNull()
    r = r.withColumn("state", F.when(F.col("superseded"), "superseded").when(bad, "invalid"))
    n = r.where("state is null").groupBy("kind", "scope").agg(F.count("*").alias("n"))
    r = r.join(n, ["kind", "scope"], "left")
    return r.select("correction_id", F.coalesce("state", F.when(F.col("n") > 1, "conflict").otherwise("active")).alias("outcome"))


def apply_overlays(base: DataFrame, overlays: DataFrame, key: str, text: str) -> DataFrame:
    """``base`` with the overlay's replacement for its text; columns text and overlaid. Overlays: (key, replacement), one a key."""
    j = base.join(overlays.select(key, "replacement"), key, "left")
    return j.withColumn("overlaid", F.col("replacement").isNotNull()).withColumn(text, F.coalesce("replacement", text)).drop("replacement")


def splice(text: Column, edits: Column) -> Column:
    """``text`` with edits array<struct<start, end, replacement>> put in from the right; start and end are 0-based, half open."""
    ordered = F.reverse(F.array_sort(edits))
    return F.aggregate(ordered, text, lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["replacement"], F.substring(t, e["end"] + 1, F.length(t))))


def overlapping(rows: DataFrame, group: list[str], ident: str, value: str, selectors: str) -> DataFrame:
    """(group, a, b): pairs of one group with different values whose selector arrays meet.

    Met through their selectors, so rows without a common one are never paired.
    """
    x = rows.where(f"{value} is not null").select(*group, F.col(ident).alias("i"), F.col(value).alias("v"), F.explode(F.array_distinct(selectors)).alias("s"))
    a, b = (x.select(*group, "s", F.col("i").alias(n), F.col("v").alias("v" + n)) for n in "ab")
    return a.join(b, [*group, "s"]).where("a < b and va <> vb").select(*group, "a", "b").distinct()


def scoped(rows: DataFrame, selectors: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows with at least one selector among the targets (a semi join through the exploded selectors), each once.

    Selectors meet by 128 bits of hash. Spark takes exploded targets for as small as their files, so the joins ask for
    shuffles: else the driver would gather them for a broadcast.
    """
    key = [F.xxhash64(target).alias("_a"), F.xxhash64(F.lit("target"), target).alias("_b")]
    asked = rows.select("id", F.explode(F.array_distinct(selectors)).alias(target)).where(F.col(target).isNotNull()).select("id", *key)
    known = targets.where(F.col(target).isNotNull()).select(*key).distinct()
    hit = asked.join(known.hint("merge"), ["_a", "_b"], "left_semi").select("id").distinct()
    return rows.join(hit.hint("merge"), "id", "left_semi")


def narrow(base: Column, taken: Column) -> Column:
    """The selectors of a base that more particular overlays leave to it."""
    return F.array_except(base, taken)
