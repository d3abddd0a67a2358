"""Unions of time intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Buckets of a group: the rows of one are ordered in one task, and each gets the farthest end before it.
BUCKETS = 1_024


def union_total(rows: DataFrame, group: str, start: str, end: str, buckets: int = BUCKETS) -> DataFrame:
    """(group, islands, total): merged intervals, touching ones together, and their summed length; integers. Empty ones count 0.

    Each row adds what it reaches beyond the farthest end before it. That end is the greater of the bucket's own running one and
    the one carried in from the buckets before, so a group of a third of all rows is spread over its buckets.
    """
    r = rows.where(f"{start} is not null and {end} is not null and {end} >= {start}")
    span = r.groupBy(group).agg(F.min(start).alias("_lo"), F.max(start).alias("_hi"))
    r = r.join(span, r[group].eqNullSafe(span[group])).drop(span[group])
    r = r.withColumn("_bucket", F.floor((F.col(start) - F.col("_lo")) * buckets / (F.col("_hi") - F.col("_lo") + 1)))
    ends = r.groupBy(group, "_bucket").agg(F.max(end).alias("_max"))
    carried = F.max("_max").over(W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), carried.alias("_carried"))
    r = r.join(ends, r[group].eqNullSafe(ends["_g"]) & (r["_bucket"] == ends["_b"]))
    own = F.max(end).over(W.partitionBy(group, "_bucket").orderBy(start, end).rowsBetween(W.unboundedPreceding, -1))
    r = r.withColumn("_before", F.greatest(own, F.col("_carried")))
    new = F.col("_before").isNull() | (F.col(start) > F.col("_before"))
    adds = F.when(new, F.col(end) - F.col(start)).otherwise(F.greatest(F.col(end) - F.col("_before"), F.lit(0)))
    return r.groupBy(group).agg(F.count_if(new).alias("islands"), F.sum(adds).alias("total"))
