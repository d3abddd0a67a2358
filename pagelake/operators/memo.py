"""Immutable records, memoized results and sealed revisions as append-only tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.session import cut


class Conflict(ValueError):
    """An id is to get other content than it has."""


def new_records(incoming: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """The incoming records to append; the same id with the same content is no record, with other content it is an error."""
    one = incoming.groupBy(key).agg(F.countDistinct(F.sha2(F.col(content).cast("binary"), 256)).alias("_n"))
    clash = incoming.join(stored.select(key, F.col(content).alias("_c")), key).where(~F.col(content).eqNullSafe(F.col("_c"))).select(key).union(one.where("_n > 1").select(key))
    if not clash.isEmpty():
        raise Conflict(f"other content under {key} {clash.first()[0]}")
    return incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def lookup(requests: DataFrame, attested: DataFrame, on: list[str], result: str) -> DataFrame:
    """``requests`` with status hit, miss or ambiguous, and the result of a hit.

    Only results attested for all of ``on`` count; several results for one key are ambiguous and none is taken.
    """
    a = attested.where(F.col(result).isNotNull()).groupBy(*on).agg(F.countDistinct(result).alias("_n"), F.min(result).alias("_r"))
    j = requests.join(a, on, "left")
    n = F.coalesce("_n", F.lit(0))
    return j.withColumn("status", F.when(n == 0, "miss").when(n == 1, "hit").otherwise("ambiguous")).withColumn("result", F.when(n == 1, F.col("_r"))).drop("_n", "_r")


def unique_leaves(rows: DataFrame, subject: str, leaf: str) -> DataFrame:
    """(subject, leaf): the leaf of each subject that has exactly one; others are dropped as ambiguous."""
    return rows.where(F.col(leaf).isNotNull()).groupBy(subject).agg(F.countDistinct(leaf).alias("n"), F.min(leaf).alias(leaf)).where("n = 1").drop("n")


#: Member hashes that are joined to one text at a time.
STRETCH = 4_096


def manifest(members: DataFrame, key: str, content: str) -> DataFrame:
    """One row (members, hash): a hash over the members' hashes in the order of their ids, as a tree.

    Members are numbered in order by ranges, STRETCH of them make a hash, and so on up, so no list of all members is gathered.
    """
    m = members.select(F.col(key).cast("string").alias("k"), F.sha2(F.col(content).cast("binary"), 256).alias("h")).distinct()
    n = m.count()
    level = m.select("k", F.sha2(F.concat_ws("\0", "k", "h"), 256).alias("h"))
    while True:
        numbered = cut(_numbered(level))
        level = numbered.groupBy(F.floor(F.col("n") / STRETCH).alias("g")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]), "\n"), 256).alias("h"))
        level = cut(level.select(F.lpad(F.col("g").cast("string"), 18, "0").alias("k"), "h"))
        if level.count() <= 1:
            break
    top = level.agg(F.coalesce(F.max("h"), F.lit("")).alias("h"))
    return top.select(F.lit(n).cast("long").alias("members"), F.sha2(F.concat_ws("/", F.lit(str(n)), "h"), 256).alias("hash"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (k, h) with n, their number from 0 in the order of k: sorted by ranges, counted by partition."""
    at = cut(rows.repartitionByRange("k").sortWithinPartitions("k").withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id() - F.shiftleft(F.col("p").cast("long"), 33)))
    sizes = at.groupBy("p").agg(F.count("*").alias("c"))
    before = sizes.withColumn("before", F.sum("c").over(W.orderBy("p")) - F.col("c")).select("p", "before")
    return at.join(F.broadcast(before), "p").select("k", "h", (F.col("before") + F.col("i")).alias("n"))


def seal(members: DataFrame, folder: str, revision: str, key: str, content: str) -> str:
    """Write a revision once, never to be changed, with its manifest; sealing is not activating. Gives the hash."""
    spark = members.sparkSession
    at = f"{folder}/revision={revision}"
    members.write.mode("errorifexists").parquet(f"{at}/members")
    got = manifest(spark.read.parquet(f"{at}/members"), key, content)
    got.write.mode("errorifexists").parquet(f"{at}/manifest")
    return got.first()["hash"]


def verify(spark: SparkSession, folder: str, revision: str, key: str, content: str) -> bool:
    """Whether a revision's members are those that were sealed."""
    at = f"{folder}/revision={revision}"
    return manifest(spark.read.parquet(f"{at}/members"), key, content).first() == spark.read.parquet(f"{at}/manifest").first()


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its terms."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def activate(pointer: str, revision: str, spark: SparkSession | None = None) -> None:
    """Put ``revision`` into the one-line pointer file in one step: written beside it, then renamed over it, on any file system of Spark."""
    spark = spark or SparkSession.active()
    fs, p, jvm = _files(spark, pointer)
    beside = jvm.org.apache.hadoop.fs.Path(f"{pointer}.{uuid.uuid4().hex}.part")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps({"revision": revision}).encode()))
    out.hflush()
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(p), over)


def active(pointer: str, spark: SparkSession | None = None) -> str | None:
    """The active revision, or None; never guessed from age."""
    fs, p, jvm = _files(spark or SparkSession.active(), pointer)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["revision"]
    finally:
        stream.close()
