"""Discovery of new pages as a stream, against what was seen before."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelake.functions.ids import page_id
from pagelake.sources.files import IMAGES


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New image files of a folder as (path, sha256, page_id, modificationTime)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    # a file older than the newest one seen is new too
    f = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", IMAGES).option("maxFileAge", "36500d").load(folder)
    return f.select("path", "modificationTime", F.sha2("content", 256).alias("sha256")).withColumn("page_id", page_id(F.col("sha256")))


def discover(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append each page once, however old its file is, to the table at ``target``; ends when all files are read.

    Each batch is held against the ids that the table has, so nothing depends on times and a batch that is run again adds nothing.
    """
    kinds = stream.schema

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            have = spark.read.schema(kinds).parquet(target).select("page_id")
        except AnalysisException:
            have = spark.createDataFrame([], "page_id string")
        batch.dropDuplicates(["page_id"]).join(have, "page_id", "left_anti").select(*kinds.names).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, kind, n): events by window, late ones within the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), kind).count().select(F.col("window.start").alias("start"), kind, F.col("count").alias("n"))
