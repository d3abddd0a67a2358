"""Parquet tables of a corpus folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` under ``root``; naming columns keeps the scan to them."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, on at least as many partitions as there are cores: a table of few files would leave the others idle.

    Tables of many files or splits are read as they are, so only what is small in files is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
