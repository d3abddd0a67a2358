"""Folders of page images, manifests and validation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions.ids import page_id, placement_id

IMAGES = "*.{jpg,jpeg,png,webp,heic,JPG,JPEG,PNG,WEBP,HEIC}"
BLOCK = "struct<id:string,type:string,text:string,reading_order:int>"
MENTION = "struct<term:string,block_id:string,category:string>"
CASE = f"""name string, fixture_image string,
source struct<page_number:int,image_path:string,sha256:string,phash:string,source_lang:string,model:string,blocks:array<{BLOCK}>,term_mentions:array<{MENTION}>,illustrations:array<string>>,
translation struct<page_number:int,source_lang:string,target_lang:string,page_text:string,translated_text:string,blocks:array<{BLOCK}>,translated_blocks:array<struct<block_id:string,translated_text:string>>,term_mentions:array<{MENTION}>,illustrations:array<string>>,
glossary struct<version:string,hash:string,source_lang:string,target_lang:string,entries:array<struct<concept_id:string,source_terms:array<string>,target_term:string,provenance:array<string>,confidence:double,notes:string>>>,
expected struct<block_schema:boolean,non_empty_text:boolean,translation_language:boolean,illustration_count:boolean,block_id_correspondence:boolean,glossary_consistency:boolean>, risk_tags array<string>"""


def page_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length, sha256, page_id, placement_id, content) of the images in a folder; bytes are hashed, not decoded."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    sha = F.sha2("content", 256)
    f = f.select("path", name.alias("name"), "length", sha.alias("sha256"), "content").withColumn("page_id", page_id(F.col("sha256")))
    return f.withColumn("placement_id", placement_id(F.col("page_id"), F.col("sha256"), F.col("name")))


def manifest(images: DataFrame) -> DataFrame:
    """(page_number, filename): the file names numbered from 1 in order; names with a path in them are left out."""
    n = images.select(F.col("name").alias("filename")).where(~F.col("filename").rlike(r"[/\\]|^\.")).distinct()
    # file names of one folder: numbered by one sort, whose size is the number of its files
    return n.select(F.row_number().over(W.orderBy("filename")).alias("page_number"), "filename")


def validation_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The cases under ``folder``/*/config.json with a fixed schema; a field of another type fails the read."""
    return spark.read.schema(CASE).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/*/config.json").orderBy("name")


def state_size(spark: SparkSession, folder: str) -> DataFrame:
    """One row (files, bytes) for all files below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return f.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
