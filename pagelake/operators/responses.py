"""Checks of what models answer: exact fields, unique ids, allowed values; bad answers become findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.canon import BLOCK_TYPES

BLOCKS = "array<struct<id:string,type:string,text:string,reading_order:int>>"
PAGE_FIELDS = ["blocks", "source_lang", "term_mentions", "illustrations"]
BLOCK_FIELDS = ["id", "type", "text", "reading_order"]


def strip_fences(text: Column) -> Column:
    """A JSON text without the code fence around it."""
    return F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*\n?(.*?)\n?```$", "$1")


def parse_pages(rows: DataFrame, key: str, response: str) -> DataFrame:
    """(key, page, fault): the parsed page of each response, or the first fault that makes it unusable.

    Faults in the order of their check: not_json, unknown_field, missing_field, block_fields, block_type, block_id, block_order.
    A null response is not_json.
    """
    text = strip_fences(F.col(response))
    body = F.try_parse_json(text)
    page = F.from_json(text, f"struct<blocks:{BLOCKS},source_lang:string,term_mentions:array<struct<term:string,block_id:string,category:string>>,illustrations:array<string>>")
    r = rows.select(key, text.alias("_t"), body.alias("_v"), page.alias("page"))
    names = F.json_object_keys("_t")
    blocks = F.coalesce(F.col("page.blocks"), F.array().cast(BLOCKS))
    raw = F.from_json(F.get_json_object("_t", "$.blocks"), "array<map<string,string>>")
    fields = lambda m: F.array_sort(F.map_keys(m)) == F.array(*[F.lit(x) for x in sorted(BLOCK_FIELDS)])
    unique = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    fault = (
        F.when(F.col("_v").isNull() | names.isNull(), "not_json")
        .when(F.size(F.array_except(names, F.array(*[F.lit(x) for x in PAGE_FIELDS]))) > 0, "unknown_field")
        .when(~F.array_contains(names, "blocks"), "missing_field")
        .when(~F.coalesce(F.forall(raw, fields), F.lit(False)), "block_fields")
        .when(~F.forall(blocks, lambda b: F.coalesce(b["type"].isin(*BLOCK_TYPES), F.lit(False))), "block_type")
        .when(~F.forall(blocks, lambda b: F.coalesce(F.trim(b["id"]) != "", F.lit(False))) | ~unique(F.transform(blocks, lambda b: b["id"])), "block_id")
        .when(~F.forall(blocks, lambda b: F.coalesce(b["reading_order"] >= 0, F.lit(False))) | ~unique(F.transform(blocks, lambda b: b["reading_order"])), "block_order")
    )
    return r.withColumn("fault", fault).select(key, F.when(F.col("fault").isNull(), F.col("page")).alias("page"), "fault")


def check_entries(entries: DataFrame, candidates: DataFrame, group: str, form: str) -> DataFrame:
    """(group, accepted): whether the entries of a group use all of its candidates' forms, none twice and no other.

    A group without entries is not accepted; a rejected group keeps its exact tier-0 candidates only.
    """
    e = entries.groupBy(group, form).agg(F.count("*").alias("n"))
    c = candidates.select(group, form).distinct().withColumn("known", F.lit(True))
    j = e.join(c, [group, form], "full_outer")
    return j.groupBy(group).agg(F.bool_and(F.coalesce((F.col("n") == 1) & F.col("known"), F.lit(False))).alias("accepted"))


def fallback(candidates: DataFrame, checked: DataFrame, group: str) -> DataFrame:
    """The candidates of tier 0 of groups that were not accepted."""
    return candidates.where("tier = 0").join(checked.where("not accepted").select(group), group, "left_semi")
