"""Effective content: native or translated segments, their mappings, pairings and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions.canon import blank


def effective_segments(source: DataFrame, translated: DataFrame | None, on: list[str], lang: str, target: Column | None = None) -> DataFrame:
    """Source rows with effective_text, render_lang and mode.

    Native: the source text in its language, or und. Translated: the translation in the target language; a segment without a
    usable one is 'diagnostic' and has no text, so modes are never mixed unseen. translated: (on, translated_text, target_lang).
    """
    if translated is None:
        return source.withColumn("effective_text", F.col("text")).withColumn("render_lang", F.coalesce(F.nullif(F.trim(lang), F.lit("")), F.lit("und"))).withColumn("mode", F.lit("native"))
    t = translated.groupBy(*on).agg(F.min(F.when(~blank(F.col("translated_text")), F.struct("translated_text", "target_lang"))).alias("t"))
    j = source.join(t, on, "left")
    ok = F.col("t").isNotNull()
    return j.withColumn("effective_text", F.col("t.translated_text")).withColumn("render_lang", F.when(ok, F.col("t.target_lang")).otherwise("und")).withColumn("mode", F.when(ok, "translated").otherwise("diagnostic")).drop("t")


def target_spans(text: Column, targets: Column) -> Column:
    """array<struct<target, start, end>>: each target string found from where the last match of the same string ended, in order.

    0-based code points; a string that does not occur any more gives start -1. Folded inside the row.
    """
    kind = "array<struct<target:string,start:int,end:int>>"

    def step(a: Column, t: Column) -> Column:
        ends = F.transform(F.filter(a, lambda x: (x["target"] == t) & (x["start"] >= 0)), lambda x: x["end"])
        begin = F.coalesce(F.array_max(ends), F.lit(0))
        at = F.call_function("locate", t, text, begin + 1)
        return F.array_append(a, F.struct(t.alias("target"), (at - 1).cast("int").alias("start"), F.when(at > 0, at - 1 + F.length(t)).otherwise(-1).cast("int").alias("end")))

    return F.aggregate(targets, F.array().cast(kind), step)


def pair_leaves(old: DataFrame, new: DataFrame, subject: list[str], leaf: str) -> DataFrame:
    """(subject, old_leaf, new_leaf): leaves of one stable subject before and after a refresh; only subjects that both have."""
    return old.select(*subject, F.col(leaf).alias("old_leaf")).join(new.select(*subject, F.col(leaf).alias("new_leaf")), subject)


def variant_names(rows: DataFrame, base: list[str], variant: str) -> DataFrame:
    """(base, variant, name): distinct variants of a base with an ordinal in their name, if there is more than one."""
    d = rows.select(*base, variant).distinct()
    w = W.partitionBy(*base)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(variant))
    stem = F.concat_ws("/", *base)
    return d.withColumn("name", F.when(n > 1, F.concat_ws("#", stem, i.cast("string"))).otherwise(stem))


def placements(placed: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """Every placement with its logical page; a page placed twice is rendered twice."""
    return placed.join(pages, page)


def safe_path(path: Column) -> Column:
    """Whether a path is relative, with plain parts and forward slashes only."""
    return F.coalesce((path != "") & ~path.rlike(r"\\|//|^/|/$|(?:^|/)\.{1,2}(?:/|$)|[\x00-\x1f]"), F.lit(False))
