"""Ingest, segments and page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions.canon import BLOCK_TYPES


def dedupe(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the least by ``order``; partial aggregation comes before the shuffle. Null keys stay one row."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def once(df: DataFrame, key: str) -> DataFrame:
    """``df`` with repeated rows of one key as one; only rows whose key is repeated are shuffled with all their columns.

    The repeated keys are found on the key alone. While they are few, they are sent along and no other row moves.
    """
    twice = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return df.join(twice, key, "left_anti").unionByName(df.join(twice, key, "left_semi").dropDuplicates([key]))


def reconcile(current: DataFrame, history: DataFrame, key: str, ident: str) -> DataFrame:
    """``current`` with status new, reused or ambiguous and the id found, by 0, 1 or more ids that ``history`` has for the key."""
    h = history.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(ident).alias("known"), F.min(ident).alias("known_id"))
    n = F.coalesce("known", F.lit(0))
    return current.join(h, key, "left").withColumn("status", F.when(n == 0, "new").when(n == 1, "reused").otherwise("ambiguous")).withColumn("known_id", F.when(n == 1, F.col("known_id"))).drop("known")


def missing(history: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Rows of ``history`` whose key ``current`` does not have."""
    return history.join(current.select(key), key, "left_anti")


def blocks(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per block: the kept columns, item (position), block_id, type, text, reading_order. Empty pages give none."""
    b = pages.select(*keep, F.posexplode("blocks").alias("item", "b"))
    return b.select(*keep, "item", F.col("b.id").alias("block_id"), F.col("b.type").alias("type"), F.col("b.text").alias("text"), F.col("b.reading_order").alias("reading_order"))


def segments(rows: DataFrame, page: str, anchor: Column) -> DataFrame:
    """Segments of a page, (page, anchor, kind, text, reading_order from 1, placements, diagnostic).

    Illustrations are left out. A page with a bad block (unknown type, blank text, negative order), or with two different
    anchors in one place, is one diagnostic placeholder. Equal anchors are one segment with all their placements counted.
    """
    s = rows.where("type is null or type <> 'illustration'").select(page, F.col("type").alias("kind"), "text", (F.col("reading_order") + 1).alias("reading_order"), anchor.alias("anchor"))
    bad = F.col("kind").isNull() | ~F.col("kind").isin(*BLOCK_TYPES) | F.col("text").isNull() | (F.trim("text") == "") | (F.col("reading_order") < 1)
    per = s.groupBy(page, "reading_order").agg(F.countDistinct("anchor").alias("anchors"), F.max(bad.cast("int")).alias("bad"))
    per = per.groupBy(page).agg(F.max(F.greatest("bad", (F.col("anchors") > 1).cast("int"))).alias("bad"))
    good = s.join(per.where("bad = 0").select(page), page, "left_semi").groupBy(page, "anchor").agg(F.min("kind").alias("kind"), F.min("text").alias("text"), F.min("reading_order").alias("reading_order"), F.count("*").alias("placements"))
    held = per.where("bad > 0").select(page, F.lit(None).cast("string").alias("anchor"), F.lit("diagnostic").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("reading_order"), F.lit(1).cast("long").alias("placements"))
    return good.withColumn("diagnostic", F.lit(False)).unionByName(held.withColumn("diagnostic", F.lit(True)))


def page_texts(rows: DataFrame, page: str, separator: str = "\n\n") -> DataFrame:
    """(page, text): the texts of a page's blocks in order, without illustrations and null texts."""
    t = rows.where("type is distinct from 'illustration' and text is not null")
    ordered = F.array_sort(F.collect_list(F.struct("reading_order", "item", "text")))
    return t.groupBy(page).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), separator).alias("text"))


#: Pages of a span: windows run over spans of a book, and spans hand each other their ends, so a long book is no single task.
SPAN = 256


def _spans(rows: DataFrame, book: str, page: str) -> DataFrame:
    return rows.withColumn("_span", F.floor(F.col(page) / SPAN))


def _next_spans(ends: DataFrame, book: str, first: str, last: str) -> DataFrame:
    """(book, _span, _before, _after): the last of the span before and the first of the span after; one row a span."""
    w = W.partitionBy(book).orderBy("_span")
    return ends.select(book, "_span", F.lag(last).over(w).alias("_before"), F.lead(first).over(w).alias("_after"))


def neighbours(rows: DataFrame, book: str, order: list[str], value: Column, usable: Column) -> DataFrame:
    """``rows`` with the value before and after each in its book; a neighbour that is not usable is left out, not skipped.

    order: the page number first, then what makes it total. A null book or page is a group of its own.
    """
    held = F.struct(usable.alias("ok"), value.alias("v"))
    r = _spans(rows, book, order[0])
    at = F.struct(*order)
    ends = r.groupBy(book, "_span").agg(F.min_by(held, at).alias("_first"), F.max_by(held, at).alias("_last"))
    edge = _next_spans(ends, book, "_first", "_last").withColumnsRenamed({book: "_b", "_span": "_s"})
    w = W.partitionBy(book, "_span").orderBy(*order)
    r = r.withColumn("_p", F.lag(held).over(w)).withColumn("_n", F.lead(held).over(w))
    r = r.join(edge, r[book].eqNullSafe(edge["_b"]) & r["_span"].eqNullSafe(edge["_s"]))
    before, after = F.coalesce("_p", "_before"), F.coalesce("_n", "_after")
    return r.withColumn("previous", F.when(before["ok"], before["v"])).withColumn("following", F.when(after["ok"], after["v"])).drop("_p", "_n", "_before", "_after", "_span", "_b", "_s")


def boundaries(rows: DataFrame, book: str, page: str) -> DataFrame:
    """(book, page, head, tail, previous_tail, next_head): first and last block of each page with those of its neighbours."""
    per = rows.groupBy(book, page).agg(F.min_by("text", F.struct("reading_order", "item")).alias("head"), F.max_by("text", F.struct("reading_order", "item")).alias("tail"))
    r = _spans(per, book, page)
    ends = r.groupBy(book, "_span").agg(F.min_by("head", page).alias("_first"), F.max_by("tail", page).alias("_last"))
    edge = _next_spans(ends, book, "_first", "_last").withColumnsRenamed({book: "_b", "_span": "_s"})
    w = W.partitionBy(book, "_span").orderBy(page)
    r = r.withColumn("_p", F.lag("tail").over(w)).withColumn("_n", F.lead("head").over(w))
    r = r.join(edge, r[book].eqNullSafe(edge["_b"]) & r["_span"].eqNullSafe(edge["_s"]))
    return r.select(book, page, "head", "tail", F.coalesce("_p", "_before").alias("previous_tail"), F.coalesce("_n", "_after").alias("next_head"))


def first_seen(rows: DataFrame, group: str, value: str, order: Column) -> DataFrame:
    """(group, value, rank): distinct values of a group in the order in which they are first seen."""
    first = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(order).alias("at"))
    return first.select(group, value, F.row_number().over(W.partitionBy(group).orderBy("at", value)).alias("rank"))
