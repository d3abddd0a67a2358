"""Filling fixed-capacity containers: shortest-pack-first over the length histogram.

Only the histogram of item lengths (at most ``capacity`` rows for each key) goes to a task; there lengths
are placed longest first, each into the open pack with the most room left, as counts of packing patterns.
The patterns come back as ranges of ranks and are joined to the items by their rank within (key, length).
Ranks are counted within salts and shifted by the salts' counts, so a key or a length that holds a third of
all rows is no single task.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.session import cut
from pagelake.sources.tables import table

#: Parameters: capacity, salts of a ranking, and the ranks that one task matches with the ranges of a length.
CAPACITY, SALTS, RANKS = 2_400, 32, 256


def pack_histogram(histogram: dict[int, int], capacity: int, shortest_first: bool = True) -> list[tuple[int, tuple[int, ...]]]:
    """(number of packs, lengths of a pack) for ``histogram`` (length: count).

    shortest_first puts each length into the open pack with the most room; otherwise into the fullest one that
    still has room for it (best fit).
    """
    packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # by the room left
    rooms: list[int] = []

    def put(room: int, count: int, pack: tuple[int, ...]) -> None:
        if room not in packs:
            packs[room] = []
            insort(rooms, room)
        packs[room].append((count, pack))

    def take(i: int) -> tuple[int, int, tuple[int, ...]]:
        room = rooms[i]
        count, pack = packs[room].pop()
        if not packs[room]:
            del packs[room]
            rooms.pop(i)
        return room, count, pack

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            i = len(rooms) - 1 if shortest_first else bisect_left(rooms, size)
            if 0 <= i < len(rooms) and rooms[i] >= size:
                room, count, pack = take(i)
                now = min(count, left) if size else 1
                if count > now:
                    put(room, count - now, pack)
                put(room - size, now, pack + (size,) * (1 if size else left))
                left -= now if size else left
            else:
                fit = capacity // size if size else left
                if left >= fit:
                    put(capacity - fit * size, left // fit, (size,) * fit)
                if left % fit:
                    put(capacity - left % fit * size, 1, (size,) * (left % fit))
                left = 0
    return [(count, pack) for room in sorted(packs) for count, pack in packs[room]]


def _plan(capacity: int):
    """One key's histogram to ranges: the items of a length with ranks first..last go, ``each`` to a pack, to packs from ``pack`` on."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        histogram = {int(s): int(n) for s, n in zip(pdf["size"], pdf["n"])}
        packs = min((pack_histogram(histogram, capacity, first) for first in (True, False)), key=lambda p: sum(n for n, _ in p))
        used, pack, rows = dict.fromkeys(histogram, 1), 0, []
        for count, lengths in packs:
            for size in dict.fromkeys(lengths):
                each = lengths.count(size)
                rows.append((key[0], size, used[size], used[size] + count * each - 1, each, pack))
                used[size] += count * each
            pack += count
        return pd.DataFrame(rows, columns=["key", "size", "first", "last", "each", "pack"])

    return run


def pack_items(items: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """(key, id, part, size, batch): each part of each item with its batch, numbered from 0 within its key.

    ``items``: (key, id, entries), entries the lengths of what an item consists of. An item above ``capacity`` is
    divided between its entries, in their order, into parts of at most ``capacity`` (an entry that is itself longer is
    cut by length); all others stay whole. A repeated (key, id) is one item, the longest of its rows; a null id is
    ignored; null entries count 0, and null or no entries make an item of length 0, which is put into any batch;
    a null key is a key of its own. No items give no rows. Of shortest-pack-first and best fit the plan with fewer
    batches is taken, shortest-pack-first if equal. An item is divided if its parts lie in several batches.
    """
    lengths = "transform(coalesce(entries, array()), x -> cast(coalesce(x, 0) as int))"
    one = items.where("id is not null").select("key", "id", F.expr(lengths).alias("e")).withColumn("size", F.expr("aggregate(e, 0L, (a, x) -> a + x)"))
    one = one.groupBy("key", "id").agg(F.max(F.struct("size", "e")).alias("m")).select("key", "id", "m.size", "m.e")
    # parts: full ones, then the open one; a too long entry closes the open part and is cut
    parts = F.expr(
        f"""aggregate(e, struct(array() :: array<int> as done, 0 as cur),
        (a, x) -> case when a.cur + x <= {capacity} then struct(a.done as done, a.cur + x as cur)
          else struct(concat(a.done, if(a.cur > 0, array(a.cur), array()), if(x > {capacity}, array_repeat({capacity}, cast((x - 1) div {capacity} as int)), array())) as done,
            if(x > {capacity}, cast((x - 1) % {capacity} + 1 as int), x) as cur) end,
        a -> if(a.cur > 0 or size(a.done) = 0, array_append(a.done, a.cur), a.done))"""
    )
    pieces = one.select("key", "id", F.posexplode(parts).alias("part", "size"))
    pieces = cut(pieces.withColumn("salt", F.pmod(F.xxhash64("id", "part"), F.lit(salts)).cast("int")))
    per = pieces.groupBy("key", "size", "salt").agg(F.count("*").alias("c"))
    before = per.withColumn("before", F.sum("c").over(W.partitionBy("key", "size").orderBy("salt")) - F.col("c")).select("key", "size", "salt", "before")
    ranges = per.groupBy("key", "size").agg(F.sum("c").alias("n")).groupBy("key").applyInPandas(_plan(capacity), "key string, size int, first long, last long, each int, pack long")
    same = lambda a, b, *on: [a[c].eqNullSafe(b[c]) for c in on]
    ranked = pieces.withColumn("r", F.row_number().over(W.partitionBy("key", "size", "salt").orderBy("id", "part")))
    # ranks and ranges meet in stretches of RANKS, so a length that most items have is many small joins
    ranked = ranked.join(before, same(ranked, before, "key", "size", "salt")).select(ranked["*"], (F.col("r") + F.col("before")).alias("rank")).withColumn("at", F.floor(F.col("rank") / RANKS))
    ranges = ranges.withColumn("at", F.explode(F.sequence(F.floor(F.col("first") / RANKS), F.floor(F.col("last") / RANKS))))
    packed = ranked.join(ranges, [*same(ranked, ranges, "key", "size", "at"), ranked["rank"].between(ranges["first"], ranges["last"])])
    return packed.select(ranked["key"], "id", "part", ranked["size"], (F.col("pack") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).alias("batch"))


def group_items(spark: SparkSession, root: str) -> DataFrame:
    """term_groups as items of a book; the entries are the texts of the group in UTF-8 bytes."""
    g = table(spark, root, "term_groups", "group_id", "book_id", "normalized_term", "forms", "provenance")
    texts = "concat(array(normalized_term), coalesce(forms, array()), coalesce(provenance, array()))"
    return g.select(F.col("book_id").alias("key"), F.col("group_id").alias("id"), F.expr(f"transform({texts}, x -> octet_length(x))").alias("entries"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """The groups that the plan lays into more than one batch."""
    packed = pack_items(group_items(spark, root)).groupBy("key", "id").agg(F.min("batch").alias("first"), F.max("batch").alias("last"))
    return packed.where("first < last").select(F.col("id").alias("group_id")).distinct()


def p4_batches(spark: SparkSession, root: str) -> DataFrame:
    """One row per batch: its groups in order and its size."""
    packed = pack_items(group_items(spark, root))
    return packed.groupBy(F.col("key").alias("book_id"), F.col("batch")).agg(F.array_sort(F.collect_set("id")).alias("group_ids"), F.sum("size").alias("token_count"))


def p4_fill(spark: SparkSession, root: str) -> DataFrame:
    """Per book: batches, the least that could hold its size, and the room left unused."""
    packed = pack_items(group_items(spark, root))
    books = packed.groupBy(F.col("key").alias("book_id")).agg(F.countDistinct("batch").alias("batches"), F.sum("size").alias("size"))
    return books.select("book_id", "batches", "size", F.ceil(F.col("size") / CAPACITY).alias("least"), (F.col("batches") * CAPACITY - F.col("size")).alias("unused"))


def p4_invariants(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the batches: none above the capacity, each group whole in one unless divided, all groups and all their size."""
    packed = pack_items(group_items(spark, root))
    batches = packed.groupBy("key", "batch").agg(F.sum("size").alias("n"))
    groups = packed.groupBy("key", "id").agg(F.countDistinct("batch").alias("in"), F.sum("size").alias("n"))
    over = batches.agg(F.count_if(F.col("n") > CAPACITY).alias("over"))
    rest = groups.agg(F.count_if((F.col("in") > 1) & (F.col("n") <= CAPACITY)).alias("parted"), F.count("*").alias("groups"), F.sum("n").alias("tokens"))
    return over.join(F.broadcast(rest))


QUERIES = {"p4_found": p4_found, "p4_batches": p4_batches, "p4_fill": p4_fill, "p4_invariants": p4_invariants}
_SIZE = """coalesce(strlen(normalized_term), 0) + coalesce(list_sum(list_transform(forms, lambda x: strlen(x))), 0)
  + coalesce(list_sum(list_transform(provenance, lambda x: strlen(x))), 0)"""
SQL = {
    "p4_invariants": f"select 0::bigint as over, 0::bigint as parted, count(*) as groups, sum(n)::bigint as tokens from (select book_id, group_id, max({_SIZE}) as n from term_groups where group_id is not null group by 1, 2)",
    "p4_found": f"select distinct group_id from term_groups where {_SIZE} > 2400",
}
