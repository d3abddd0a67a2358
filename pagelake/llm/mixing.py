"""Mixing sources to target weights by a min-cost flow with convex repetition costs.

Documents are aggregated by membership pattern (the set of sources that have the text) to token capacities. The
flow goes pattern -> source; the k-th use of a pattern's texts costs k, so every text is used once before
any is used twice. The graph has the patterns and sources as nodes, whatever the number of documents. The
routed tokens are then turned into documents by seeded hash: whole uses for all, and one more for the
documents below a cut that is found from bucket totals, so nothing but aggregates reaches the driver.
"""

from __future__ import annotations

import base64
import warnings
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.session import cut
from pagelake.sources.tables import spread, table

#: Parameters: vocabulary file (each executor must have it), buckets of the seeded choice, seed, patterns above which a warning is given, and uses with a cost of their own.
TOKENIZER, BUCKETS, SEED, PATTERNS, STEPS = "/opt/tokenizers/byte_bpe_50k.tiktoken", 1_024, 7, 10_000, 32
#: What stands for all sources without a target, the word pattern of the public byte-level vocabulary.
OTHER = "\0"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, object] = {}


def token_count(text, path: str = TOKENIZER):
    """Column: tokens of a text under the byte-level vocabulary at ``path``; null and empty texts have 0."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if path not in _ENCODERS:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = _ENCODERS[path].encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0)

    return count(text)


def route(room: dict[tuple[str, ...], dict[str, int]], once: dict[tuple[str, ...], int], quota: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens routed by (pattern, source) at least cost.

    ``once``: tokens of a pattern's texts, each counted once; ``room``: tokens of the records by which each source holds
    them. The k-th use of a pattern's texts costs k, whichever source takes it; a source may take its own records
    ``repeats`` times. Successive shortest paths by Dijkstra with potentials over pattern and source nodes.
    """
    edges: list[list] = []  # to, room, cost, tag
    out: dict[object, list[int]] = {}

    def edge(a, b, room: int, cost: int, tag=None) -> None:
        out.setdefault(a, []).append(len(edges))
        edges.append([b, room, cost, tag])
        out.setdefault(b, []).append(len(edges))
        edges.append([a, 0, -cost, None])

    for s, q in quota.items():
        edge(("source", s), "sink", q, 0)
    for p, of in room.items():
        most = 0
        for s, n in of.items():
            if s in quota and n * repeats[s] > 0:
                edge(("pattern", p), ("source", s), n * repeats[s], 0, (p, s))
                most += n * repeats[s]
        # many copies make many uses: beyond STEPS they are taken together, twice as many each time
        k, wide = 1, 1
        while most > 0:
            edge("start", ("pattern", p), min(once[p] * wide, most), k)
            most -= once[p] * wide
            k += wide
            wide *= 1 + (k > STEPS)
    potential: dict[object, int] = {}
    while True:
        dist, via, heap = {"start": 0}, {}, [(0, 0, "start")]
        n = 0
        while heap:
            d, _, a = heappop(heap)
            if d > dist.get(a, d):
                continue
            for e in out.get(a, ()):
                b, free, cost, _ = edges[e]
                step = d + cost + potential.get(a, 0) - potential.get(b, 0)
                if free > 0 and step < dist.get(b, step + 1):
                    dist[b], via[b] = step, e
                    n += 1
                    heappush(heap, (step, n, b))
        if "sink" not in dist:
            break
        far = max(dist.values())
        for a in out:
            potential[a] = potential.get(a, 0) + dist.get(a, far)
        b, flow = "sink", None
        while b != "start":
            e = via[b]
            flow = edges[e][1] if flow is None else min(flow, edges[e][1])
            b = edges[e ^ 1][0]
        b = "sink"
        while b != "start":
            e = via[b]
            edges[e][1] -= flow
            edges[e ^ 1][1] += flow
            b = edges[e ^ 1][0]
    return {edges[e][3]: edges[e ^ 1][1] for e in range(0, len(edges), 2) if edges[e][3] and edges[e ^ 1][1]}


def mix(docs: DataFrame, targets: DataFrame, seed: int = SEED, buckets: int = BUCKETS, patterns: int = PATTERNS) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares) for docs (id, source, text, size) and targets (source, target_share, max_repeats).

    A row is a record of a source; rows of one ``text`` (any key of it) are one text, and the sources that have it are
    its pattern. mixture: (id, source, uses, size), each record used. shares: (source, target_share, available, quota,
    tokens, share, short): short says that even max_repeats uses of all its records stay below the target, told by the quota
    that the flow leaves open. The mixture is as large as all records together. Null sizes count 0; records of no known
    source add to the total but are not used; a null text is one of its own; a null max_repeats is 1; repeated target rows count once;
    without records all shares are 0. Only (pattern, source) totals reach the driver. Sources without a target count as one in the
    patterns, so their number follows the targets, not the records; above ``patterns`` of them (counted) there is a warning only.
    """
    spark = docs.sparkSession
    goals = {r[0]: (r[1] or 0.0, 1 if r[2] is None else r[2]) for r in targets.where("source is not null").select("source", "target_share", "max_repeats").distinct().collect()}
    source = F.coalesce("source", F.lit(""))
    d = cut(docs.select("id", F.when(source.isin(list(goals)), source).otherwise(OTHER).alias("source"), "text", F.coalesce("size", F.lit(0)).cast("long").alias("size")))
    # only texts of several sources are joined back; that is told from one row a text and source
    several = d.where("text is not null").groupBy("text").agg(F.min("source").alias("lo"), F.max("source").alias("hi"), F.array_sort(F.collect_set("source")).alias("pattern"), F.max("size").alias("one")).where("lo < hi")
    several = cut(several.select("text", "pattern", "one"))
    if (n := several.select("pattern").distinct().count()) > patterns:
        warnings.warn(f"{n} patterns of sources go to the driver", stacklevel=2)
    d = d.join(several.select("text", "pattern"), "text", "left").withColumn("pattern", F.coalesce("pattern", F.array("source")))
    d = cut(d.select("id", "source", "pattern", "size"))
    room: dict[tuple[str, ...], dict[str, int]] = {}
    for p, s, n in d.groupBy("pattern", "source").agg(F.sum("size")).collect():
        room.setdefault(tuple(p), {})[s] = n
    once = {p: sum(of.values()) for p, of in room.items()} | {tuple(r[0]): max(r[1], 1) for r in several.groupBy("pattern").agg(F.sum("one")).collect()}
    total = sum(n for of in room.values() for n in of.values())
    quota = {s: round(g[0] * total) for s, g in goals.items()}
    routed = route(room, once, quota, {s: g[1] for s, g in goals.items()})
    plan = [(list(p), s, n // room[p][s], n % room[p][s]) for (p, s), n in routed.items()]
    plans = spark.createDataFrame(plan, "pattern array<string>, source string, full long, rest long")
    used = d.join(F.broadcast(plans), ["pattern", "source"]).withColumn("bucket", F.pmod(F.xxhash64("id", "source", F.lit(seed)), F.lit(buckets)).cast("int"))
    per = used.groupBy("pattern", "source", "bucket").agg(F.sum("size").alias("b"))
    before = per.withColumn("before", F.sum("b").over(W.partitionBy("pattern", "source").orderBy("bucket")) - F.col("b"))
    used = used.join(before, ["pattern", "source", "bucket"])
    inside = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("b") > F.col("rest"))
    run = F.sum("size").over(W.partitionBy("pattern", "source", "bucket").orderBy(F.xxhash64(F.lit(seed), "id"), "id"))
    edge = used.where(inside).withColumn("more", (F.col("before") + run - F.col("size") / 2 <= F.col("rest")).cast("long"))
    whole = used.where(~inside).withColumn("more", (F.col("before") + F.col("b") <= F.col("rest")).cast("long"))
    mixture = whole.unionByName(edge).select("id", "source", (F.col("full") + F.col("more")).alias("uses"), "size").where("uses > 0")
    got = mixture.groupBy("source").agg(F.sum(F.col("uses") * F.col("size")).alias("tokens"))
    have = {s: sum(of.get(s, 0) for of in room.values()) for s in goals}
    filled = dict.fromkeys(goals, 0)
    for (_, s), n in routed.items():
        filled[s] += n
    # a quota that the flow leaves open, or fills only with all uses there are (it is rounded to whole tokens), is held against the exact target
    short = {s: (filled[s] < quota[s] or filled[s] == have[s] * g[1]) and filled[s] < g[0] * total for s, g in goals.items()}
    rows = [(s, float(g[0]), have[s], quota[s], short[s]) for s, g in goals.items()]
    shares = spark.createDataFrame(rows, "source string, target_share double, available long, quota long, short boolean").join(got, "source", "left")
    shares = shares.withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("share", F.col("tokens") / F.lit(max(total, 1)))
    return mixture, shares


def _mixed(spark: SparkSession, root: str, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    d = spread(table(spark, root, "documents", "doc_id", "source", "text"))
    # equal texts by 128 bits of hash
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(SEED), "text").alias("b"))
    docs = d.select(F.col("doc_id").alias("id"), "source", F.when(F.col("text").isNotNull(), key).alias("text"), token_count(F.col("text"), tokenizer).alias("size"))
    return mix(docs, table(spark, root, "mix_targets"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return _mixed(spark, root)[1].where("short").select("source")


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return _mixed(spark, root)[1].select("source", "target_share", "available", "quota", "tokens", F.round("share", 6).alias("share"), "short")


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    return _mixed(spark, root)[0].withColumnRenamed("id", "doc_id")


def p9_invariants(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the mixture: no document above its source's repeats, none of another source, none twice, no source above its share by more than a document."""
    mixture, shares = _mixed(spark, root)
    t = table(spark, root, "mix_targets", "source", "max_repeats").distinct()
    d = table(spark, root, "documents", "doc_id", F.col("source").alias("of"))
    m = mixture.join(d, mixture["id"] == d["doc_id"]).join(t, "source", "left")
    one = m.agg(F.count_if(F.coalesce(F.col("uses") > F.col("max_repeats"), F.lit(True))).alias("over_used"), F.count_if(F.col("of") != F.col("source")).alias("strange"), (F.count("*") - F.countDistinct("id")).alias("twice"), F.max("size").alias("_most"))
    above = shares.agg(F.max(F.col("tokens") - F.col("quota")).alias("_above"))
    return one.join(F.broadcast(above)).select("over_used", "strange", "twice", F.coalesce(F.col("_above") > F.col("_most"), F.lit(False)).alias("overfilled"))


QUERIES = {"p9_found": p9_found, "p9_shares": p9_shares, "p9_mixture": p9_mixture, "p9_invariants": p9_invariants}
SQL: dict[str, str] = {"p9_invariants": "select 0::bigint as over_used, 0::bigint as strange, 0::bigint as twice, false as overfilled"}
