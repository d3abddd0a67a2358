"""Evaluation texts inside training texts: an FM-index per shard of the corpus, searched for test phrases.

Each task gathers its documents into shards of at most SHARD words and indexes each once; every phrase of SEED words of
every test item is found by backward search and located by sampled suffix positions. Occurrences of an item in
a document are chained along the text and stretched over single changed words; a chain that spans a third of the
item is a leak, and its place in the text is a span to remove. A stretch that agrees in AGREE of its places has a run of SEED
agreeing words, so no leak is missed by the seeds. No document meets another, so nothing is shuffled; the test items
travel to the tasks in blocks of at most PART letters, one of which a task holds at a time.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.fmindex import FMIndex
from pagelake.sources.tables import spread, table

#: Parameters: words of a seed (characters where a script has no spaces), words of a shard, letters of items of a block, the part of an
#: item that counts as a leak, the least part of a stretch's places that agree, and how far a stretch may shift at a change.
SEED, SHARD, PART, LEAK, AGREE, SHIFT = 3, 400_000, 4_000_000, 1 / 3, 0.7, 3
_WIDE = r"\p{Han}\p{Hiragana}\p{Katakana}ー"
_TOKEN = regex.compile(rf"[{_WIDE}]\p{{M}}*|(?:(?![{_WIDE}])[\p{{L}}\p{{M}}\p{{N}}\p{{Cf}}])+(?:[-­¬‐]\s*\n\s*(?:(?![{_WIDE}])[\p{{L}}\p{{M}}\p{{N}}])+)*")
_ASCII = re.compile(r"[A-Za-z0-9]+(?:-\s*\n\s*[A-Za-z0-9]+)*")
_ESCAPED = re.compile(r'\\[nrt"]')
_DROP = regex.compile(r"[\p{Cf}\p{Pd}¬\s]+")
_LINE_QUESTION = regex.compile(r"[?？؟]\s*$|^\s*\p{L}+\s*[:：]")


class Words:
    """Words of texts in one form (NFKC, case folded, no format characters), with a memory of seen ones."""

    def __init__(self):
        self.seen: dict[str, str] = {}

    def form(self, raw: str) -> str:
        w = self.seen.get(raw)
        if w is None:
            w = unicodedata.normalize("NFKC", _DROP.sub("", unicodedata.normalize("NFKC", raw).casefold()))
            if len(self.seen) < 500_000:
                self.seen[raw] = w
        return w

    def split(self, text: str) -> list[str]:
        """The words of a text."""
        text = _plain(text)
        raw = (_ASCII if text.isascii() else _TOKEN).findall(text)
        seen = self.seen
        return [w for w in [seen[r] if r in seen else self.form(r) for r in raw] if w]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where the words of :meth:`split` stand."""
        text = _plain(text)
        return [m.span() for m in (_ASCII if text.isascii() else _TOKEN).finditer(text) if self.form(m.group())]


def _plain(text: str) -> str:
    return _ESCAPED.sub("  ", text) if "\\" in text else text


def _lines(text: str | None) -> list[str]:
    return [x for x in (text or "").split("\n") if x.strip()]


def _head(text: str | None) -> str | None:
    """The first line of several, in the form in which items share it."""
    lines = _lines(text)
    return lines[0].strip().casefold() if len(lines) > 1 else None


def _passage(text: str | None, shared: bool) -> str:
    lines = _lines(text)
    if len(lines) > 1 and shared:
        lines = lines[1:]
    while len(lines) > 1 and _LINE_QUESTION.search(lines[-1]):
        lines = lines[:-1]
    return "\n".join(lines)


def passages(items: DataFrame) -> DataFrame:
    """(item_id, text): distinct items without their instruction and question lines.

    A line is one if it ends in a question mark or starts with a label and is the last of several, or if it is the first of
    several and other items, of all there are, begin with it too. Null and blank items give no row.
    """
    i = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    i = i.withColumn("head", F.pandas_udf(lambda t: t.map(_head), "string")("text"))
    shared = i.where("head is not null").groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head", F.lit(True).alias("shared"))
    cut_ = F.pandas_udf(lambda t, s: pd.Series([_passage(x, bool(y)) for x, y in zip(t, s)]), "string")
    j = i.join(shared, "head", "left").select("item_id", cut_("text", F.coalesce("shared", F.lit(False))).alias("text"))
    return j.where("text <> ''").distinct()


class Block:
    """A block of items: their words, the items one after another as numbers of words, and their seeds."""

    def __init__(self, items: list[tuple[int, str]], leak: float = LEAK, agree: float = AGREE):
        words = Words()
        numbers: dict[str, int] = {}
        seeds: dict[int, list[tuple[int, ...]]] = {}
        where: dict[int, list[tuple[int, int]]] = {}
        needed, flat, sizes, starts = [], [], [], [0]
        for n, (_, text) in enumerate(items):
            w = words.split(text)
            ids = [numbers.setdefault(x, len(numbers)) for x in w]
            size = [len(x) for x in w]
            k = min(SEED, len(ids))
            # a leak has at least the fewest words that make up its part, and of its places at most 1 - agree change
            fewest = int(np.searchsorted(np.cumsum(sorted(size, reverse=True)), leak * sum(size))) + 1 if ids else 0
            needed.append(max(1, math.ceil(fewest * (agree - (k - 1) * (1 - agree)) - (k - 1) - 1e-9)))
            for i in range(len(ids) - k + 1 if k else 0):
                seeds.setdefault(k, []).append(tuple(ids[i : i + k]))
                where.setdefault(k, []).append((n, i))
            flat += ids
            sizes += size
            starts.append(len(flat))
        self.words, self.ids, self.needed = list(numbers), [x for x, _ in items], np.array(needed, np.int64)
        self.flat, self.starts, self.letters = np.array(flat, np.int64), np.array(starts), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self.longest = int(np.diff(self.starts).max(initial=0))
        self.seeds = {k: (np.array(v), np.array(where[k])) for k, v in seeds.items()}


#: Places to go on at after a change, as words to skip in the document and in the item, the least change first.
_SKIPS = [x for k in range(1, 2 * SHIFT + 1) for x in ((k, k), *((k, j) for j in range(k - 1, max(-1, k - SHIFT - 1), -1)), *((j, k) for j in range(k - 1, max(-1, k - SHIFT - 1), -1)))]


def stretch(doc: np.ndarray, item: np.ndarray, d: np.ndarray, i: np.ndarray, doc_ends: tuple[np.ndarray, np.ndarray], item_ends: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The stretches of agreement around doc[d] = item[i], all at once: (doc from, to, item from, to, places that agree, places that differ).

    d and i are arrays of places, the ends the first place and the place after the last of the document and the item of each. A
    stretch is carried on over a changed, missing or added word while two of the next words agree.
    """
    same, changed = np.ones(len(d), np.int64), np.zeros(len(d), np.int64)
    reached = []
    for step in (1, -1):
        x, y = d.copy(), i.copy()
        going = np.arange(len(d))
        inside = lambda at, ends, who: (at >= ends[0][who]) & (at < ends[1][who])
        while len(going):
            a, b = x[going] + step, y[going] + step
            ok = inside(a, doc_ends, going) & inside(b, item_ends, going)
            going, a, b = going[ok], a[ok], b[ok]
            equal = doc[a] == item[b]
            on = going[equal]
            x[on], y[on] = a[equal], b[equal]
            same[on] += 1
            open_, a, b = going[~equal], a[~equal], b[~equal]
            after = [on]
            for u, v in _SKIPS:
                if not len(open_):
                    break
                p, q = a + step * u, b + step * v
                fits = inside(p, doc_ends, open_) & inside(q, item_ends, open_)
                fits[fits] = doc[p[fits]] == item[q[fits]]
                k = np.flatnonzero(fits)
                if len(k):
                    who, p, q = open_[k], p[k], q[k]
                    ends = ~inside(q + step, item_ends, who)
                    two = ~ends & inside(p + step, doc_ends, who)
                    two[two] = doc[p[two] + step] == item[q[two] + step]
                    good = ends | two
                    who, k = who[good], k[good]
                    x[who], y[who] = p[good], q[good]
                    same[who] += 1
                    changed[who] += max(u, v)
                    after.append(who)
                    rest = np.ones(len(open_), bool)
                    rest[k] = False
                    open_, a, b = open_[rest], a[rest], b[rest]
            going = np.concatenate(after)
        reached.append((x, y))
    (d1, i1), (d0, i0) = reached
    return d0, d1 + 1, i0, i1 + 1, same, changed


class Shard:
    """Documents as numbers of their own words, and the FM-index over them."""

    def __init__(self, docs: list[list[str]]):
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        # a one parts the documents
        flat = [x for words in docs for x in (*[number(w, len(self.vocabulary) + 2) for w in words], 1)]
        self.text = np.array(flat, np.int64)
        self.begins = np.cumsum([0] + [len(words) + 1 for words in docs])
        self.index = FMIndex(self.text, len(self.vocabulary) + 2) if self.vocabulary else None

    def search(self, block: Block, leak: float, agree: float) -> list[tuple[int, int, int, int, float]]:
        """(doc number, item id, first word, end word, part of the item) of every leak of a block's items."""
        if not self.index or not block.seeds:
            return []
        known = np.array([self.vocabulary.get(w, 0) for w in block.words], np.int64)
        hits = []
        for seeds, where in block.seeds.values():
            here = known[seeds]
            there = (here > 0).all(1)
            which, at = self.index.locate(*self.index.search(here[there]))
            hits.append((where[there][which, 0], where[there][which, 1], at))
        items, places, at = (np.concatenate(x) for x in zip(*hits))
        if not len(at):
            return []
        doc = np.searchsorted(self.begins, at, "right") - 1
        pair = doc * len(block.ids) + items
        _, inverse = np.unique(pair, return_inverse=True)
        # different places of an item in a document, by sorting (pair, place) as one number
        keys = np.unique(inverse * (int(places.max()) + 1) + places) // (int(places.max()) + 1)
        enough = np.bincount(keys)[inverse] >= block.needed[items]
        # words that the shard does not have are equal to none of its own
        words = np.where(known[block.flat] > 0, known[block.flat], -1)
        i = block.starts[items] + places
        # of a run of agreeing words the first seed speaks for all
        first = (places == 0) | (at == self.begins[doc]) | (self.text[np.maximum(at - 1, 0)] != words[np.maximum(i - 1, 0)])
        chosen = enough & first
        doc, items, at, i = doc[chosen], items[chosen], at[chosen], i[chosen]
        d0, d1, i0, i1, same, changed = stretch(self.text, words, at, i, (self.begins[doc], self.begins[doc + 1] - 1), (block.starts[items], block.starts[items + 1]))
        span, total = block.letters[i1] - block.letters[i0], block.letters[block.starts[items + 1]] - block.letters[block.starts[items]]
        good = (span >= leak * total) & (same >= agree * (same + changed))
        rows = zip(doc[good], items[good], (d0 - self.begins[doc])[good], (d1 - self.begins[doc])[good], (span / np.maximum(total, 1))[good])
        return sorted({(int(p), block.ids[q], int(x), int(y), float(f)) for p, q, x, y, f in rows})


def leaks(docs: DataFrame, items: DataFrame, leak: float = LEAK, agree: float = AGREE, shard: int = SHARD, part: int = PART) -> DataFrame:
    """(doc_id, item_id, start, end, part): every stretch of an item of ``items`` (item_id, text) in ``docs`` (doc_id, text).

    start and end are character positions in the document's text, part the share of the item that the stretch spans.
    Null or wordless texts hold and give nothing away; repeated rows count once; other columns are ignored; an item
    shorter than a seed is looked for as a whole. Documents above a shard's words are read in pieces that overlap by
    twice the longest item. ``shard`` and ``part`` change the cost, not the rows.
    """
    sc = docs.sparkSession.sparkContext
    blocks, overlap = [], 0
    for held in _blocks(passages(items), part):
        block = Block(held, leak, agree)
        overlap = max(overlap, 2 * block.longest)
        blocks.append(sc.broadcast(block))

    def flush(held: list[tuple], words: Words) -> pd.DataFrame:
        rows, one = [], Shard([w for _, w, _, _ in held])
        spans: dict[int, list[tuple[int, int]]] = {}
        for b in blocks:
            for n, item, x, y, share in one.search(b.value, leak, agree):
                k, _, text, begin = held[n]
                if n not in spans:
                    spans[n] = words.spans(text)
                rows.append((k, item, spans[n][begin + x][0], spans[n][begin + y - 1][1], float(share)))
            if len(blocks) > 1:
                # a task holds one block at a time; the next use reads it again from the executor's disk
                b.__dict__.pop("_value", None)
        return pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "part"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, words = [], 0, Words()
        for b in batches:
            for k, t in zip(b["doc_id"], b["text"]):
                w = words.split(t) if t else []
                for i in range(0, max(len(w), 1), max(shard - overlap, overlap + 1, 1)):
                    held.append((k, w[i : i + max(shard, 2 * overlap + 1)], t, i))
                    n += len(held[-1][1])
                    if n >= shard:
                        yield flush(held, words)
                        held, n = [], 0
        if held:
            yield flush(held, words)

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, start int, end int, part double"
    return docs.select("doc_id", "text").mapInPandas(run, kinds).distinct()


def _blocks(passages: DataFrame, part: int) -> Iterator[list[tuple[int, str]]]:
    """The passages in blocks of about ``part`` letters, streamed through the driver."""
    held, size = [], 0
    for r in passages.orderBy("item_id", "text").toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1])
        if size >= part:
            yield held
            held, size = [], 0
    if held:
        yield held


def removal_spans(found: DataFrame) -> DataFrame:
    """(doc_id, start, end, item_ids): overlapping or touching spans of a document merged."""
    cols = "array_sort(collect_list(struct(start, end, item_id)))"
    merged = F.expr(
        """aggregate(s, array() :: array<struct<start int, end int, item_ids array<bigint>>>, (a, x) ->
        case when size(a) > 0 and element_at(a, -1).end >= x.start then
          array_append(slice(a, 1, size(a) - 1), named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end),
            'item_ids', array_sort(array_union(element_at(a, -1).item_ids, array(x.item_id)))))
        else array_append(a, named_struct('start', x.start, 'end', x.end, 'item_ids', array(x.item_id))) end)"""
    )
    per = found.groupBy("doc_id").agg(F.expr(cols).alias("s"))
    return per.select("doc_id", F.explode(merged).alias("m")).select("doc_id", "m.start", "m.end", "m.item_ids")


def _found(spark: SparkSession, root: str) -> DataFrame:
    return leaks(spread(table(spark, root, "documents", "doc_id", "text")), table(spark, root, "eval_items", "item_id", "text"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return _found(spark, root).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, root: str) -> DataFrame:
    return removal_spans(_found(spark, root))


def p8_invariants(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the stretches: inside their document, of known items, and no removal span touching another."""
    found = _found(spark, root)
    d = table(spark, root, "documents", "doc_id", F.length("text").alias("n"))
    i = table(spark, root, "eval_items", F.col("item_id"), F.lit(True).alias("known")).distinct()
    j = found.join(d, "doc_id", "left").join(F.broadcast(i), "item_id", "left")
    one = j.agg(F.count_if(~F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("n")), F.lit(False))).alias("outside"), F.count_if(F.col("known").isNull()).alias("strange"))
    spans = removal_spans(found)
    a, b = (spans.select("doc_id", F.col("start").alias(f"s{x}"), F.col("end").alias(f"e{x}")) for x in "ab")
    touching = a.join(b, "doc_id").where("sa < sb and ea >= sb").agg(F.count("*").alias("touching"))
    return one.join(F.broadcast(touching))


QUERIES = {"p8_found": p8_found, "p8_spans": p8_spans, "p8_invariants": p8_invariants}
SQL: dict[str, str] = {"p8_invariants": "select 0::bigint as outside, 0::bigint as strange, 0::bigint as touching"}
