"""Terminology: occurrences, runs, phrases, technical words, candidates, concepts and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.functions.canon import term_positions

#: Salts of a group in a ranking.
SALTS = 32
WORD = "([\\p{L}\\p{N}_]+)"


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(1))


def separators(text: Column) -> Column:
    """What stands before each word and after the last; one more than words."""
    return F.split(text, "[\\p{L}\\p{N}_]+", -1)


def occurrences(mentions: DataFrame, texts: DataFrame, on: list[str], term: str = "term", text: str = "text") -> DataFrame:
    """Mentions with where they stand in their text as a word, non-overlapping from the left: columns start, end.

    An equi-join on ``on``; a mention that does not occur gives no row.
    """
    j = mentions.where(F.col(term) != "").join(texts, on)
    n = F.length(term)
    at = F.aggregate(term_positions(F.col(text), F.col(term)), F.array().cast("array<int>"), lambda a, i: F.when((F.size(a) == 0) | (F.element_at(a, -1) + n <= i), F.array_append(a, i)).otherwise(a))
    return j.withColumn("start", F.explode(at)).withColumn("end", F.col("start") + n)


def name_runs(rows: DataFrame, key: list[str], text: str = "text", least: int = 2, most: int = 6) -> DataFrame:
    """(key, position, size, phrase): maximal runs of words with a capital first letter, joined by spaces only, of 2 to 6 words.

    Longer runs are dropped whole. The fold runs inside the row, so no word table is shuffled.
    """
    t = F.col(text)
    pairs = F.arrays_zip(words(t).alias("w"), F.slice(separators(t), 1, F.size(words(t))).alias("s"))
    empty = F.array().cast("array<struct<position:int,words:array<string>>>")

    def step(a: Column, x: Column) -> Column:
        i = a["i"]
        capital = x["w"].rlike("^[0-9_]*[\\p{Lu}\\p{Lt}]")
        last = F.element_at(a["runs"], -1)
        goes_on = a["open"] & x["s"].rlike("^\\p{Zs}+\\z")
        grown = F.concat(F.slice(a["runs"], 1, F.size(a["runs"]) - 1), F.array(F.struct(last["position"].alias("position"), F.array_append(last["words"], x["w"]).alias("words"))))
        begun = F.array_append(a["runs"], F.struct(i.alias("position"), F.array(x["w"]).alias("words")))
        return F.struct((i + 1).alias("i"), capital.alias("open"), F.when(~capital, a["runs"]).when(goes_on, grown).otherwise(begun).alias("runs"))

    runs = F.aggregate(pairs, F.struct(F.lit(0).alias("i"), F.lit(False).alias("open"), empty.alias("runs")), step, lambda a: a["runs"])
    out = rows.where(t.isNotNull()).select(*key, F.explode(runs).alias("r"))
    size = F.size("r.words")
    return out.where(size.between(least, most)).select(*key, F.col("r.position").alias("position"), size.alias("size"), F.array_join("r.words", " ").alias("phrase"))


def phrases(rows: DataFrame, block: list[str], text: str = "text", least: int = 2, most: int = 6, within: str | None = None, joins: str = "\\p{Zs}\\p{Pd}'’") -> DataFrame:
    """(within, phrase, size, blocks): word windows of 2 to 6 words, parted by characters of ``joins`` only, in two or more blocks.

    A text is first split where something else stands between words, so every window of a piece counts and no separator is looked at
    twice. Windows are made unique a block, so a row is a block and no window is shuffled before it is counted. With joins "" any
    separator will do.
    """
    t = F.lower(F.col(text))
    word, between = "\\p{L}\\p{N}_", f"[^\\p{{L}}\\p{{N}}_{joins}]"
    pieces = F.array(t) if not joins else F.split(t, f"[^{word}]*{between}[^{word}]*")
    made = lambda w: F.flatten(
        F.transform(F.filter(F.sequence(F.lit(least), F.lit(most)), lambda n: n <= F.size(w)), lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))
    )
    windows = F.array_distinct(F.flatten(F.transform(F.transform(pieces, words), made)))
    group = [within] if within else []
    one = rows.where(F.col(text).isNotNull()).select(*group, F.explode(windows).alias("phrase"))
    size = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1
    return one.groupBy(*group, "phrase").agg(F.count("*").alias("blocks")).where("blocks >= 2").select(*group, "phrase", size.alias("size"), "blocks")


def _marked(found: Column, kind: str) -> Column:
    return F.transform(found, lambda w: F.struct(w.alias("word"), F.lit(kind).alias("kind")))


def technical_words(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, word, kind): ASCII identifiers with a digit or underscore ('identifier'), words of capitals ('capitals'), two ASCII words joined by - or / ('compound')."""
    t = F.col(text)
    found = F.flatten(
        F.array(
            *[
                _marked(F.array_distinct(F.filter(a, f)), k)
                for k, a, f in (
                    ("identifier", words(t), lambda w: w.rlike("^[A-Za-z0-9_]*[A-Za-z][A-Za-z0-9_]*$") & w.rlike("[0-9_]")),
                    ("capitals", words(t), lambda w: w.rlike("^\\p{Lu}{2,}$")),
                    ("compound", F.regexp_extract_all(t, F.lit("([A-Za-z0-9]+[-/][A-Za-z0-9]+)"), F.lit(1)), lambda w: w.isNotNull()),
                )
            ]
        )
    )
    return rows.where(t.isNotNull()).select(*key, F.explode(found).alias("x")).select(*key, "x.word", "x.kind")


def merge_candidates(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, tier, form, blocks, occurrences): candidates of one key merged: least tier, least form, distinct blocks and occurrences.

    rows: (key, tier, form, blocks array, occurrences array). Null arrays are empty.
    """
    sets = lambda c: F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>")))))
    return rows.groupBy(*key).agg(F.min("tier").alias("tier"), F.min("form").alias("form"), sets("blocks").alias("blocks"), sets("occurrences").alias("occurrences"))


def top_candidates(merged: DataFrame, group: str, key: str, limit: int = 64) -> DataFrame:
    """Candidates ranked by (tier, more blocks, more occurrences, key, form); those of tier 0 and the best others up to ``limit``.

    If tier 0 alone is more than the limit, only tier 0 is kept. This is a top-k report.
    """
    m = merged.withColumn("n_blocks", F.size("blocks")).withColumn("n_occurrences", F.size("occurrences"))
    # what is not among the best of its salt is not among the best of its group
    salt = F.pmod(F.xxhash64(key, "form"), F.lit(SALTS))
    near = F.row_number().over(W.partitionBy(group, salt).orderBy((F.col("tier") == 0).cast("int"), "tier", F.desc("n_blocks"), F.desc("n_occurrences"), key, "form"))
    m = m.withColumn("_near", near).where((F.col("tier") == 0) | (F.col("_near") <= limit)).drop("_near")
    protected = F.sum((F.col("tier") == 0).cast("int")).over(W.partitionBy(group))
    rank = F.row_number().over(W.partitionBy(group).orderBy("tier", F.desc("n_blocks"), F.desc("n_occurrences"), key, "form"))
    m = m.withColumn("rank", rank).withColumn("protected", protected)
    return m.where((F.col("tier") == 0) | (F.col("rank") <= F.greatest(F.lit(limit), F.col("protected"))) & (F.col("protected") <= limit)).drop("protected")


def memberships(rows: DataFrame, group: list[str], member: str) -> DataFrame:
    """(group, members): the sorted set of members of each group."""
    return rows.where(F.col(member).isNotNull()).groupBy(*group).agg(F.array_sort(F.collect_set(member)).alias("members"))


def conflicts(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """(group, n_values, first): groups with more than one value, and the value of the least ``order``, which wins."""
    return rows.where(F.col(value).isNotNull()).groupBy(*group).agg(F.countDistinct(value).alias("n_values"), F.min_by(value, order).alias("first")).where("n_values > 1")


def terms_in_texts(terms: DataFrame, texts: DataFrame, book: str, term: str, text: str, block: list[str]) -> DataFrame:
    """Rows of ``terms`` with the ``block`` keys of the texts of their book that have the term as a word, case aside.

    Only (book, word, block) is shuffled to meet the terms by their longest word, never a text for each of its words. A term of one
    word is then found; for the others the texts that may have one are fetched once and checked. Spark takes exploded words and texts for
    as small as their files, so the joins ask for shuffles: else the driver would gather them for a broadcast.
    """
    low = F.lower(F.col(term))
    longest = F.array_max(F.transform(words(low), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    t = terms.where(F.col(term).isNotNull()).withColumn("_w", longest).where("_w is not null").withColumn("_one", low == F.col("_w"))
    held = texts.where(F.col(text).isNotNull() & F.col(book).isNotNull())
    # books go by 128 bits of hash, as their ids would be most of what the words cost
    of = [F.xxhash64(book).alias("_a"), F.xxhash64(F.lit(SALTS), book).alias("_b")]
    x = held.select(*of, *block, F.array_distinct(words(F.lower(F.col(text)))).alias("_w")).withColumn("_w", F.explode("_w"))
    met = t.select("*", *of).join(x.hint("merge"), ["_a", "_b", "_w"])
    # the book is a key too, so that both sides read the same columns of the texts and share what is shuffled before
    keys = [book, *block]
    once = held.select(*[F.col(c).alias(f"_{c}") for c in keys], F.lower(F.col(text)).alias("_t"))
    same = [met[c].eqNullSafe(once[f"_{c}"]) for c in keys]
    found = met.join(once.hint("merge"), [~met["_one"], *same], "left").where(F.col("_one") | (F.size(term_positions(F.col("_t"), low)) > 0))
    return found.select(*terms.columns, *block)


def greedy_batches(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """``rows`` with a batch number from 0: in order, a new batch when the next row would pass the budget.

    A row above the budget is a batch of its own. The fold streams over sorted partitions and holds no group.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", batch int"
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, batch = object(), 0, 0
        for b in batches:
            out = []
            for g, s in zip(b[group], b[size]):
                if g != at:
                    at, used, batch = g, 0, 0
                elif used + s > budget:
                    used, batch = 0, batch + 1
                used += s
                out.append(batch)
            yield b.assign(batch=pd.Series(out, index=b.index, dtype="int32"))[[*columns, "batch"]]

    return rows.repartition(group).sortWithinPartitions(group, order).mapInPandas(run, kinds)


def frozen_hash(rows: DataFrame, group: str, entry: Column) -> DataFrame:
    """(group, entries, hash): a hash of a group's distinct entries that does not depend on their order."""
    return rows.groupBy(group).agg(F.countDistinct(entry).alias("entries"), F.sha2(F.array_join(F.array_sort(F.collect_set(entry)), "\n"), 256).alias("hash"))


def glossary_diff(old: DataFrame, new: DataFrame, concept: str, target: str) -> DataFrame:
    """(concept, old, new) of the concepts whose target differs between two glossaries."""
    j = old.select(concept, F.col(target).alias("old")).join(new.select(concept, F.col(target).alias("new")), concept)
    return j.where("old <> new")
