"""One form for terms that look the same: characters first, then script-aware repair of look-alike letters.

Characters: canonical composition; width, ligature and presentation variants to the plain letter (superscripts and the
like stay); format characters dropped; one space, one hyphen. Letters: for each word of mixed script the
scripts into which all its letters can be turned are candidates, the dominant one first; a candidate is taken if the
word exists in the corpus vocabulary (of the book before that of all books), or if several spellings
of the book lead to it. Words made of look-alikes alone are turned to their book's script if the book has that word.
The vocabulary is joined, not collected.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.session import cut
from pagelake.sources.tables import table

#: Letters that look alike, Latin first, by script.
ALIKE = {
    "Cyrillic": ("aceopxysijhdqwABCEHIJKMOPSTXY", "асеорхуѕіјһԁԛԝАВСЕНІЈКМОРЅТХУ"),
    "Greek": ("ovpukxaiABEHIKMNOPTXYZ", "ονρυκχαιΑΒΕΗΙΚΜΝΟΡΤΧΥΖ"),
    "Armenian": ("ouhnqgOS", "օսհոզցՕՏ"),
}
#: Variants of a Latin letter inside the Latin script.
LATIN_SAME = str.maketrans("ɡɑ", "ga")
#: Han and hiragana characters that look like katakana.
KATAKANA = dict(zip("夕口力二八工卜一千才三へべぺ", "タロカニハエトーチオミヘベペ"))
#: Dashes of a hyphen's look; dots at mid height; compatibility kinds that look the same as what they stand for.
HYPHENS = "-‐‑−﹣－"
DOTS = "·・‧∙⋅"
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>"}
OTHER_LOOK = "ſ"

_IGNORED = regex.compile(r"[\p{Cf}͏᠎\p{Variation_Selector}ᅟᅠㅤﾠ]+")
_SPACES = regex.compile(r"[\s\p{Zs}]+")
_HYPHEN = regex.compile("[" + regex.escape(HYPHENS) + "]")
_DOT = regex.compile("[" + DOTS + "]")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_KANA_RUN = regex.compile("[\\p{Katakana}ー・" + "".join(KATAKANA) + "]+")
_KANA = regex.compile(r"[\p{Katakana}]")
_CHARS: dict[str, str] = {}


def _plain(c: str) -> str:
    """A character without its width, ligature or presentation; characters of another look stay."""
    if c not in _CHARS:
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        same = kind in SAME_LOOK and c not in OTHER_LOOK and not unicodedata.category(c).startswith("Z")
        _CHARS[c] = unicodedata.normalize("NFKC", c) if same else c
    return _CHARS[c]


def shape(text: str) -> str:
    """Composition, widths, ligatures, format characters, spaces, hyphens and katakana of one form."""
    if text.isascii():
        return " ".join(text.split())
    t = unicodedata.normalize("NFC", "".join(map(_plain, _IGNORED.sub("", text))))
    t = _DOT.sub("・", _HYPHEN.sub("-", _SPACES.sub(" ", t).strip())).translate(LATIN_SAME)
    return _KANA_RUN.sub(lambda m: "".join(KATAKANA.get(c, c) for c in m[0]) if _KANA.search(m[0]) else m[0], t)


def _tables(second: bool) -> dict[str, dict[str, dict[str, str]]]:
    """target script: {letter of another script: letter}; second: also lower-case letters whose capitals look alike."""
    classes: list[dict[str, str]] = []
    for script, (latin, other) in ALIKE.items():
        pairs = list(zip(latin, other))
        if second:
            known = {x for p in pairs for x in p}
            pairs += [(a.lower(), b.lower()) for a, b in pairs if a.isupper() and not {a.lower(), b.lower()} & known]
        classes += [{"Latin": a, script: b} for a, b in pairs]
    by_latin: dict[str, dict[str, str]] = {}
    for c in classes:
        by_latin.setdefault(c["Latin"], {}).update(c)
    out: dict[str, dict[str, str]] = {}
    for c in by_latin.values():
        for target, letter in c.items():
            out.setdefault(target, {}).update({x: letter for s, x in c.items() if s != target})
    return out


DIRECT, SECOND = _tables(False), _tables(True)
_SCRIPTS = {s: regex.compile(rf"\p{{{s}}}") for s in ("Latin", "Cyrillic", "Greek", "Armenian")}
_OF: dict[str, str] = {}


def script(c: str) -> str:
    """The script of a base letter, or '' for marks and all scripts without look-alikes."""
    if c not in _OF:
        _OF[c] = next((s for s, p in _SCRIPTS.items() if p.match(c)), "")
    return _OF[c]


def candidates(word: str) -> list[str]:
    """``word`` in each script that all its letters can have, dominant script first; [] if nothing is to be done."""
    if word.isascii() and not all(c.lower() in "aceopxysijhdqwvuknmtbrz" for c in word):
        return []
    letters = unicodedata.normalize("NFD", word)
    have = Counter(filter(None, map(script, letters)))
    if not have:
        return []
    out: list[str] = []
    for maps in (DIRECT, SECOND) if len(have) > 1 else (DIRECT,):
        for s in sorted(set(have) if len(have) > 1 else maps, key=lambda s: (-have[s], s)):
            turned = [c if not (k := script(c)) or k == s else maps.get(s, {}).get(c) for c in letters]
            if None not in turned:
                w = unicodedata.normalize("NFC", "".join(turned))
                if w not in out and (len(have) == 1 or w != word):
                    out.append(w)
    return out if len(have) > 1 or len(out) > 1 else []


def main_script(word: str) -> str:
    have = {script(c) for c in unicodedata.normalize("NFD", word)} - {""}
    return have.pop() if len(have) == 1 else ""


def _shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        shapes = [shape(t) for t in b["term"]]
        words = [list(dict.fromkeys(_WORD.findall(t))) for t in shapes]
        doubt = [[w for w in ws if candidates(w)] for ws in words]
        mixed = [[w for w in ws if candidates(w) and not main_script(w)] for ws in words]
        clean = [[w for w in ws if w not in set(m)] for ws, m in zip(words, mixed)]
        yield pd.DataFrame({"book": b["book"], "term": b["term"], "shape": shapes, "clean": clean, "doubt": doubt})


def _options(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, w, c, n, main_script(c), not main_script(w)) for k, w in zip(b["book"], b["word"]) for n, c in enumerate(candidates(w))]
        yield pd.DataFrame(rows, columns=["book", "word", "option", "nth", "script", "mixed"])


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        done = []
        for s, m in zip(b["shape"], b["repairs"]):
            m = dict(m) if m is not None else {}
            done.append(_WORD.sub(lambda x, m=m: m.get(x[0], x[0]), s) if m else s)
        yield pd.DataFrame({"book": b["book"], "term": b["term"], "canonical": done})


def canonical_terms(terms: DataFrame) -> DataFrame:
    """(book, term, canonical) for each distinct (book, term) of ``terms``: the one form of a term within its book.

    A null term is dropped; an empty or blank one has the canonical form ''. A null book is a book of its own. Repeated
    rows count once, other columns are ignored. Case is kept: compare lower-cased forms to set case aside.
    """
    t = terms.where("term is not null").select(F.coalesce("book", F.lit("")).alias("book"), "term").distinct()
    t = cut(t.mapInPandas(_shapes, "book string, term string, shape string, clean array<string>, doubt array<string>"))
    clean = t.select("book", F.explode("clean").alias("w")).groupBy("book", F.lower("w").alias("option_l")).agg(F.count("*").alias("in_book"), F.first("w").alias("w"))
    everywhere = clean.groupBy("option_l").agg(F.sum("in_book").alias("in_all"))
    letters = F.pandas_udf(lambda s: s.map(main_script), "string")
    of_book = clean.select("book", letters("w").alias("book_script"), "in_book").where("book_script <> ''").groupBy("book", "book_script").agg(F.sum("in_book").alias("n"))
    of_book = of_book.groupBy("book").agg(F.max(F.struct("n", "book_script")).alias("m")).select("book", "m.book_script")
    doubt = t.select("book", F.explode("doubt").alias("word")).distinct()
    options = doubt.mapInPandas(_options, "book string, word string, option string, nth int, script string, mixed boolean").withColumn("option_l", F.lower("option"))
    spellings = F.size(F.collect_set("word").over(W.partitionBy("book", "option_l")))
    options = (
        options.withColumn("spellings", spellings)
        .join(clean.select("book", "option_l", "in_book"), ["book", "option_l"], "left")
        .join(everywhere, "option_l", "left")
        .join(of_book, "book", "left")
    )
    level = (
        F.when(F.col("mixed"), F.when(F.col("in_book").isNotNull(), 3).when(F.col("in_all").isNotNull(), 2).when(F.col("spellings") > 1, 1).otherwise(0))
        .when((F.col("script") == F.col("book_script")) & F.col("in_book").isNotNull(), 1)
        .otherwise(0)
    )
    chosen = options.withColumn("level", level).where("level > 0").groupBy("book", "word").agg(F.max(F.struct("level", -F.col("nth"), "option")).alias("m"))
    chosen = chosen.select("book", "word", F.col("m.option").alias("option")).where("option <> word")
    repairs = t.select("book", "term", F.explode("doubt").alias("word")).join(chosen, ["book", "word"]).groupBy("book", "term").agg(F.map_from_entries(F.collect_list(F.struct("word", "option"))).alias("repairs"))
    return t.select("book", "term", "shape").join(repairs, ["book", "term"], "left").mapInPandas(_apply, "book string, term string, canonical string")


def corpus_terms(spark: SparkSession, root: str) -> DataFrame:
    """(book, term) of the mentions, the groups' forms and their normalized terms."""
    m = table(spark, root, "term_mentions", "book_id", "term").select(F.col("book_id").alias("book"), "term")
    g = table(spark, root, "term_groups", "book_id", "normalized_term", "forms")
    return m.union(g.select("book_id", F.explode("forms"))).union(g.select("book_id", "normalized_term"))


def same_look_pairs(groups: DataFrame, canonical: DataFrame) -> DataFrame:
    """(group_id_a, group_id_b) of one book with forms of one canonical form, case aside, that are spelled differently.

    groups: (group_id, book, form), canonical: as from :func:`canonical_terms`. Blank canonical forms pair nothing.
    """
    g = groups.where("form is not null").select("group_id", F.coalesce("book", F.lit("")).alias("book"), F.col("form").alias("term"))
    g = g.join(canonical, ["book", "term"]).where("canonical <> ''").groupBy("book", F.lower("canonical").alias("key"), "group_id").agg(F.min(F.lower("term")).alias("lo"), F.max(F.lower("term")).alias("hi"))
    g = cut(g)
    a, b = (g.select("book", "key", *(F.col(c).alias(f"{c}_{x}") for c in ("group_id", "lo", "hi"))) for x in "ab")
    differs = (F.col("lo_a") != F.col("lo_b")) | (F.col("hi_a") != F.col("hi_b")) | (F.col("lo_a") != F.col("hi_a"))
    return a.join(b, ["book", "key"]).where(F.col("group_id_a") < F.col("group_id_b")).where(differs).select("group_id_a", "group_id_b").distinct()


def p1_canonical(spark: SparkSession, root: str) -> DataFrame:
    return canonical_terms(corpus_terms(spark, root)).withColumnRenamed("book", "book_id")


def p1_groups(spark: SparkSession, root: str) -> DataFrame:
    """The terms regrouped: one row per book and look, with all spellings."""
    c = canonical_terms(corpus_terms(spark, root)).where("canonical <> ''")
    return c.groupBy(F.col("book").alias("book_id"), F.lower("canonical").alias("normalized_term")).agg(F.array_sort(F.collect_set("term")).alias("forms"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    forms = table(spark, root, "term_groups", "group_id", "book_id", "forms").select("group_id", F.col("book_id").alias("book"), F.explode("forms").alias("form"))
    return same_look_pairs(forms, canonical_terms(corpus_terms(spark, root)))


QUERIES = {"p1_found": p1_found, "p1_canonical": p1_canonical, "p1_groups": p1_groups}
SQL: dict[str, str] = {}
