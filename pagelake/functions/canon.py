"""Canonical text, JSON, hashes and small text functions as columns."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Stop words of the language heuristic, in the order in which ties are broken.
STOP_WORDS = {
    "en": ["the", "and", "is", "are", "this", "that", "with", "for", "of", "to"],
    "fr": ["le", "la", "les", "de", "des", "et", "bonjour", "merci", "avec", "pour"],
    "es": ["el", "la", "los", "las", "de", "y", "hola", "gracias", "con", "para"],
    "de": ["der", "die", "das", "und", "ist", "mit", "für", "ein", "eine", "hallo"],
}
#: Block types that a page may have.
BLOCK_TYPES = ["heading", "paragraph", "caption", "footnote", "table", "list_item", "pull_quote", "illustration", "quote", "page_number"]


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """NFC with line ends as one newline; null stays null."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.replace("\r\n", "\n").replace("\r", "\n")))


@F.pandas_udf(StringType())
def term_key(s: pd.Series) -> pd.Series:
    """NFC of the case-folded NFKC form with white space collapsed; null stays null."""
    key = lambda t: unicodedata.normalize("NFC", " ".join(unicodedata.normalize("NFKC", t).split()).casefold())
    return s.map(lambda t: None if t is None else key(t))


def _plain(v):
    if isinstance(v, str):
        return unicodedata.normalize("NFC", v)
    if isinstance(v, dict):
        return {unicodedata.normalize("NFC", k): _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def canonical_text(text: str) -> str | None:
    """A JSON text with sorted keys, compact, in NFC; None if it is no JSON or holds a number that is not finite."""
    try:
        return json.dumps(_plain(json.loads(text)), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """Column form of :func:`canonical_text`."""
    return s.map(lambda t: None if t is None else canonical_text(t))


def tagged_hash(tag: str, *parts: Column) -> Column:
    """Lower hex SHA-256 of the tag and the parts (strings or binaries), parted by a zero byte; null if a part is."""
    zero = F.unhex(F.lit("00"))
    out = F.lit(tag).cast("binary")
    for p in parts:
        out = F.concat(out, zero, p.cast("binary"))
    return F.sha2(out, 256)


def detect_language(text: Column) -> Column:
    """ja, ko or zh by script, else the language with most stop words, of a tie the first; null if none occurs."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-zA-ZÀ-ÿ]+)"), F.lit(1))

    def count(of: Column, stop: list[str]) -> Column:
        return F.size(F.filter(of, lambda w: w.isin(*stop)))

    def most(n: Column) -> Column:
        return F.when(F.array_max(n) > 0, F.element_at(F.array(*[F.lit(c) for c in STOP_WORDS]), F.array_position(n, F.array_max(n)).cast("int")))

    # arrays of one element bind a value, so that words and counts are made once a row
    counts = F.get(F.transform(F.array(words), lambda of: F.array(*[count(of, stop) for stop in STOP_WORDS.values()])), F.lit(0))
    by_words = F.get(F.transform(F.array(counts), most), F.lit(0))
    return (
        F.when(text.rlike("[\\u3040-\\u30ff]"), "ja").when(text.rlike("[\\uac00-\\ud7af]"), "ko").when(text.rlike("[\\u4e00-\\u9fff]"), "zh").when(F.trim(text) == "", None).otherwise(by_words)
    )


WORD_CHAR = "[\\p{L}\\p{N}_]"


def contains_term(text: Column, term: Column) -> Column:
    """Whether ``text`` has ``term`` (a literal) with no word character on either side, case aside."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.size(term_positions(padded, F.lower(term))) > 0


def term_positions(text: Column, term: Column) -> Column:
    """0-based code-point positions at which ``term`` stands in ``text`` as a word."""
    # a hit is the end of a piece of the text split at the term, so that long texts are read once
    n = F.length(term)
    pieces = F.split(text, F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    ends = F.aggregate(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.array().cast("array<int>"),
        lambda a, p: F.array_append(a, F.when(F.size(a) > 0, F.element_at(a, -1) + n).otherwise(F.lit(0)) + F.length(p)),
    )
    free = lambda c: (c == "") | ~c.rlike(WORD_CHAR)
    ok = lambda i: free(F.when(i > 0, F.substring(text, i, F.lit(1))).otherwise(F.lit(""))) & free(F.substring(text, i + n + 1, F.lit(1)))
    return F.when(n > 0, F.filter(ends, ok)).otherwise(F.array().cast("array<int>"))


def escape_xml(text: Column) -> Column:
    """Text with markup characters and both quotes escaped; characters that XML forbids become U+FFFD."""
    out = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{fffe}\\x{ffff}]", "\ufffd")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def blank(text: Column) -> Column:
    """Whether a text is null or has nothing but white space of any kind."""
    return F.coalesce(~text.rlike("[^\\s\\p{Z}\\x1c-\\x1f\\x85]"), F.lit(True))


def tail(text: Column, limit: int = 8192) -> Column:
    """The last ``limit`` characters."""
    return F.right(text, F.lit(limit))


def token_estimate(text: Column) -> Column:
    """Size of a text for budgets: its UTF-8 bytes."""
    return F.octet_length(text)


def regular_variants(term: Column) -> Column:
    """A plain ASCII term with its regular English variants, any other term alone, as an array in lower case."""
    t = F.lower(term)
    ends = F.array(t, *[F.concat(t, F.lit(x)) for x in ("s", "es", "'s", "’s")])
    ies = F.when(t.rlike("[^aeiou]y$"), F.array(F.concat(F.left(t, F.length(t) - 1), F.lit("ies")))).otherwise(F.array().cast("array<string>"))
    return F.when(t.rlike("^[a-z0-9 ]+$"), F.concat(ends, ies)).otherwise(F.array(t))


def contains_variant(text: Column, term: Column) -> Column:
    """Whether ``text`` has ``term`` or a regular variant of it: a plain ASCII term as a word, any other one anywhere; case and spacing aside."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), "\\s+", " "))
    t, x = flat(term), F.concat(F.lit(" "), flat(text), F.lit(" "))
    as_word = F.exists(regular_variants(t), lambda v: F.size(term_positions(x, v)) > 0)
    return F.coalesce((t != "") & F.when(t.rlike("^[a-z0-9 ]+$"), as_word).otherwise(F.contains(x, t)), F.lit(False))
