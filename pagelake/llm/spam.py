"""Keyword-stuffed and link-list pages: suffix-automaton coverage with missing clause structure.

Each page's words go into a suffix automaton. For every position it gives the longest substring that
ends there and occurs elsewhere in the page; the letters under such repeats of two words or more are the
repeat coverage. A segment (sentence or line) has clause structure if it is long enough, is closed as a
sentence and does not repeat a word pair within itself (four characters where words are single characters). A page is spam if most of it lacks clause
structure and most of that part is repeats, links or tags, unless it is an ordered list that serves a
reader (numbered or alphabetical entries). One narrow pass over the texts, no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.fmindex import suffix_array
from pagelake.sources.tables import spread, table

#: Parameters: words in repeated pairs up to which a page takes an automaton (longer ones a suffix array, with the same result), least and most words of a clause (twice as many where
#: words are single characters), the share of a clause under a word pair that it repeats, and the two shares of a page.
WINDOW, CLAUSE_WORDS, LONGEST_CLAUSE, STUFFED, BARE_SHARE, SPAM_SHARE = 50_000, 5, 60, 0.6, 0.6, 0.5
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}ー"
_WORD = regex.compile(rf"[{_CJK}]|[^\W_{_CJK}]+(?:['’][^\W_{_CJK}]+)*")
_LINK = regex.compile(r"<a\b[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\n]*\)|(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.\p{L}{2,}/\S*")
_MARKED = regex.compile(r"[#@/<\[]|www\.")
_TAG = regex.compile(r"(?<!\S)[#@]\w+")
_END = regex.compile(r"[.!?؟]+[\"'”’)\]]*(?=\s|$)|[。！？।॥]+[」』）]*|\n[^\S\n]*\n|$")
_ENTRY = regex.compile(r"^\W*(?:\p{L}+\s+)?(\d+)[.):]\s|^\W*(\p{L}[^,:;.\d]*)[,:;.]?\s*.*$")


def repeats(words: list[str]) -> list[int]:
    """For each position the length of the longest substring that ends there and occurs twice or more."""
    nexts, link, length, inner = [{}], [-1], [0], [False]
    at, ends = 0, []
    for w in words:
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[at] + 1)
        inner.append(False)
        p, at = at, new
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][w]
            if length[q] != length[p] + 1:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                inner.append(True)
                while p >= 0 and nexts[p].get(w) == q:
                    nexts[p][w] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        ends.append(new)
    for v in link[1:]:
        inner[v] = True
    return [length[v] if inner[v] else length[link[v]] for v in ends]


def repeats_of_long(words: list[str]) -> list[int]:
    """The same as :func:`repeats` from the suffix array of the reversed words, in flat arrays."""
    known: dict[str, int] = {}
    text = np.array([known.setdefault(w, len(known) + 1) for w in reversed(words)], np.int64)
    order = suffix_array(text)
    n = len(text)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    t, before, ranks = text.tolist(), order.tolist(), rank.tolist()
    common, h = [0] * (n + 1), 0
    for i, r in enumerate(ranks):
        if not r:
            h = 0
            continue
        j = before[r - 1]
        while i + h < n and j + h < n and t[i + h] == t[j + h]:
            h += 1
        common[r] = h
        h = max(h - 1, 0)
    return [max(common[r], common[r + 1]) for r in reversed(ranks)]


def repeated_ends(words: list[str]) -> list[int]:
    """:func:`repeats` where it is two or more, else 0.

    A repeat of two words or more consists of word pairs that occur twice, so the automaton is fed the runs of such pairs only, each
    run closed by a symbol of its own; no repeat crosses the gap between two runs.
    """
    n = len(words)
    pairs = list(zip(words, words[1:]))
    times = Counter(pairs)
    if len(times) == len(pairs):
        return [0] * n
    fed: list = []
    at: list[int] = []
    until = -1
    for i, q in enumerate(pairs):
        if times[q] > 1:
            if until != i:
                if fed:
                    fed.append(-i - 1)
                    at.append(-1)
                fed.append(words[i])
                at.append(i)
            fed.append(words[i + 1])
            at.append(i + 1)
            until = i + 1
    out = [0] * n
    for i, k in zip(at, repeats(fed) if len(fed) <= WINDOW else repeats_of_long(fed)):
        if i >= 0 and k > 1:
            out[i] = k
    return out


def _ordered(lines: list[str]) -> bool:
    """Whether the lines are a list in order: entry numbers that rise, or entry words in alphabetical order without repeats."""
    numbers, heads = [], []
    for x in lines:
        m = _ENTRY.match(x)
        if m and m[1]:
            numbers.append(int(m[1]))
        elif m:
            heads.append(m[2].strip().casefold())
    rising = lambda xs: len(xs) >= 4 and sum(a < b for a, b in zip(xs, xs[1:])) >= 0.9 * (len(xs) - 1)
    return len(numbers) >= 0.7 * len(lines) and rising(numbers) or len(heads) >= 0.7 * len(lines) and rising(heads)


def measure(text: str | None) -> tuple[int, int, int, int, bool]:
    """(letters, letters outside clauses, of these under repeats or in links and tags, letters under repeats, whether it is an ordered list)."""
    if not text or not text.strip():
        return 0, 0, 0, 0, False
    marks = [m.span() for pattern in (_LINK, _TAG) for m in pattern.finditer(text)] if _MARKED.search(text) else []
    marked = bytearray(len(text) if marks else 0)
    for a, b in marks:
        marked[a:b] = b"\1" * (b - a)
    spans = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b].casefold() for a, b in spans]
    size = [b - a for a, b in spans]
    total, latin = sum(size), text.isascii()
    loose: list[tuple[int, int]] = []
    i, n = 0, len(spans)
    for m in _END.finditer(text):
        j, end = i, m.end()
        while j < n and spans[j][0] < end:
            j += 1
        if j == i:
            continue
        plain = [k for k in range(i, j) if not marked[spans[k][0]]] if marks else range(i, j)
        wide = 1 if latin else 1 + (sum(size[k] == 1 and words[k] > "\x7f" for k in plain) > len(plain) // 2)
        clause = bool(m.group().strip()) and CLAUSE_WORDS * wide <= len(plain) <= LONGEST_CLAUSE * wide and 2 * len(plain) > j - i
        if clause:
            run = 2 * wide
            runs = list(zip(*(words[k : j - run + 1 + k - i] for k in range(i, i + run))))
            if len(set(runs)) < len(runs):
                times = Counter(runs)
                twice = {x for k, q in enumerate(runs) if times[q] > 1 for x in range(i + k, i + k + run)}
                clause = sum(size[k] for k in twice) < STUFFED * sum(size[i:j])
        if not clause:
            loose.append((i, j))
        i = j
    bare = sum(sum(size[i:j]) for i, j in loose)
    long = repeated_ends(words)
    covered, until = [False] * n, n
    for i in range(n - 1, -1, -1):
        if long[i] >= 2:
            until = min(until, i - long[i] + 1)
        covered[i] = i >= until and until < n
        if i == until:
            until = n
    spam = sum(size[k] for i, j in loose for k in range(i, j) if covered[k] or marks and marked[spans[k][0]])
    lines = [x for x in text.split("\n") if x.strip()]
    return total, bare, spam, sum(s for s, c in zip(size, covered) if c), _ordered(lines[1:] if len(lines) > 6 else lines)


def spam_pages(df: DataFrame, key: str, text: str, bare_share: float = BARE_SHARE, spam_share: float = SPAM_SHARE) -> DataFrame:
    """(key, coverage, bare, spam_share, is_spam) for each distinct row of (key, text).

    A null, empty or wordless text has zero shares and is no spam; repeated rows count once; other columns are
    ignored. Whole texts are read; of pages with more than WINDOW words in repeated pairs a suffix array takes the automaton's place.
    """
    out = f"`{key}` {df.schema[key].dataType.simpleString()}, coverage double, bare double, spam_share double, is_spam boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b["_text"]):
                n, bare, spam, cov, ordered = measure(t)
                n, part = max(n, 1), spam / max(bare, 1)
                rows.append((k, cov / n, bare / n, part, not ordered and bare > bare_share * n and part > spam_share))
            yield pd.DataFrame(rows, columns=[key, "coverage", "bare", "spam_share", "is_spam"])

    return df.select(df[key], df[text].alias("_text")).mapInPandas(run, out).distinct()


def p10_pages(spark: SparkSession, root: str) -> DataFrame:
    pages = spam_pages(spread(table(spark, root, "documents", "doc_id", "text")), "doc_id", "text")
    return pages.select("doc_id", *(F.round(c, 6).alias(c) for c in ("coverage", "bare", "spam_share")), "is_spam")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return spam_pages(spread(table(spark, root, "documents", "doc_id", "text")), "doc_id", "text").where("is_spam").select("doc_id").distinct()


QUERIES = {"p10_found": p10_found, "p10_pages": p10_pages}
SQL: dict[str, str] = {}
