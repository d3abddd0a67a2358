"""Noise of the printed page and its scan: divided words, misread characters, running headers, page numbers.

One pass over the texts gathers word counts, divided words and lines that may be furniture; texts themselves are never
shuffled. The character editor, an averaged perceptron, decides: for each word of which the corpus has a reading, whether to keep
it or to replace, delete and insert characters; for each word at a line end, whether to join it; for each line, by its form and its
place on the page and in the block, whether it is furniture. What it decides is then checked against the corpus: a reading must be
far more frequent, a join must not be a word that the corpus has with its hyphen.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.editor import WORDS, Editor, evidence, readings, restoring, step
from pagelake.session import cut
from pagelake.sources.tables import spread, table

#: Parameters: how much more frequent a reading must be (by edits), least occurrences and books of a reading, of any reading at all, pages of a sure header, the
#: ratio up to which a pair is two words, examples of each kind that the editor is fitted on, and readings that may be sent along.
RATIO, OFTEN, BOOKS, LEAST, PAGES, APART, CASES, DOUBT = {1: 12, 2: 40}, 12, 3, 3, 3, 4, 4_000, 200_000
HYPHEN = "-\xad¬‐‑"
_DIVIDED = re.compile(rf"([^\W\d_]+(?:['’][^\W\d_]+)?)([{HYPHEN}])[ \t\xa0]*\r?\n[ \t\xa0]*([^\W_]+)")
_TOKEN = re.compile(rf"[^\W_]+(?:[!|][^\W_]+)*(?:[{HYPHEN}][^\W\d_]+)*")
_PART = re.compile(rf"[{HYPHEN}]")
_MARK = re.compile(rf"[{HYPHEN}][ \t\xa0]*\r?\n")
_NUMBER = re.compile(
    r"^\s*(?:(?:[-–—·*~]\s*(?P<a>\d{1,4}|[ivxlc]{1,8})\s*[-–—·*~])|\[\s*(?P<b>\d{1,4}|[ivxlc]{1,8})\s*\]|(?P<c>\d{1,4}|[ivxlc]{1,8})\.?|(?:p|pp|pg|page|seite|s|с|стр|página|pág|pagina|pag)\.?\s*(?P<d>\d{1,4})(?:\s*(?:of|/|von|de|di|из)\s*\d{1,5})?)\s*$",
    re.IGNORECASE,
)
_NUMBERED = re.compile(r"^\s*(?:(?P<n1>\d{1,4}|[ivxlc]{1,8})(?:\s{2,}|\s*[|·]\s*)(?P<t1>\S.*?\S)|(?P<t2>\S.*?\S)(?:\s{2,}|\s*[|·]\s*)(?P<n2>\d{1,4}|[ivxlc]{1,8}))\s*$")
_SPACED = re.compile(r"^(?:\S )+\S(?:\s{2,}(?:\S )*\S)*$")
_CLOSED = re.compile(r"[.!?。！？؟।॥…][\"'”’»)\]]*$|\(\d{4}\)$")
#: Stands for a line end inside a joined word, so that line numbers stay those of the whole text.
LINE_MARK = "\ue000"
_LETTER = re.compile(r"[^\W\d_]")


def title_key(line: str) -> str:
    """A header's text in one form: no page number, spacing or capitals."""
    m = _NUMBERED.match(line)
    t = (m["t1"] or m["t2"]) if m else line.strip()
    if _SPACED.match(t) and len(t) > 6:
        t = " ".join(p.replace(" ", "") for p in re.split(r"\s{2,}", t))
    return " ".join(t.lower().split())


def _stands_alone(line: str, lines: list[str], i: int, full: list[int]) -> bool:
    """Whether the first of several lines ends by itself: a wrapped line ends where the next word would not have fitted."""
    after = lines[full[1]].strip()
    if not (after[0].isupper() or after[0].lower() == after[0].upper()):
        return False
    others = max((len(x.rstrip()) for j, x in enumerate(lines) if j != i), default=0)
    return len(line) + len(after.split()[0]) + 3 <= others


def line_kinds(text: str, page: int | None, kind: str | None, first: bool, place: str = "") -> Iterator[tuple[int, str, str, str]]:
    """(line, what, key, features) of the lines that may be furniture.

    what: 'number' (a number alone), 'both' (text with a number set apart), 'marked' (in capitals or spaced out), 'alone' (a
    line of its own block), 'opening' (opens a block and is not broken by the measure), 'within' (any other line not closed
    as a sentence), 'title' (a line alone that opens the first page of its book, where a title is no header). The features are those of
    the page and its position: what, place of the block on the page, place in the block, kind of block, and how a number fits the page.
    """
    lines = re.split(r"\r?\n", text)
    full = [i for i, x in enumerate(lines) if x.strip()]

    def fits(n: str) -> str:
        return "?" if page is None or not n.isdigit() else str(min(abs(int(n) - page), 2))

    for at, i in enumerate(full):
        line = lines[i].strip()
        where = "o" if len(full) == 1 else "f" if at == 0 else "l" if at == len(full) - 1 else "m"

        def told(what: str, more: str = "-", where: str = where) -> str:
            return f"{what},{where},{place},{kind or '-'},{more}"

        m = _NUMBER.match(line)
        if m:
            n = next(x for x in m.groupdict().values() if x)
            yield i, "number", "", told("number", fits(n) + ("d" if n.isdigit() else "r") + ("p" if m["c"] else "s"))
            continue
        if not _LETTER.search(line) or kind in ("table", "illustration"):
            continue
        m = _NUMBERED.match(line)
        if m and _LETTER.search(m["t1"] or m["t2"]) and not _CLOSED.search(m["t1"] or m["t2"]):
            yield i, "both", title_key(line), told("both", fits(m["n1"] or m["n2"]))
            continue
        if _CLOSED.search(line) or line[-1] in ",;:-" + HYPHEN:
            continue
        spaced = _SPACED.match(line) and len(line) > 8 and len(line.split()) > 5
        if spaced or line.isupper() and " " in line and sum(map(str.isupper, line)) > 7:
            yield i, "marked", title_key(line), told("marked", ("s" if spaced else "c") + ("t" if first else "") + ("l" if len(line) > 15 else ""))
            continue
        if not (line[0].isupper() or line[0].lower() == line[0].upper()) or not _LETTER.match(line):
            continue
        if len(full) == 1:
            what = "title" if first else "alone"
            yield i, what, title_key(line), told(what)
            continue
        if at == 0 and _stands_alone(line, lines, i, full):
            yield i, "opening", title_key(line), told("opening")
        elif len(line) > 5:
            yield i, "within", title_key(line), told("within")


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text: ('line', what, key, line, features), ('divided', left, right, mark); of each batch: ('word', word, '', n, lower)."""
    for b in batches:
        rows, seen = [], {}
        for name, key, item, book, page, kind, first, last, text in zip(*(b[c] for c in ("record_table", "record_id", "item", "book", "page", "kind", "first", "last", "text"))):
            if not text:
                continue
            page = None if pd.isna(page) else int(page)
            place = ("o" if last else "f") if item == 0 else "l" if last else "m"
            for i, what, k, told in line_kinds(text, page, kind, bool(first), place):
                rows.append(("line", name, key, item, book, what, k, i, 0, told))
            plain = text
            if _MARK.search(text):
                for n, m in enumerate(_DIVIDED.finditer(text)):
                    rows.append(("divided", name, key, item, book, m[1].lower(), m[3].lower(), n, int(m[2] in "\xad¬") + 2 * (m[3][0].isupper() and not m[1].isupper()), None))
                plain = _DIVIDED.sub(" ", text)
            if book not in seen:
                seen[book] = Counter()
            seen[book].update(_TOKEN.findall(plain))
        # forms are told apart once for each distinct spelling of a batch
        for book, spellings in seen.items():
            counts, lower = Counter(), Counter()
            for w, n in spellings.items():
                parts = _PART.split(w) if not w.isalnum() else [w]
                for x in parts + (["-".join(parts)] if len(parts) > 1 else []):
                    k = x.lower()
                    counts[k] += n
                    lower[k] += n * (x[:1].islower() or not x[:1].isalpha())
            rows += [("word", None, None, None, book, w, None, n, lower[w], None) for w, n in counts.items()]
        yield pd.DataFrame(rows, columns=["fact", "record_table", "record_id", "item", "book", "a", "b", "n", "m", "told"])


FACTS = "fact string, record_table string, record_id long, item int, book string, a string, b string, n long, m long, told string"


def scanned_texts(spark: SparkSession, root: str, wide: bool = False) -> DataFrame:
    """(record_table, record_id, item, book, page, kind, first, last, text) of both tables; first: opens the first page that its book has; last: ends its page; wide: for a pass in Python, on all cores."""
    wider = spread if wide else lambda df: df
    p = wider(table(spark, root, "page_extractions", "extraction_id", "book_id", "page_number", "blocks"))
    opening = table(spark, root, "page_extractions", "book_id", "page_number").groupBy("book_id").agg(F.min("page_number").alias("opens"))
    c = wider(table(spark, root, "corpus_pages", "page_key", "source"))
    a = p.join(opening, "book_id", "left").select(F.lit("page_extractions").alias("record_table"), F.col("extraction_id").alias("record_id"), "book_id", "page_number", (F.col("page_number") == F.col("opens")).alias("opens"), F.size("blocks").alias("of"), F.posexplode("blocks").alias("item", "b"))
    a = a.select("record_table", "record_id", "item", F.coalesce("book_id", F.lit("")).alias("book"), F.col("page_number").alias("page"), F.col("b.type").alias("kind"), (F.coalesce("opens", F.lit(False)) & (F.col("item") == 0)).alias("first"), (F.col("item") + 1 == F.col("of")).alias("last"), F.col("b.text").alias("text"))
    b = c.select(F.lit("corpus_pages").alias("record_table"), F.col("page_key").alias("record_id"), F.size("source").alias("of"), F.posexplode("source").alias("item", "text"))
    b = b.select("record_table", "record_id", "item", F.lit("").alias("book"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("kind"), (F.col("item") == 0).alias("first"), (F.col("item") + 1 == F.col("of")).alias("last"), "text")
    return a.union(b)


def vocabulary(facts: DataFrame) -> DataFrame:
    """(word, n, lower, books, home, most): occurrences, those not capitalised, books, and the book that has it most often with its occurrences there."""
    w = facts.where("fact = 'word'").groupBy("a", "book").agg(F.sum("n").alias("n"), F.sum("m").alias("lower"))
    return w.groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n"), F.sum("lower").alias("lower"), F.count("*").alias("books"), F.max(F.struct("n", "book")).alias("h")).select("word", "n", "lower", "books", F.col("h.book").alias("home"), F.col("h.n").alias("most"))


def _sample(df: DataFrame, *key: str, n: int = CASES) -> list:
    """At most ``n`` rows by seeded hash of ``key``; about twice as many are looked at."""
    h = F.pmod(F.xxhash64(*key, F.lit(23)), F.lit(1_000_003))
    below = min(1_000_003, 2 * n * 1_000_003 // max(df.count(), 1) + 1)
    return sorted(df.where(h < below).collect(), key=lambda r: tuple(str(r[k]) for k in key))[:n]


def _swapped(a: str, b: str) -> bool:
    """Whether b is a with two neighbours in each other's place: a slip of the pen or the keys, no confusion of shapes."""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(a) == len(b) and a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


def word_readings(words: DataFrame, facts: DataFrame) -> DataFrame:
    """(word, reading, edits, n, lower, odd, known, known_lower, known_books, there, most): each word with each reading that the corpus has LEAST times.

    No word is left out by its frequency, by its length or by the book that has it. there: how often the book with most of the word's
    occurrences has the reading, asked for words that are always capitalised.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for w, n, small, home, most in zip(b["word"], b["n"], b["lower"], b["home"], b["most"]):
                odd = not w.isalpha()
                if len(w) < (3 if odd else 4):
                    continue
                best: dict[str, int] = {}
                for v, edits, _ in readings(w, 2 if len(w) >= 6 else 1):
                    if edits < best.get(v, 9):
                        best[v] = edits
                rows += [(w, v, n, small, home, most, odd, e) for v, e in best.items() if v != w and (v.isalpha() or v.isdigit()) and not (e == 2 and _swapped(w, v))]
            yield pd.DataFrame(rows, columns=["word", "reading", "n", "lower", "home", "most", "odd", "edits"])

    doubt = words.mapInPandas(run, "word string, reading string, n long, lower long, home string, most long, odd boolean, edits int")
    known = words.where(F.col("n") >= LEAST).select(F.col("word").alias("reading"), F.col("n").alias("known"), F.col("lower").alias("known_lower"), F.col("books").alias("known_books"))
    j = cut(doubt.join(known, "reading"))
    asked = j.where("lower = 0 and not odd and known > n").select(F.col("reading").alias("a"), F.col("home").alias("book")).distinct()
    there = facts.where("fact = 'word'").join(asked, ["a", "book"]).groupBy(F.col("a").alias("reading"), F.col("book").alias("home")).agg(F.sum("n").alias("there"))
    return cut(j.join(there, ["reading", "home"], "left").withColumn("there", F.coalesce("there", F.lit(0))).drop("home"))


def _evidence(r) -> list[str]:
    return evidence(r.n, r.lower, r.odd, r.edits, r.known, r.known_lower, r.known_books, r.there, r.most)


def train_words(editor: Editor, words: DataFrame, pairs: DataFrame, sample: int = WORDS) -> None:
    """Fits the editor's readings: frequent words under noise, and pairs of the corpus that are two words, at most ``sample`` and CASES.

    Two words: neither is APART times as frequent as the other; or one is always capitalised and its book has the other nowhere.
    """
    often = words.where((F.col("n") >= OFTEN) & (F.col("books") >= BOOKS) & F.length("word").between(3, 24) & ~F.col("word").contains("-"))
    known = [(r.word, r.n, r.lower, r.books) for r in _sample(often.select("word", "n", "lower", "books"), "word", n=sample) if r.word.isalpha() or r.word.isdigit()]
    two = pairs.where((F.col("known") < APART * F.col("n")) & ~F.col("odd") | (F.col("lower") == 0) & ~F.col("odd") & (F.col("there") == 0))
    editor.fit_words(known, [(r.word, restoring(r.word, r.reading, r.edits), _evidence(r)) for r in _sample(two, "word", "reading")])


def misread_words(pairs: DataFrame, editor: Editor) -> DataFrame:
    """(word, reading, capitals): words that the editor reads otherwise, checked by the corpus; without capitals only where written small.

    The check: a reading by letters alone must be RATIO times as frequent, in several books, and no name where the word is none; a
    word with digits or marks between letters, or letters between digits, needs a known reading only. A word capitalised far
    more than its reading is a name where it is capitalised. Of several readings the one of fewest edits and highest margin is taken.
    """
    said = pairs.sparkSession.sparkContext.broadcast(editor)
    ratio = F.when(F.col("edits") == 1, RATIO[1]).otherwise(RATIO[2])
    name = F.col("known_lower") < 0.5 * F.col("known")
    plain = (F.col("known") >= ratio * F.col("n")) & (F.col("known") >= OFTEN) & (F.col("known_books") >= BOOKS) & ((F.col("lower") > 0) | name)
    odd = (F.col("known") >= 2 * F.col("n")) & (F.col("known") >= F.when(F.col("edits") == 1, LEAST).otherwise(OFTEN))
    capitals = F.col("odd") | name | (F.col("lower") * F.col("known") >= 0.5 * F.col("n") * F.col("known_lower"))
    j = pairs.where(F.when(F.col("odd"), odd).otherwise(plain)).withColumn("capitals", capitals)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                margin = said.value.margin(r.word, restoring(r.word, r.reading, r.edits), _evidence(r))
                if margin > 0:
                    rows.append((r.word, r.reading, r.edits, margin, r.known, r.capitals))
            yield pd.DataFrame(rows, columns=["word", "reading", "edits", "margin", "known", "capitals"])

    taken = j.mapInPandas(run, "word string, reading string, edits int, margin double, known long, capitals boolean")
    return taken.groupBy("word").agg(F.max(F.struct(-F.col("edits"), "margin", "known", "reading", "capitals")).alias("m")).select("word", "m.reading", "m.capitals")


def line_ends(facts: DataFrame, words: DataFrame) -> DataFrame:
    """(record_table, record_id, item, nth, left, right, mark, joined_n, own_n, left_n, right_n): words at a line end, with how often the corpus has the whole, joined and with its own hyphen, and the parts."""
    d = facts.where("fact = 'divided'").select("record_table", "record_id", "item", F.col("n").alias("nth"), F.col("a").alias("left"), F.col("b").alias("right"), F.col("m").alias("mark"))
    forms = d.select("left", "right").distinct()
    count = lambda name: words.select(F.col("word").alias("w"), F.col("n").alias(name))
    for name, w in (("joined_n", F.concat("left", "right")), ("own_n", F.concat_ws("-", "left", "right")), ("left_n", F.col("left")), ("right_n", F.col("right"))):
        forms = forms.withColumn("w", w).join(count(name), "w", "left").drop("w").fillna(0, [name])
    return d.join(forms, ["left", "right"])


def _end_evidence(r) -> tuple[list[str], list[str]]:
    """What the corpus says of the whole word, and of its parts with the mark."""
    whole = [f"w{'j' if r.joined_n > r.own_n else 'o' if r.own_n > r.joined_n else '0'}"]
    a, b = ("2" if n >= OFTEN and len(x) > 2 else "1" if n else "0" for n, x in ((r.left_n, r.left), (r.right_n, r.right)))
    return whole, [f"p{a}{b}", f"m{r.mark}", f"m{r.mark}p{a}{b}"]


def train_joins(editor: Editor, ends: DataFrame, words: DataFrame, sample: int = CASES) -> None:
    """Fits the joins: line ends whose word the corpus has in one of the two ways only; frequent words divided at random, and those with a hyphen at it."""
    sure = ends.where("(joined_n > 0) <> (own_n > 0)").select("left", "right", "mark", "joined_n", "own_n", "left_n", "right_n").distinct()
    cases = [(r.left, "-", r.right, *_end_evidence(r), r.joined_n > 0) for r in _sample(sure, "left", "right", n=sample)]
    rng = random.Random(19)
    often = words.where(F.length("word").between(6, 30) & (F.col("n") >= 3)).select("word", "n")
    for r in _sample(often, "word", n=sample):
        left, mark, right = r.word.partition("-")
        if not mark:
            at = rng.randrange(2, len(r.word) - 2)
            left, right = r.word[:at], r.word[at:]
        if "-" in right or not (left + right).isalpha():
            continue
        parts = ("2", "2") if mark else (rng.choice("0001"), rng.choice("0001"))
        told = [f"p{parts[0]}{parts[1]}", "m0", f"m0p{parts[0]}{parts[1]}"]
        cases.append((left, "-", right, ["wo" if mark else "wj"], told, not mark))
    editor.fit_joins(cases)


def divided_words(ends: DataFrame, editor: Editor) -> DataFrame:
    """(record_table, record_id, item, nth, joined, divided): of each word at a line end, whether it was divided there.

    The editor decides; the check: a word that the corpus has with its own hyphen more often than joined was not, unless the mark is a soft one.
    """
    said = ends.sparkSession.sparkContext.broadcast(editor)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = []
            for r in b.itertuples(index=False):
                whole, parts = _end_evidence(r)
                own = r.own_n > r.joined_n and not r.mark % 2
                done.append(not own and said.value.join_margin(r.left, "-", r.right, parts + (whole if r.joined_n or r.own_n else ["?"])) > 0)
            yield pd.DataFrame({"record_table": b["record_table"], "record_id": b["record_id"], "item": b["item"], "nth": b["nth"], "joined": b["left"] + b["right"], "divided": done})

    return ends.mapInPandas(run, "record_table string, record_id long, item int, nth long, joined string, divided boolean")


def page_lines(facts: DataFrame) -> DataFrame:
    """(record_table, record_id, item, line, what, told, on): lines that may be furniture, with how many pages of the book have their text (4: more)."""
    x = facts.where("fact = 'line'").select("record_table", "record_id", "item", "book", F.col("n").alias("line"), F.col("a").alias("what"), F.col("b").alias("key"), "told")
    shapes = F.max((F.col("what").isin("both", "marked", "opening") | (F.col("what") == "title") & (F.col("book") != "")).cast("int"))
    keys = x.where("what in ('both', 'marked', 'opening', 'alone', 'title')").groupBy("record_table", "book", "key").agg(F.least(F.countDistinct("record_id"), F.lit(4)).alias("on"), shapes.alias("formed")).where("on > 1")
    j = x.join(keys, ["record_table", "book", "key"], "left")
    on = F.when(F.col("what") == "number", 1).otherwise(F.coalesce("on", F.lit(1)))
    return j.select("record_table", "record_id", "item", "line", "what", "told", on.cast("int").alias("on"), (F.coalesce("formed", F.lit(0)) > 0).alias("formed"))


def _line_features(what: str, told: str, on: int, formed: bool) -> list[str]:
    """A line's position and form, and how many pages have it; a line of one page only says nothing about repetition."""
    _, where, place, kind, more = told.split(",")
    out = [f"l{what}", f"l{what}{where}", f"l{what}{more}", f"l{what}{where}{place}", f"l{what}{where}{kind}", f"l{what}{where}{more}"]
    if on > 1:
        repeated = f"{on}{'f' if formed else 'p'}"
        out += [f"r{repeated}", f"r{repeated}{what}"]
    return out


def train_lines(editor: Editor, lines: DataFrame, pages: int = PAGES) -> dict[tuple, bool]:
    """Fits the furniture lines on kinds of lines, each as often as its share demands, and returns what each kind is told to be.

    There are as many rows as kinds of lines (form, place, repetition), whatever the number of pages. Sure cases: a text on
    ``pages`` pages is a header, seen with and without its repetition; a line within a block that stands nowhere else, and the title of a first page, is text; a number is a page number if it is that of the page, and none if it is another's.
    """
    kinds = [(r.what, r.told, r.on, r.formed, r.n) for r in lines.groupBy("what", "told", "on", "formed").agg(F.count("*").alias("n")).collect()]
    cases = []
    for what, told, on, formed, n in kinds:
        more = told.rsplit(",", 1)[1]
        times = 1 + step(n, 0, 10)
        if what == "number":
            if more[0] in "012":
                cases += [(_line_features(what, told, on, formed), more[0] != "2")] * times
            elif told.split(",")[1] != "m":
                cases += [(_line_features(what, told, on, formed), True)] * times
        elif what == "both" and more == "2" and on < pages:
            cases += [(_line_features(what, told, on, formed), False)] * times
        elif what == "title":
            cases += [(_line_features(what, told, on, formed), False)] * times
        elif on >= pages:
            cases += [(_line_features(what, told, k, formed), True) for k in ((on, 1) if what not in ("within", "alone") else (on,))] * times
        elif what in ("within", "alone") and on == 1:
            cases += [(_line_features(what, told, on, formed), False)] * times
        elif on > 1 and formed:
            cases += [(_line_features(what, told, on, formed), True)] * times
    editor.fit_lines(sorted(cases, key=str))
    return {(w, t, o, f): editor.lines.score(_line_features(w, t, o, f)) > 0 for w, t, o, f, _ in kinds}


def furniture(lines: DataFrame, told: dict[tuple, bool]) -> DataFrame:
    """(record_table, record_id, item, line, defect) of the lines that are told to be running headers or page numbers; a text with its page number holds both.

    The check: a line without a header's form must stand on PAGES pages, or on two of which one has it in such a form.
    """
    spark = lines.sparkSession
    lines = lines.where(~F.col("what").isin("alone", "within") | (F.col("on") >= PAGES) | (F.col("on") > 1) & F.col("formed"))
    rows = [(w, t, o, f, d) for (w, t, o, f), yes in told.items() if yes for d in {"number": ["page_number"], "both": ["header", "page_number"]}.get(w, ["header"])]
    sure = spark.createDataFrame(rows, "what string, told string, on int, formed boolean, defect string")
    return lines.join(F.broadcast(sure), ["what", "told", "on", "formed"]).select("record_table", "record_id", "item", "line", "defect")


def _words_of(texts: DataFrame) -> DataFrame:
    """Distinct words of each text as they stand there (form) and in the form of the vocabulary."""
    plain = F.regexp_replace("text", rf"[{HYPHEN}][ \t ]*\r?\n[ \t ]*", "")
    split = F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}\p{M}]+(?:[!|][\p{L}\p{N}\p{M}]+)*)"), F.lit(1))
    return texts.where("text is not null").select("record_table", "record_id", "item", F.explode(F.array_distinct(split)).alias("form")).withColumn("word", F.lower("form"))


class Scan:
    """The facts of a set of texts and what follows from them."""

    def __init__(self, texts: DataFrame, wide: DataFrame | None = None):
        """``wide``: the same texts on more partitions, for the pass in Python."""
        self.texts = texts if "last" in texts.columns else texts.withColumn("last", F.lit(False))
        wide = self.texts if wide is None else wide
        self.editor = Editor()
        self.facts = cut(wide.mapInPandas(_facts, FACTS))
        self.words = cut(vocabulary(self.facts))
        pairs = word_readings(self.words, self.facts)
        train_words(self.editor, self.words, pairs)
        ends = cut(line_ends(self.facts, self.words))
        train_joins(self.editor, ends, self.words)
        lines = cut(page_lines(self.facts))
        told = train_lines(self.editor, lines)
        self.readings = cut(misread_words(pairs, self.editor))
        self.divided = divided_words(ends, self.editor)
        self.furniture = furniture(lines, told)

    def misread(self) -> DataFrame:
        """(record_table, record_id, item, form, word, reading); the readings are sent along while they are few."""
        r = self.readings
        found = _words_of(self.texts).join(F.broadcast(r) if r.count() <= DOUBT else r, "word")
        first = F.substring("form", 1, 1)
        return found.where(F.col("capitals") | (first == F.lower(first))).select("record_table", "record_id", "item", "form", "word", "reading")

    def defects(self) -> DataFrame:
        """(record_table, record_id, item, defect), one row per defect that a text has."""
        cols = ("record_table", "record_id", "item")
        parts = (self.divided.where("divided").select(*cols, F.lit("hyphen").alias("defect")), self.misread().select(*cols, F.lit("misread").alias("defect")), self.furniture.select(*cols, "defect"))
        return parts[0].union(parts[1]).union(parts[2]).distinct()


def _mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        done = []
        for text, drop, keep, fixes in zip(b["text"], b["drop"], b["keep"], b["fixes"]):
            keep = set(keep) if keep is not None else set()
            nth = iter(range(1 << 30))
            # the numbering of divided words is that of the whole text, so they are joined before lines go
            t = _DIVIDED.sub(lambda m, keep=keep, nth=nth: f"{m[1]}{'-' * (next(nth) in keep)}{m[3]}{LINE_MARK}", text)
            out, i = [], 0
            gone = set(drop) if drop is not None else set()
            for line in t.split("\n"):
                if i not in gone:
                    out.append(line.replace(LINE_MARK, ""))
                i += 1 + line.count(LINE_MARK)
            t = re.sub(r"[ \t\r\xa0]*\n[ \t]*", " ", "\n".join(x for x in out if x.strip()))
            if fixes is not None and len(fixes):
                f = dict(fixes)

                def fix(m, f=f):
                    r = f.get(m[0])
                    return m[0] if r is None else r[:1].upper() + r[1:] if m[0][:1].isupper() else r

                t = re.sub(r"[^\W_]+(?:[!|][^\W_]+)*", fix, t)
            done.append(t.strip())
        yield pd.DataFrame({c: b[c] for c in ("record_table", "record_id", "item")} | {"text": done, "damaged": [d is not None or f is not None or k for d, f, k in zip(b["drop"], b["fixes"], b["hyphen"])]})


def repaired(scan: Scan) -> DataFrame:
    """(record_table, record_id, item, text, damaged): each text as one continuous paragraph.

    Furniture lines go, divided words are joined, misread words get their readings, lines are run on. Null texts stay
    out, blank ones come out blank. Texts without damage are run on only.
    """
    cols = ("record_table", "record_id", "item")
    drop = scan.furniture.groupBy(*cols).agg(F.collect_set("line").alias("drop"))
    lines = scan.divided.groupBy(*cols).agg(F.collect_set(F.when(~F.col("divided"), F.col("nth"))).alias("keep"), F.max("divided").alias("hyphen"))
    fixes = scan.misread().select(*cols, "form", "reading").distinct().groupBy(*cols).agg(F.map_from_entries(F.collect_list(F.struct("form", "reading"))).alias("fixes"))
    # on the keys alone, as the joins are: the texts are shuffled once
    t = scan.texts.where("text is not null").select(*cols, "text").dropDuplicates(list(cols))
    t = t.join(drop, list(cols), "left").join(lines, list(cols), "left").join(fixes, list(cols), "left")
    return t.withColumn("hyphen", F.coalesce("hyphen", F.lit(False))).mapInPandas(_mend, "record_table string, record_id long, item int, text string, damaged boolean")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return Scan(scanned_texts(spark, root), scanned_texts(spark, root, wide=True)).defects()


def p2_repaired(spark: SparkSession, root: str) -> DataFrame:
    return repaired(Scan(scanned_texts(spark, root), scanned_texts(spark, root, wide=True)))


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
SQL: dict[str, str] = {}
