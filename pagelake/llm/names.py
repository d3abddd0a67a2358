"""Variant spellings of persons and organisations, linked within a book.

Metric-space partitioning: the words of all names are points under edit distance. A book's pivots split them into
cells; a word goes to its nearest pivot's cell and, by the triangle inequality, as a guest to every cell before it whose words may
be within the radius; inside a cell the radius join is exact. Two neighbours in each other's place are two edits, but the words then
have the same letters, so these meet by their letters. Names that meet through the rarest word of one of them are compared as
names (titles, order, initials, nicknames, abbreviations, joined parts): a person's name fits another only if each of its words
does. Full names are grouped first; initials and acronyms then join the one group they fit, or none if they fit several.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import groupby, islice, permutations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.llm.lookalikes import shape
from pagelake.operators.components import components
from pagelake.session import cut
from pagelake.sources.tables import table

#: Parameters: least words of a cell aimed at, radius in the pivots' metric, and, for the head words
#: of technical terms, books and share of the script's books they must be in and the least share of technical labels.
CELL, RADIUS, BOOKS, BOOK_SHARE, TECHNICAL = 32, 1, 2, 0.02, 0.75
#: Titles before or after names.
TITLES = set(
    "dr prof professor capt captain mr mrs ms miss sir lady lord rev esq hon col gen lt sgt maj mme mlle herr frau sr sra don dona sig dott doctor "
    "г-н г-жа д-р проф господин госпожа السيد السيدة د الدكتور دكتور أستاذ శ్రీ గారు డా శ్రీమతి श्री जी डॉ श्रीमती सुश्री".split()
)
SUFFIX_TITLES = re.compile(r"(?:氏|博士|先生|さん|様|教授|女士|小姐)$")
#: Words of bodies, with their abbreviations; words that do not count.
BODIES = {
    "university": "univ", "faculty": "fac", "society": "soc", "association": "assoc assn", "institute": "inst", "institution": "instn", "department": "dept dep", "academy": "acad", "company": "co coy",
    "limited": "ltd", "railway": "rly ry", "royal": "roy", "college": "coll", "museum": "mus", "library": "lib", "school": "sch", "committee": "cttee", "council": "cncl", "brothers": "bros", "incorporated": "inc", "corporation": "corp",
}
SHORT = {a: w for w, xs in BODIES.items() for a in xs.split()} | {"&": "and"}
IDLE = {"of", "for", "the", "and", "in", "de", "la", "du", "des", "der", "und", "y", "e", "et", "&"}
#: Given names with their short forms.
NICKNAMES = """augustine gus gussie austin;agnes aggie nessie;albert al bertie;arthur art artie;barbara babs;caroline carrie;constance connie;eugene gene;florence flo flossie;gertrude trudy gertie;harold harry;hermann manni;jacob jake
josephine josie;judith judy;lawrence larry laurie;louis lou louie;lucy lulu;oliver ollie noll;penelope penny;raymond ray;stephen steve;timothy tim;victoria vicky;vincent vince;alexander alex sandy sasha alec xander;alexandra sasha sandra;andrew andy drew;anna annie nan nancy;anthony tony;antonio toni tonio;benjamin ben benny;catherine cathy kate kitty
charles charlie chuck charley carl;christopher chris kit;daniel dan danny;david dave davy;dmitri dima mitya dmitry;dorothy dot dolly dottie dora;edward ed eddie ned ted teddy;ekaterina katya katia katja kate;eleanor nell nellie ellie nora
elizabeth liz lizzie betty bess beth eliza betsy lisa;emily em emmy;frances fanny frankie fran;francis frank;francisco paco pancho curro;frederick fred freddy;friedrich fritz fiete fred freddy;george geordie georgie;giovanni gianni nino
giuseppe beppe peppe pino;heinrich heinz heiner hinz hein;helen nell nelly;henry hal harry hank;isabella bella izzy isa bell;ivan vanya;james jim jimmy jamie;johannes hans jo johann hannes;john jack johnny;jose pepe;joseph joe jo joey;katherine kate kathy kitty katie kit kath
leonora nora lena leo;ludwig lutz;margaret maggie meg peggy madge greta;maria masha mary;martha patty mattie;mary molly polly may;matthew matt;michael mike mick mickey;mikhail misha;nathaniel nat nathan nate;nicholas nick nicky;nikolai kolya;olga olya;patrick pat paddy
peter pete;philip phil pip;rebecca becky;richard dick rick rich richie;robert bob rob bobby robin bert;samuel sam sammy;sarah sally sadie;sergei seryozha;sophia sophie;susannah sukey susan sue susie sukie;tatiana tanya;theodore theo ted teddy;thomas tom tommy
vladimir volodya vova;walter walt wat;wilhelm willi willy;william bill will billy willy liam;winifred winnie freda"""
NICK: dict[str, set[int]] = {}
for _n, _line in enumerate(re.split(r"[;\n]", NICKNAMES)):
    for _w in _line.split():
        NICK.setdefault(_w, set()).add(_n)
_LATIN_EXTRA = str.maketrans("øđłıßæœ", "odlisae")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Ý])")
_INITIALS = re.compile(r"(?:[^\W\d_]\.\s?){2,}")
_SPLIT = re.compile(r"[\s・·=＝/]+")


def fold(word: str) -> str:
    """Lower case, for Latin letters no accents, for Arabic no article."""
    w = word.lower()
    if w.isascii():
        return w
    if w.startswith("ال") and len(w) > 5:
        return w[2:]
    d = unicodedata.normalize("NFD", w)
    if any("a" <= c <= "z" for c in d):
        d = "".join(c for c in d if not unicodedata.combining(c)).translate(_LATIN_EXTRA)
    return unicodedata.normalize("NFC", d)


def levenshtein(a: str, b: str) -> int:
    """Edit distance without swaps (a metric), bit-parallel over the letters of ``a``."""
    if not a or not b:
        return len(a) or len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(zero | up) & full, zero & up
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(zero | plus)) & full, plus & zero & full
    return score


def near(a: str, b: str) -> bool:
    """Whether one edit or one swap of neighbours at most makes ``a`` ``b`` (Damerau-Levenshtein distance 1)."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    i = 0
    while i < n and i < m and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]


class Name:
    """A form taken apart: kind 'person', 'body' or 'acronym'; words, initials, and the parts of a body between commas."""

    def __init__(self, form: str):
        text = shape(form).strip()
        self.kind, self.initials, self.words, self.short, self.parts = "person", "", [], set(), []
        letters = re.sub(r"[\s.\-]", "", text)
        if 3 <= len(letters) <= 9 and letters.isupper() and letters.isalpha() and (re.fullmatch(r"(?:[^\W\d_][.\s]?)+\.?", text) and ("." in text or " " not in text and letters.isascii() and len(letters) <= 6)):
            self.kind, self.words, self.parts = "acronym", [fold(letters)], [[fold(letters)]]
            return
        plain = [fold(w.strip(".,()")) for w in _SPLIT.split(text)]
        if any(w in BODIES or w in SHORT and w not in ("&", "co") for w in plain) and len(plain) > 2:
            self.kind = "body"
            for part in re.split(r"[,()]", _CAMEL.sub(" ", text)):
                words = []
                for raw in _SPLIT.split(part.strip()):
                    w = fold(raw.strip("."))
                    w = SHORT.get(w, w)
                    if w and w not in IDLE:
                        words.append(w)
                        if raw.endswith(".") and w == fold(raw.strip(".")):
                            self.short.add(w)
                if words:
                    self.parts.append(words)
            self.words = [w for p in self.parts for w in p]
            return
        text = SUFFIX_TITLES.sub("", text)
        tokens = [t for t in re.split(r"[\s・·=＝,،、()]+", _CAMEL.sub(" ", text)) if t]
        capital = all(t.isupper() for t in tokens if len(t) > 1)
        for t in tokens:
            bare = t.strip(".")
            f = fold(bare)
            if not f or f in TITLES:
                continue
            pieces = [p for p in t.split(".") if p]
            if len(bare) == 1 and (t.endswith(".") or bare.isupper()) or len(pieces) > 1 and all(len(p) == 1 for p in pieces):
                self.initials += "".join(fold(p) for p in pieces)
            elif 2 <= len(bare) <= 3 and bare.isupper() and bare.isascii() and not capital and len(tokens) > 1:
                self.initials += f
            else:
                self.words.append(f)

    def keys(self) -> list[tuple[str, str, str]]:
        """What the name is met by, as (key, role, word).

        Role 'word': a word of a person, of which the rarest seeks others; 'nick': the given name that a word is short for,
        seeking if the word is; 'seek': words of bodies and acronyms, all seek; 'met': both ways of joining two words.
        """
        if self.kind == "acronym":
            return [("@" + self.words[0], "seek", "")]
        if self.kind == "body":
            orders = permutations(self.parts) if len(self.parts) <= 3 else [self.parts]
            shorts = dict.fromkeys("@" + "".join(w[0] for p in o for w in p) for o in orders)
            return [(w, "seek", "") for w in dict.fromkeys(self.words) if w not in BODIES and len(w) > 2] + [(k, "seek", "") for k in shorts]
        words = list(dict.fromkeys(w for w in self.words if len(w) > 1))
        out = [(w, "word", w) for w in words] + [(f"#{g}", "nick", w) for w in words for g in sorted(NICK.get(w, ()))]
        if len(self.words) == 2 and not self.initials:
            joined = dict.fromkeys(("".join(self.words), "".join(reversed(self.words))))
            out += [(k, "met", "") for k in joined if k not in words]
        return out

    @property
    def full(self) -> bool:
        """Whether the name stands for itself: a body's name or a person's with a given name."""
        return self.kind == "body" or self.kind == "person" and (len(self.words) > 1 or not self.initials)


def _word_cost(a: str, b: str) -> int | None:
    """0 if equal, 1 if near and long enough for that to mean the same, None otherwise."""
    if a == b:
        return 0
    if min(len(a), len(b)) >= (3 if max(a) > "ऀ" else 4) and near(a, b):
        return 1
    return None


def _given(a: str, b: str) -> bool:
    return bool(NICK.get(a, set()) & NICK.get(b, set()))


def _same_bodies(a: Name, b: Name) -> bool:
    """Whether each word of ``a`` goes with another one of ``b``, at two typos at most."""
    left, typos = list(b.words), 0
    for w in a.words:
        fits = [(0 if w == x else 1, x) for x in left if w == x or min(len(w), len(x)) >= 4 and near(w, x) or w in a.short and x.startswith(w) or x in b.short and w.startswith(x)]
        if not fits:
            return False
        cost, x = min(fits)
        typos += cost and not (w in a.short or x in b.short)
        left.remove(x)
    return typos <= 2


def same(a: Name, b: Name) -> bool:
    """Whether two forms can name the same person or body; the order of the two makes no difference."""
    if "acronym" in (a.kind, b.kind):
        theirs = {k for k, _, _ in b.keys()}
        return any(k[0] == "@" and k in theirs for k, _, _ in a.keys())
    if a.kind != b.kind:
        return False
    if a.kind == "body":
        # which word an abbreviation is given to depends on the side that asks, so both may
        return len(a.words) == len(b.words) and (_same_bodies(a, b) or bool(a.short or b.short) and _same_bodies(b, a))
    if not a.words or not b.words:
        return False
    if len(a.words) > len(b.words):
        a, b = b, a
    if len(a.words) == 1 and not a.initials:
        w = a.words[0]
        return len(b.words) == 1 and not b.initials and w == b.words[0] or len(b.words) == 2 and len(w) >= 4 and any(near(w, "".join(o)) for o in (b.words, b.words[::-1]))
    if len(a.words) == 1:
        for w in b.words:
            if _word_cost(a.words[0], w) is None:
                continue
            rest = [x for x in b.words if x is not w]
            if not rest:
                if a.initials[0] == b.initials[:1] and (len(a.initials) == 1 or len(b.initials) == 1 or a.initials[1] == b.initials[1]):
                    return True
                continue
            starts = {rest[0][0], *(x[0] for x, ns in NICK.items() if ns & NICK.get(rest[0], set()) and NICKFULL.get(x))}
            middle = b.initials[:1] or (rest[1][0] if len(rest) > 1 else "")
            if a.initials[0] in starts and (len(a.initials) == 1 or not middle or a.initials[1] == middle):
                return True
        return False
    if a.initials and b.initials and a.initials != b.initials:
        return False
    # words that both have go together; of the others at most three can fit (two edits, one nickname)
    mine, theirs = list(a.words), list(b.words)
    for w in a.words:
        if w in theirs:
            mine.remove(w)
            theirs.remove(w)
    return len(mine) <= 3 and _fits(mine, theirs, [])


def _fits(mine: list[str], theirs: list[str], pairs: list[tuple[str, str, int]]) -> bool:
    """Whether each of ``mine`` goes with another one of ``theirs`` at two edits and one nickname at most."""
    if not mine:
        edited = [max(len(x), len(y)) for x, y, c in pairs if c]
        return len(edited) < 2 or min(edited) >= 5
    x = mine[0]
    for k, y in enumerate(theirs):
        cost = 0 if _given(x, y) else _word_cost(x, y)
        if cost is None:
            continue
        now = [*pairs, (x, y, cost)]
        if sum(c for _, _, c in now) <= 2 and sum(not c for _, _, c in now) <= 1 and _fits(mine[1:], theirs[:k] + theirs[k + 1 :], now):
            return True
    return False


#: The full form of each group of given names.
NICKFULL = {line.split()[0]: True for line in re.split(r"[;\n]", NICKNAMES) if line.split()}


def _features(form: str) -> list[str]:
    """What may tell a technical term: its words, and endings where words are not set apart."""
    text = fold(shape(form))
    out = [w for w in re.split(r"[\s\-・=·\d.,()/]+", text) if len(w) > 1]
    joined = re.sub(r"[\s\-・=·\d.,()/]+", "", text)
    if joined and joined > "⹿":
        out += ["~" + joined[-k:] for k in range(2 if joined[-1] > "㐀" else 3, min(7, len(joined)))]
    return list(dict.fromkeys(out))


def technical_heads(labelled: DataFrame) -> DataFrame:
    """(feature, book) that marks technical terms, from (book, form, category).

    book is null for what marks them everywhere: mostly so labelled, in several books and a share of its script's books.
    Within one book a feature of several labelled forms, all technical, is enough.
    """
    split = F.pandas_udf(lambda s: s.map(_features), "array<string>")
    script = F.floor(F.ascii(F.regexp_replace("feature", "^~", "")) / 256)
    one = labelled.where("form is not null").groupBy("book", "form").agg(F.sum(F.when(F.col("category") == "technical_term", 1).when(F.col("category") == "proper_name", -1).otherwise(0)).alias("n"))
    one = one.where("n <> 0").select("book", (F.col("n") > 0).cast("int").alias("tech"), F.explode(split("form")).alias("feature"))
    per = cut(one.groupBy("feature", "book").agg(F.sum("tech").alias("t"), F.count("*").alias("n")).withColumn("script", script))
    books = per.select("script", "book").distinct().groupBy("script").agg(F.count("*").alias("of"))
    every = per.groupBy("feature", "script").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.count("*").alias("books")).join(F.broadcast(books), "script")
    every = every.where((F.col("books") >= F.greatest(F.lit(BOOKS), BOOK_SHARE * F.col("of"))) & (F.col("t") >= TECHNICAL * F.col("n"))).select("feature", F.lit(None).cast("string").alias("book"))
    return every.union(per.where("n >= 2 and t = n").select("feature", "book"))


def _by(batches: Iterator[pd.DataFrame], *by: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of consecutive rows of sorted batches."""
    rows = (r for b in batches for r in b.itertuples(index=False))
    for k, g in groupby(rows, key=lambda r: tuple(getattr(r, c) for c in by)):
        yield k, list(g)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        names = [Name(f) for f in b["form"]]
        keys = [[{"word": k, "role": r, "of": w} for k, r, w in n.keys()] for n in names]
        yield pd.DataFrame({"book": b["book"], "form": b["form"], "full": [n.full for n in names], "keys": keys})


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A word to the cell of its nearest pivot, as a guest to all before it that the triangle inequality leaves open, and to the cell of its letters."""
    for b in batches:
        rows = []
        for k, w, pivots in zip(b["book"], b["word"], b["pivots"]):
            d = [levenshtein(w, p) for p in pivots]
            home = d.index(min(d))
            rows.append((k, str(home), w, True, d[home]))
            rows += [(k, str(i), w, False, x) for i, x in enumerate(d[:home]) if x <= d[home] + 2 * RADIUS]
            if len(w) > 2:
                rows.append((k, "~" + "".join(sorted(w)), w, True, 0))
        yield pd.DataFrame(rows, columns=["book", "cell", "word", "home", "d"])


def _join_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The exact radius join of each cell: its own words with each other and with its guests."""
    out = []
    for (book, cell), rows in _by(batches, "book", "cell"):
        rows.sort(key=lambda r: r.d)
        letters, low = cell[0] == "~", 0
        for x in rows:
            if not x.home:
                continue
            if not letters:
                out.append((book, x.word, x.word))
                if len(x.word) < 3 or x.word[0] in "@#":
                    continue
            while rows[low].d < x.d - RADIUS:
                low += 1
            for y in islice(rows, low, None):
                if y.d > x.d + RADIUS:
                    break
                if (x.word < y.word or not y.home) and x.word != y.word and len(y.word) > 2 and y.word[0] not in "@#" and near(x.word, y.word):
                    out.append((book, min(x.word, y.word), max(x.word, y.word)))
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=["book", "a", "b"])
            out = []
    yield pd.DataFrame(out, columns=["book", "a", "b"])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[str, Name] = {}

    def name(f: str) -> Name:
        if len(seen) > 100_000:
            seen.clear()
        if f not in seen:
            seen[f] = Name(f)
        return seen[f]

    for b in batches:
        rows = []
        for i, f, j, g in zip(b["id_a"], b["form_a"], b["id_b"], b["form_b"]):
            x, y = name(f), name(g)
            if same(x, y):
                rows.append((i, j, x.full, y.full))
        yield pd.DataFrame(rows, columns=["a", "b", "full_a", "full_b"])


def meeting(keys: DataFrame, cell: int = CELL) -> DataFrame:
    """(book, a, b): pairs of words of a book that are equal, one edit or one swap of neighbours apart, a <= b, of (book, word).

    Each book has about as many pivots as the root of its words, so that finding cells and joining in them cost alike, and no more than
    leave ``cell`` words to each.
    """
    points = keys.select("book", "word").distinct()
    counts = points.groupBy("book").agg(F.count("*").alias("n"), F.min("word").alias("one"))
    chosen = F.pmod(F.xxhash64("word", F.lit(5)), F.col("n")) < F.least(F.sqrt("n"), F.col("n") / cell)
    pivots = points.join(counts, "book").where(chosen | (F.col("word") == F.col("one"))).groupBy("book").agg(F.array_sort(F.collect_set("word")).alias("pivots"))
    cells = points.join(pivots, "book").mapInPandas(_cells, "book string, cell string, word string, home boolean, d int")
    return cells.repartition("book", "cell").sortWithinPartitions("book", "cell").mapInPandas(_join_cell, "book string, a string, b string").distinct()


def candidate_pairs(names: DataFrame, cell: int = CELL) -> DataFrame:
    """(id_a, form_a, id_b, form_b): names of a book that meet through a key that one of them seeks by, of (book, id, form, keys)."""
    keys = cut(names.select("book", "id", "form", F.explode("keys").alias("k")).select("book", "id", "form", "k.word", "k.role", "k.of"))
    # a person seeks by its rarest word in the book, so a common given name alone brings no one together
    often = keys.groupBy("book", "word").agg(F.count("*").alias("n"))
    rare = keys.where("role = 'word'").join(often, ["book", "word"]).groupBy("id").agg(F.min(F.struct("n", "word")).alias("m")).select("id", F.col("m.word").alias("of"))
    asked = keys.join(rare.withColumn("rarest", F.lit(True)), ["id", "of"], "left").where("role = 'seek' or rarest").select("book", "id", "form", "word")
    met = meeting(keys, cell)
    met = met.union(met.where("a <> b").select("book", "b", "a"))
    seek = asked.select("book", F.col("word").alias("a"), F.col("id").alias("id_a"), F.col("form").alias("form_a"))
    found = keys.select("book", F.col("word").alias("b"), F.col("id").alias("id_b"), F.col("form").alias("form_b"))
    p = met.join(seek, ["book", "a"]).join(found, ["book", "b"]).where("id_a <> id_b")
    first = F.col("id_a") < F.col("id_b")
    ends = [F.when(first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in ("id", "form")]
    return p.select(*ends).groupBy("id_a", "id_b").agg(F.first("form_a").alias("form_a"), F.first("form_b").alias("form_b")).select("id_a", "form_a", "id_b", "form_b")


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of each node, linked or not."""
    return nodes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))


def name_sets(forms: DataFrame, labelled: DataFrame, cell: int = CELL) -> DataFrame:
    """(book, id, form, root): the set of each form of each candidate that names a person or body, by the key root.

    forms: (book, id, form), labelled: (book, form, category). Null and blank forms are dropped, as are technical terms:
    by their own labels, or by a head word that the corpus labels technical. A null book is a book of its own. Ids may
    be of any type; repeated rows count once. All forms of a candidate belong together. ``cell`` changes the cost, not the rows.
    """
    known = labelled.select(F.coalesce("book", F.lit("")).alias("book"), "form", "category")
    f = cut(forms.where("form is not null and trim(form) <> '' and id is not null").select(F.coalesce("book", F.lit("")).alias("book"), "id", "form").distinct())
    split = F.pandas_udf(lambda s: s.map(_features), "array<string>")
    heads = cut(technical_heads(known))
    shown = cut(f.select("book", "form").distinct().select("book", "form", F.explode(split("form")).alias("feature")))
    marked = shown.join(heads.where("book is null").select("feature"), "feature", "left_semi").unionByName(shown.join(heads.where("book is not null"), ["feature", "book"], "left_semi"))
    marked = marked.select("book", "form").distinct().withColumn("head", F.lit(True))
    own = known.groupBy("book", "form").agg(F.sum(F.when(F.col("category") == "technical_term", 1).when(F.col("category") == "proper_name", -1).otherwise(0)).alias("n"))
    f = f.join(marked, ["book", "form"], "left").join(own, ["book", "form"], "left")
    technical = F.coalesce(F.col("head"), F.lit(False)) | (F.coalesce("n", F.lit(0)) > 0)
    # a candidate with one technical form is technical
    per = W.partitionBy("book", "id")
    f = f.withColumn("bad", F.max(technical).over(per)).where("not bad").select("book", "id", "form")
    parsed = f.select("book", "form").distinct().mapInPandas(_parse, "book string, form string, full boolean, keys array<struct<word: string, role: string, of: string>>")
    # written out, so the numbers of the forms stay
    t = cut(parsed.withColumn("node", F.monotonically_increasing_id()))
    f = cut(f.join(t.select("book", "form", "node"), ["book", "form"]))
    pairs = candidate_pairs(t.select("book", F.col("node").alias("id"), "form", "keys"), cell)
    links = cut(pairs.mapInPandas(_compare, "a long, b long, full_a boolean, full_b boolean"))
    mine = f.select(F.col("node").alias("a"), F.min("node").over(per).alias("b"))
    s = cut(_roots(t.select("node"), links.where("full_a and full_b").select("a", "b").union(mine)))
    weak = links.where("not (full_a and full_b)").select("a", "b")
    weak = weak.union(weak.select("b", "a")).toDF("x", "y")
    ends = weak.join(s.toDF("y", "ry"), "y").join(s.toDF("x", "rx"), "x").where("rx <> ry").select("rx", "ry").distinct()
    # groups of full names are settled; a group of short forms alone joins the one settled group it fits
    settled = t.where("full").select("node").join(s, "node").select(F.col("root").alias("ry")).distinct().withColumn("settled", F.lit(True))
    ends = cut(ends.join(settled, "ry", "left").join(settled.select(F.col("ry").alias("rx")), "rx", "left_anti"))
    fits = ends.where("settled").groupBy("rx").agg(F.count("*").alias("n"), F.min("ry").alias("ry"))
    joins = fits.where("n = 1").select(F.col("rx").alias("a"), F.col("ry").alias("b"))
    loose = ends.where("settled is null").join(fits.select("rx"), "rx", "left_anti").join(fits.select(F.col("rx").alias("ry")), "ry", "left_anti")
    final = components(joins.union(loose.select(F.col("rx").alias("a"), F.col("ry").alias("b"))))
    # the root of a form is the root of its group
    whole = s.join(final.toDF("root", "last"), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return f.join(whole, "node").select("book", "id", "form", "root")


def _sets(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "terminology_candidates", "candidate_id", "book_id", "source_form", "source_forms", "declared_categories")
    m = table(spark, root, "term_mentions", "book_id", "term", "category")
    forms = c.select(F.col("book_id").alias("book"), F.col("candidate_id").alias("id"), F.explode(F.array_distinct(F.concat(F.array("source_form"), F.coalesce("source_forms", F.array())))).alias("form"))
    own = c.select("book_id", F.explode("source_forms").alias("form"), "declared_categories").select("book_id", "form", F.explode("declared_categories").alias("category"))
    return name_sets(forms, m.toDF("book", "form", "category").union(own))


def p3_sets(spark: SparkSession, root: str) -> DataFrame:
    """One row per set of a book: its candidates in order."""
    s = _sets(spark, root)
    sets = s.groupBy(F.col("book").alias("book_id"), "root").agg(F.min("form").alias("name"), F.array_sort(F.collect_set("id")).alias("candidate_ids"))
    return sets.drop("root")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    s = cut(_sets(spark, root).select("id", "root").distinct())
    a, b = (s.select("root", F.col("id").alias(f"candidate_id_{x}")) for x in "ab")
    return a.join(b, "root").where("candidate_id_a < candidate_id_b").select("candidate_id_a", "candidate_id_b").distinct()


QUERIES = {"p3_found": p3_found, "p3_sets": p3_sets}
SQL: dict[str, str] = {}
