"""Languages of pages and paragraphs by error-correcting output codes over character n-grams.

Each language has a codeword of BITS bits; one linear classifier a bit, over hashed n-grams of the words, is fitted
on a bounded sample of paragraphs whose label is that of most pages of their book. A text's margins are decoded to
the codeword of least logistic loss; the gap to the next one gives the confidence and flags ambiguous texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.sources.tables import spread, table

#: Parameters: paragraphs a language of the sample, bits of a codeword, buckets of n-grams, the longest n-gram, ridge, the
#: sharpness of the confidence, the confidence below which a text is ambiguous, and paragraphs that make a language.
SAMPLE, BITS, BUCKETS, LONGEST, RIDGE, SHARP, CLEAR, LEAST = 200, 24, 8_192, 4, 0.05, 3.0, 0.8, 10
LEAST_LETTERS, LEAST_WORDS, LEAST_WIDE = 14, 3, 6
NO_TEXT = ("illustration", "table", "page_number")
#: Names and three-letter codes of languages by their two-letter code.
NAMES = {
    "en": "eng english anglais englisch inglés inglese inglês английский", "fr": "fra fre french français francais französisch", "de": "deu ger german deutsch allemand",
    "es": "spa spanish español espanol castellano spanisch", "it": "ita italian italiano italienisch", "pt": "por portuguese português portugues", "ru": "rus russian русский",
    "ja": "jpn japanese 日本語", "zh": "zho chi cmn chinese mandarin 中文 汉语 漢語 简体中文 繁體中文", "ar": "ara arabic العربية عربي عربية", "hi": "hin hindi हिन्दी हिंदी", "te": "tel telugu తెలుగు",
}
CODES = {w: c for c, ws in NAMES.items() for w in ws.split()} | {c: c for c in NAMES}
#: Two letters that stand for no language.
NO_CODES = ("xx", "zz", "qq")
_WIDE = re.compile(r"[\u2e80-\u9fff\uf900-\ufaff]")
_WORD = re.compile(r"[\u2e80-\u9fff\uf900-\ufaff]|[^\W\d_\u2e80-\u9fff\uf900-\ufaff]+")
_PLAIN = re.compile(r"[^\W\d_]+")
_ROMAN = re.compile(r"[ivxlcdm]+")


def label_code(label: Column) -> Column:
    """The two-letter code that a label names, or null: region variants, names and three-letter codes of the languages in NAMES, and any code of two letters."""
    plain = F.lower(F.trim(label))
    known = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    first = F.regexp_extract(plain, r"^([^-_ (]+)", 1)
    return F.coalesce(known[plain], known[first], F.when(first.rlike("^[a-z]{2}$") & ~first.isin(*NO_CODES), first))


def words(text: str) -> list[str]:
    """Words, and pairs of characters where words are not set apart."""
    plain = unicodedata.normalize("NFKC", text).lower()
    if not _WIDE.search(plain):
        return _PLAIN.findall(plain)
    found = _WORD.findall(plain)
    single = [len(w) == 1 and w > "\u2e7f" for w in found]
    return found + [a + b for a, b, x, y in zip(found, found[1:], single, single[1:]) if x and y]


@lru_cache(100_000)
def grams(word: str) -> list[int]:
    """Buckets of a word's n-grams, its ends marked."""
    w = f"<{word}>"
    n = len(w)
    return [crc32(w[i : i + k].encode()) % BUCKETS for k in range(1, LONGEST + 1) for i in range(n - k + 1)] or [0]


def codewords(classes: int, bits: int = BITS) -> np.ndarray:
    """Codes of +1 and -1, the best of some seeded drafts by least distance between two languages; no bit is constant."""
    rng, best, score = np.random.default_rng(0), None, -1
    for _ in range(400):
        c = rng.choice([-1.0, 1.0], (classes, bits))
        if classes > 1:
            c[:, np.abs(c.sum(0)) == classes] *= np.where(np.arange(classes) % 2, 1, -1)[:, None]
            apart = (bits - c @ c.T) / 2 + bits * np.eye(classes)
            if apart.min() > score:
                best, score = c, apart.min()
        else:
            return c
    return best


class Model:
    """Weights of the bits and the codewords of the languages."""

    def __init__(self, texts: list[str], labels: list[str]):
        self.languages = sorted(set(labels))
        self.codes = codewords(len(self.languages))
        x = np.zeros((len(texts), BUCKETS), np.float32)
        for i, t in enumerate(texts):
            ids = [g for w in words(t) for g in grams(w)]
            if ids:
                x[i] = np.bincount(ids, minlength=BUCKETS) / len(ids)
        scale = 1 / max(float(np.sqrt((x * x).sum(1)).mean()), 1e-9) if len(texts) else 1.0
        x *= np.float32(scale)
        y = self.codes[[self.languages.index(k) for k in labels]] if len(texts) else np.zeros((0, BITS))
        k = (x @ x.T).astype(np.float64)
        k[np.diag_indices_from(k)] += RIDGE * max(len(texts), 1) ** 0.5
        self.weights = (x.T @ np.linalg.solve(k, y).astype(np.float32) * np.float32(scale)).astype(np.float32) if len(texts) else np.zeros((BUCKETS, BITS), np.float32)
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.rows, self.sizes = np.zeros((1024, BITS), np.float32), np.zeros(1024, np.float32)

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("languages", "codes", "weights")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def _id(self, w: str) -> int:
        i = self.seen.get(w)
        if i is None:
            if len(self.seen) >= 200_000:
                self.forget()
            i = self.seen[w] = len(self.seen)
            if i == len(self.sizes):
                self.rows, self.sizes = np.concatenate((self.rows, np.zeros_like(self.rows))), np.concatenate((self.sizes, np.zeros_like(self.sizes)))
            ids = grams(w)
            self.rows[i], self.sizes[i] = self.weights[ids].sum(0), len(ids)
        return i

    def decode(self, text: str | None) -> tuple[str | None, float]:
        """(language, confidence) of a text; (None, 0) if it has too few letters to tell."""
        ws = words(text) if text else []
        wide = sum(len(w) == 1 and w > "\u2e7f" for w in ws)
        plain = [w for w in ws if not (len(w) == 1 or wide and len(w) == 2) and not _ROMAN.fullmatch(w)]
        if not self.languages or wide < LEAST_WIDE and (len(plain) < LEAST_WORDS or sum(map(len, plain)) < LEAST_LETTERS):
            return None, 0.0
        ids = []
        for w in ws:
            i = self._id(w)
            if not i and ids:
                ids = [self._id(x) for x in ws]
                break
            ids.append(i)
        margins = self.rows[ids].sum(0) / self.sizes[ids].sum()
        loss = np.log1p(np.exp(-SHARP * self.codes * margins)).sum(1)
        p = np.exp(loss.min() - loss)
        k = int(loss.argmin())
        return self.languages[k], float(p[k] / p.sum())


def texts_of(spark: SparkSession, root: str) -> DataFrame:
    """(record_table, record_id, book, label, texts, types) of both tables, a row a page."""
    p = table(spark, root, "page_extractions", "extraction_id", "book_id", "source_lang", "blocks")
    c = table(spark, root, "corpus_pages", "page_key", "source_lang", "source")
    a = p.select(F.lit("page_extractions").alias("record_table"), F.col("extraction_id").alias("record_id"), F.col("book_id").alias("book"), "source_lang", F.col("blocks.text").alias("texts"), F.col("blocks.type").alias("types"))
    b = c.select(F.lit("corpus_pages"), F.col("page_key"), F.lit(None).cast("string"), "source_lang", F.col("source"), F.lit(None).cast("array<string>"))
    return a.union(b)


def fit(pages: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> Model:
    """The model from at most ``sample`` paragraphs a language; labels of a book are outvoted by its other pages'.

    pages: as from :func:`texts_of`. The languages are those of the labels that have ``least`` paragraphs in the sample and
    tell half of them at least. The sample is by
    seeded hash: enough pages for it, then the first paragraphs of them.
    """
    pages = pages.withColumn("code", label_code(F.col("source_lang"))).withColumn("h", F.pmod(F.xxhash64("record_table", "record_id", F.lit(11)), F.lit(1_000_003)) / 1_000_003.0)
    books = pages.where("book is not null and code is not null").groupBy("book", "code").count()
    books = books.groupBy("book").agg(F.max(F.struct("count", "code")).alias("m")).select("book", F.col("m.code").alias("language"))
    labelled = pages.join(books, "book", "left").withColumn("language", F.coalesce("language", "code")).where("language is not null")
    counts = {r[0]: r[1] for r in labelled.groupBy("language").count().collect()}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, 4.0 * sample / n)]) if counts else F.create_map(F.lit(""), F.lit(1.0))
    t = labelled.where(F.col("h") < share[F.col("language")]).select("language", "h", "types", F.posexplode("texts").alias("i", "text"))
    t = t.where(F.length("text") >= 60).where(~F.coalesce(F.get("types", F.col("i")).isin(*NO_TEXT), F.lit(False)))
    t = t.select("language", "text", F.row_number().over(W.partitionBy("language").orderBy("h", "i")).alias("n")).where(F.col("n") <= sample)
    rows = sorted((r[0], r[1]) for r in t.select("language", "text").collect())
    enough = Counter(r[0] for r in rows)
    rows = [r for r in rows if enough[r[0]] >= least]
    model = Model([r[1] for r in rows], [r[0] for r in rows])
    # a label whose own texts are told to be of other languages is no language
    own = Counter(k for k, t in rows if model.decode(t)[0] == k)
    kept = [r for r in rows if 2 * own[r[0]] >= enough[r[0]]]
    return model if len(kept) == len(rows) else Model([r[1] for r in kept], [r[0] for r in kept])


def languages(pages: DataFrame, model: Model, clear: float = CLEAR) -> DataFrame:
    """(record_table, record_id, item, lang, confidence, ambiguous, label): a row for each page with text (item -1) and each paragraph that has a language.

    pages: (record_table, record_id, source_lang, texts, types); types may be null. Illustrations, tables and page
    numbers are left out, as are paragraphs too short to tell. The page's language is that of most of its paragraphs (of a
    tie the one with more letters); only clear paragraphs are told to deviate, others are ambiguous and take the page's language. A page is ambiguous
    if no language has more than half of its votes or its confidence is not clear.
    Null, empty and blank texts have none; a page without text has no row. Repeated pages count once.
    """
    said = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = said.value.decode
        for b in batches:
            rows = []
            for name, key, label, texts, types in zip(b["record_table"], b["record_id"], b["label"], b["texts"], b["types"]):
                kinds = types if types is not None else ()
                told = []
                for i, t in enumerate(texts if texts is not None else ()):
                    if t and not (i < len(kinds) and kinds[i] in NO_TEXT):
                        lang, sure = decode(t)
                        if lang:
                            told.append((i, lang, sure, len(t)))
                if not told:
                    continue
                votes: Counter = Counter()
                for _, lang, sure, n in told:
                    votes[lang] += (1 if sure >= clear else 0.5) + min(n, 100_000) * 1e-7
                page = max(votes.items(), key=lambda v: (v[1], v[0]))[0]
                sure_of = float(np.mean([s if k == page else 1 - s for _, k, s, _ in told]))
                rows.append((name, key, -1, page, sure_of, 2 * votes[page] <= votes.total() or sure_of < 0.5, label))
                rows += [(name, key, i, lang if sure >= clear else page, sure, sure < clear, label) for i, lang, sure, _ in told]
            yield pd.DataFrame(rows, columns=["record_table", "record_id", "item", "lang", "confidence", "ambiguous", "label"])

    p = pages.where("record_id is not null").select("record_table", "record_id", label_code(F.col("source_lang")).alias("label"), "texts", "types")
    return p.mapInPandas(run, "record_table string, record_id long, item int, lang string, confidence double, ambiguous boolean, label string")


def p6_languages(spark: SparkSession, root: str) -> DataFrame:
    found = languages(spread(texts_of(spark, root)), fit(texts_of(spark, root)))
    return found.select("record_table", "record_id", "item", "lang", F.round("confidence", 4).alias("confidence"), "ambiguous").distinct()


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    found = languages(spread(texts_of(spark, root)), fit(texts_of(spark, root)))
    page = F.max(F.when(F.col("item") == -1, F.struct("lang", "label"))).over(W.partitionBy("record_table", "record_id"))
    found = found.select("record_table", "record_id", "item", "lang", "label").distinct().withColumn("page", page)
    wrong = (F.col("item") == -1) & ~F.col("label").eqNullSafe(F.col("lang"))
    strange = (F.col("item") >= 0) & (F.col("lang") != F.col("page.lang"))
    return found.where(wrong | strange).select("record_table", "record_id", "item", "lang").distinct()


QUERIES = {"p6_found": p6_found, "p6_languages": p6_languages}
SQL: dict[str, str] = {}
