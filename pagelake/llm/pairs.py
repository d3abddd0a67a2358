"""Defective source-response pairs: empty, refusal, copy, wrong language, truncated.

One pass over the pairs measures each: how small the response gets under zstandard with its source as the dictionary (a copy
nearly vanishes); whether it opens with words of refusal and of the task, and the source does not; its language by the
output-code model; how it ends, by a terminal-context model fitted on ends of responses and on responses cut at random. The
usual length of a response for each script and target language is the median over all
pairs; a response far below it, or somewhat below it with an open end or sentences missing, is truncated.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.language import Model, fit, texts_of
from pagelake.session import cut
from pagelake.sources.tables import spread, table

#: Parameters: compressed size under the source's dictionary against alone below which a response is a copy; natural logarithms of how far
#: off the usual length a response is cut if it ends in a mark of omission, its end is open, or it lacks sentences, and in any case; what such a mark adds to the odds; responses
#: that the model of ends is fitted on, buckets of its features, its steps and ridge.
COPY, NEARLY, SHORT, LACKING, SHORTER, SURE, ENDS, BUCKETS, STEPS, RIDGE = 0.45, 0.1, -0.3, -0.36, -0.55, 4.0, 2_000, 4_096, 300, 0.002
#: Words of refusal by language.
REFUSAL = re.compile(
    r"\b(?:can(?:'|’)?t|cannot|can not|unable|not able|won(?:'|’)t be able|must decline|decline to|not possible|refuse to|will not)\b"
    r"|\bas an ai\b|language model"
    r"|ne (?:peux|puis|suis|pouvons) pas|impossible de|désolée?\b"
    r"|kann (?:\w+ ){0,5}nicht|nicht möglich|leider nicht|tut mir leid|bin nicht in der lage"
    r"|no (?:puedo|podemos|me es posible|es posible|soy capaz)|lo siento|lamento"
    r"|non (?:posso|possiamo|sono in grado|mi è possibile|è possibile)|mi dispiace"
    r"|não (?:posso|podemos|consigo|me é possível|é possível|sou capaz)|desculpe|sinto muito"
    r"|не могу|не можем|невозможно|не в состоянии|не удаётся|извините|к сожалению|простите"
    r"|できません|できかねます|お応えできず|申し訳|ご遠慮"
    r"|无法|不能|抱歉|对不起|無法"
    r"|لا أستطيع|لا يمكنني|لا يمكن|آسف|أعتذر|عذرا|تعذر"
    r"|नहीं कर (?:सकत|पा)|असमर्थ|क्षमा|खेद|माफ़"
    r"|చేయలేను|చేయలేము|సాధ్యం కాదు|క్షమించ|అనువదించలేను",
    re.IGNORECASE,
)
#: Words of the task, one of which a refusal names.
TASK = re.compile(
    r"translat|render|\b(?:text|passage|request|content|page|help|assist|comply|ai)\b|language model"
    r"|tradu[cicsz]|texte|\bdemande|contenu|\baider|répondre"
    r"|übersetz|\btext|anfrage|inhalt|helfen|bearbeiten"
    r"|\btexto|pasaje|solicitud|contenido|ayudar"
    r"|tradurre|\btesto|\bbrano|richiesta|contenuto|aiutar"
    r"|trecho|pedido|solicitação|conteúdo|ajudar"
    r"|перевод|перевест|перевед|текст|отрыв|запрос|содержим|помочь"
    r"|翻訳|文章|テキスト|依頼|要求|お応え|内容|手伝"
    r"|翻译|翻譯|文本|文字|请求|請求|内容|帮"
    r"|ترجم|النص|طلب|محتوى|مساعد"
    r"|अनुवाद|पाठ|अनुरोध|सामग्री|मदद|सहायता"
    r"|అనువ|వచన|అభ్యర్థన|సహాయ|పాఠ",
    re.IGNORECASE,
)
#: What stands at the end of a text that was cut.
OMISSIONS = ("…", "...", " […]", " [", " (", " -", ",", ";")
#: Closing marks of sentences and of quotations.
CLOSE, QUOTES = ".!?。！？؟।॥", "\"'”’»)）」』]*_ \n\t ​"
_SENTENCE = re.compile(r"(?=[.!?؟。！？।॥])(?:(?:(?<=[^\W\d_]{4})|(?<=[ऀ-෿]{2})|(?<=[)\d]))[.!?؟]+(?=[\s\"'”’»)]|$)|[。！？।॥])")
_LABEL = re.compile(r"^[\s>*_#\"'«“„]*(?:[^\W\d_]{3,20}\s?[:：]\s*)?")
_SCRIPTS = {"Cyrl": re.compile(r"[Ѐ-ӿ]"), "Arab": re.compile(r"[؀-ۿ]"), "Deva": re.compile(r"[ऀ-ॿ]"), "Telu": re.compile(r"[ఀ-౿]"), "Wide": re.compile(r"[぀-鿿]")}
_OTHER = re.compile(r"[Ѐ-ӿ؀-ۿऀ-ॿఀ-౿぀-鿿]")


def letters_of(text: str) -> int:
    return sum(map(str.isalpha, text))


def script_of(text: str) -> str:
    """Latn, or the script that holds more than a third of the letters (Kana and Han as Wide)."""
    if text.isascii() or not _OTHER.search(text):
        return "Latn"
    n = letters_of(text)
    return next((k for k, p in _SCRIPTS.items() if 3 * len(p.findall(text)) > n), "Latn")


_PLAIN = dict(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
_ALONE = zstandard.ZstdCompressor(**_PLAIN)
#: Bytes that a frame may have beyond its content.
_FRAME = 16


def copied(source: str, response: str) -> float:
    """Compressed size of the response with the source as dictionary, against that without one; 1 where the first alone shows no copy."""
    r, s = " ".join(response.split()).encode(), " ".join(source.split()).encode()
    if len(s) < 8:
        return 1.0
    with_it = len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(s, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **_PLAIN).compress(r))
    # a text alone never gets longer than itself and its frame
    if with_it >= COPY * (len(r) + _FRAME):
        return 1.0
    return with_it / len(_ALONE.compress(r))


def _same(source: str, response: str) -> bool:
    """Whether the response is the source, signs, case and small changes aside."""
    if copied(source, response) < COPY:
        return True
    if len(source) > 400:
        return False
    a, b = ("".join(c for c in x.casefold() if c.isalnum()) for x in (source, response))
    return a == b and any(c.isalpha() for c in a)


def refuses(source: str | None, response: str) -> bool:
    """Whether the response opens with words of refusal and of the task, and does not owe them to its source.

    A source that has such words itself excuses a response at least half as long.
    """
    first = _SENTENCE.split(response[_LABEL.match(response).end() :], 1)[0]
    if not (REFUSAL.search(first) and TASK.search(first)):
        return False
    return not (source and REFUSAL.search(source) and TASK.search(source) and 2 * letters_of(response) >= letters_of(source))


class Ends:
    """A terminal-context model: how much more likely a text was cut where it ends than that it ends there by itself.

    A logistic regression over the last signs, the last words and what is left open, fitted on the ends of ``texts`` and on the same
    texts cut at a random place, half of them with a mark of omission.
    """

    def __init__(self, texts: list[str]):
        rng = random.Random(13)
        rows: list[tuple[list[int], float]] = []
        for t in texts:
            t = t.strip()
            if len(t) < 20:
                continue
            at = rng.randrange(len(t) // 5, len(t) * 9 // 10)
            space = t.rfind(" ", 0, at)
            cut_ = t[: space if space > 0 else at]
            rows += [(self.features(t), 0.0), (self.features(cut_ + (rng.choice(OMISSIONS) if rng.random() < 0.5 else "")), 1.0)]
        self.weights = np.zeros(BUCKETS)
        if rows:
            wide = max(len(f) for f, _ in rows)
            # a row's features, filled up with a bucket of no weight
            x = np.array([f + [BUCKETS] * (wide - len(f)) for f, _ in rows])
            y = np.array([v for _, v in rows])
            w = np.zeros(BUCKETS + 1)
            for _ in range(STEPS):
                off = 1 / (1 + np.exp(-w[x].sum(1))) - y
                w -= 2.0 * (np.bincount(x.ravel(), np.repeat(off, wide), BUCKETS + 1) / len(y) + RIDGE * w)
                w[BUCKETS] = 0
            self.weights = w[:BUCKETS]

    @staticmethod
    def features(text: str) -> list[int]:
        tail = text[-60:].rstrip()
        bare = tail.rstrip(QUOTES)
        kind = lambda c: c if not c.isalnum() else "9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "x"
        words = bare.split()
        last = words[-1].casefold() if words else ""
        end = "".join(map(kind, bare[-2:]))
        open_ = "".join(c for c, d in ("()", "[]", "«»", "“”", "（）") if tail.count(c) > tail.count(d))
        names = ("*", "e" + tail[-1:] if not tail[-1:].isalnum() else "e", "b" + end[-1:], "t" + end, "o" + open_, "w" + last[-12:], "v" + (words[-2].casefold()[-12:] if len(words) > 1 else ""), "l" + str(min(len(last), 4)) + end[-1:])
        return sorted({crc32(n.encode()) % BUCKETS for n in names})

    def score(self, text: str) -> float:
        """Logarithm of the odds that the text was cut."""
        return float(self.weights[self.features(text)].sum())


def measure(model: Model, ends: Ends, source: str | None, response: str | None, due: str | None, context: str | None = None) -> tuple:
    """(certain defect or None, script of the source, logarithm of the lengths' ratio or None, odds that it was cut, sentences missing).

    context is text of the source's page; it tells the language of a source that is too short to have one.
    """
    if not response or not any(c.isalnum() for c in response):
        return "empty", None, None, 0.0, 0
    source = source or ""
    script = script_of(source)
    known = due in model.languages
    # copies first: whatever the language model makes of the response
    if known and source and script == script_of(response) and _same(source, response):
        of = model.decode(source)[0] or (model.decode(context)[0] if context else None)
        if of and of != due:
            return "copy", script, None, 0.0, 0
    if refuses(source, response):
        return "refusal", script, None, 0.0, 0
    letters, of = letters_of(response), letters_of(source)
    ratio = math.log((letters + 1) / (of + 1)) if of >= 8 else None
    lang, _ = model.decode(response)
    if lang and known and lang != due:
        return "wrong_language", script, ratio, 0.0, 0
    # a source that is not closed itself says nothing about an open end
    closed = source.rstrip(QUOTES + "0123456789(（")[-1:] in CLOSE
    odds = ends.score(response)
    marked = odds > 0 and response.rstrip().endswith(tuple(map(str.strip, OMISSIONS)))
    return None, script, ratio, odds + SURE if marked else odds if closed else 0.0, len(_SENTENCE.findall(source)) - len(_SENTENCE.findall(response))


def fit_ends(responses: DataFrame, sample: int = ENDS) -> Ends:
    """The model of ends from at most ``sample`` of (response), by seeded hash; null and blank ones are left out."""
    r = responses.where("trim(response) <> ''").select("response", F.pmod(F.xxhash64("response", F.lit(17)), F.lit(1_000_003)).alias("h"))
    # about twice the sample is looked at, so that no partition sends more than its part
    below = min(1_000_003, 2 * sample * 1_000_003 // max(r.count(), 1) + 1)
    return Ends([x[1] for x in sorted((x.h, x.response) for x in r.where(F.col("h") < below).collect())[:sample]])


def defects(pairs: DataFrame, model: Model, ends: Ends) -> DataFrame:
    """(record_table, record_id, item, defect) for each defective pair of (record_table, record_id, item, source, response, due), with context (text of the source's page) if there is such a column.

    due is the two-letter code of the language due; for one that the model does not know no language is judged and nothing is a copy. A
    response without letter or digit, null included, is 'empty'; a pair whose source has no letters can only be empty
    or a refusal. A pair that occurs several times counts once. No pairs give no rows.
    """
    said = pairs.sparkSession.sparkContext.broadcast((model, ends))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, k, i, due, *measure(*said.value, s, r, due, c)) for t, k, i, s, r, due, c in zip(b["record_table"], b["record_id"], b["item"], b["source"], b["response"], b["due"], b["context"])]
            yield pd.DataFrame(rows, columns=["record_table", "record_id", "item", "due", "defect", "script", "ratio", "odds", "missing"])

    kinds = "record_table string, record_id long, item int, due string, defect string, script string, ratio double, odds double, missing int"
    pairs = pairs if "context" in pairs.columns else pairs.withColumn("context", F.lit(None).cast("string"))
    m = cut(pairs.select("record_table", "record_id", "item", "source", "response", "due", "context").mapInPandas(run, kinds))
    usual = m.where("ratio is not null and defect is null").groupBy("script", "due").agg(F.percentile_approx("ratio", 0.5, 1_000).alias("usual"))
    below, odds = F.col("ratio") - F.col("usual"), F.col("odds")
    cut_off = (below < SHORTER) | (odds > 0) & (below < SHORT) | (F.col("missing") > 0) & (below < LACKING) | (odds > SURE) & (below < NEARLY)
    found = m.join(F.broadcast(usual), ["script", "due"], "left").withColumn("defect", F.coalesce("defect", F.when(cut_off, F.lit("truncated"))))
    return found.where("defect is not null").select("record_table", "record_id", "item", "defect").distinct()


def _context(source: Column, texts: Column) -> Column:
    """The beginning of a page's texts, only for a source that may be too short to have a language."""
    return F.when(F.length(source) < 60, F.substring(F.concat_ws(" ", texts), 1, 400))


def corpus_pairs(spark: SparkSession, root: str) -> DataFrame:
    """The pairs of both tables: blocks with their translations, and the elements of source and target."""
    t = table(spark, root, "translated_blocks", "translated_id", "extraction_id", "block_id", "target_lang", "translated_text")
    p = table(spark, root, "page_extractions", "extraction_id", "blocks")
    texts = p.select("extraction_id", F.col("blocks.text").alias("texts"), F.explode("blocks").alias("b")).select("extraction_id", F.col("b.id").alias("block_id"), F.col("b.text").alias("source"), _context(F.col("b.text"), F.col("texts")).alias("context"))
    a = t.join(texts, ["extraction_id", "block_id"]).select(F.lit("translated_blocks").alias("record_table"), F.col("translated_id").alias("record_id"), F.lit(0).alias("item"), "source", F.col("translated_text").alias("response"), F.col("target_lang").alias("due"), "context")
    c = spread(table(spark, root, "corpus_pages", "page_key", "source", "target"))
    c = c.select("page_key", "target", F.col("source").alias("texts"), F.posexplode("source").alias("item", "source"))
    b = c.select(F.lit("corpus_pages"), "page_key", "item", "source", F.get("target", F.col("item")), F.lit("en"), _context(F.col("source"), F.col("texts")))
    return a.union(b)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "translated_blocks", "translated_text").select(F.col("translated_text").alias("response"))
    c = table(spark, root, "corpus_pages", "target").select(F.explode("target").alias("response"))
    return defects(corpus_pairs(spark, root), fit(texts_of(spark, root)), fit_ends(t.union(c)))


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
