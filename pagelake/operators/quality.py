"""Data-quality rules: each gives findings, none stops a job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions.canon import BLOCK_TYPES, blank, detect_language
from pagelake.session import cut

FINDING = "subject string, rule string, severity string, detail string"


def block_schema(rows: DataFrame, page: str) -> DataFrame:
    """(page, rule, n): block faults by rule: empty id, duplicate id, unsupported type, bad or duplicate reading order."""
    per_id = rows.groupBy(page, "block_id").agg(F.count("*").alias("n")).where("block_id is not null and trim(block_id) <> ''").select(page, F.lit("duplicate_id").alias("rule"), (F.col("n") - 1).alias("n"))
    per_order = rows.where("reading_order >= 0").groupBy(page, "reading_order").agg(F.count("*").alias("n")).select(page, F.lit("duplicate_order").alias("rule"), (F.col("n") - 1).alias("n"))
    flags = F.array(
        F.struct(F.lit("empty_id").alias("rule"), (F.col("block_id").isNull() | (F.trim("block_id") == "")).alias("bad")),
        F.struct(F.lit("unsupported_type").alias("rule"), (F.col("type").isNull() | ~F.col("type").isin(*BLOCK_TYPES)).alias("bad")),
        F.struct(F.lit("bad_order").alias("rule"), (F.col("reading_order").isNull() | (F.col("reading_order") < 0)).alias("bad")),
        F.struct(F.lit("empty_text").alias("rule"), (F.col("text").isNull() | (F.trim("text") == "")).alias("bad")),
    )
    single = rows.select(page, F.explode(flags).alias("f")).where("f.bad").select(page, F.col("f.rule").alias("rule"), F.lit(1).cast("long").alias("n"))
    return single.unionByName(per_id).unionByName(per_order).groupBy(page, "rule").agg(F.sum("n").alias("n")).where("n > 0")


def correspondence(source: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """(on, status): missing in the target, extra in it, or duplicate there; a full outer join of the id counts."""
    s = source.groupBy(*on).agg(F.count("*").alias("s"))
    t = target.groupBy(*on).agg(F.count("*").alias("t"))
    status = F.when(F.col("t").isNull(), "missing").when(F.col("s").isNull(), "extra").when(F.col("t") > 1, "duplicate")
    return s.join(t, on, "full_outer").withColumn("status", status).where("status is not null").select(*on, "status")


def confusion(rows: DataFrame, stage: str, expected: Column, actual: Column) -> DataFrame:
    """(stage, both, only_expected, only_actual, neither): how far a rule does what is expected of it."""
    n = lambda c: F.count_if(c)
    return rows.groupBy(stage).agg(n(expected & actual).alias("both"), n(expected & ~actual).alias("only_expected"), n(~expected & actual).alias("only_actual"), n(~expected & ~actual).alias("neither"))


def category(kind: Column, severity: Column) -> Column:
    """Report group of a finding: review requests, failures, uncertainty, else content."""
    return F.when(kind == "review_request", "review").when(severity == "error", "failure").when(severity == "warning", "uncertainty").otherwise("content")


def run_rules(spark: SparkSession, rules: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """All findings of the rules; a rule that fails is itself a finding, and the others go on."""
    out = spark.createDataFrame([], FINDING)
    for name, rule in rules.items():
        try:
            got = rule().select(*[F.col(c).cast("string").alias(c) for c in ("subject", "rule", "severity", "detail")])
            # written out: a rule runs once, and a lost executor does not run it again
            got = cut(got)
        except Exception as e:  # noqa: BLE001 - a broken rule is a finding
            got = spark.createDataFrame([(None, name, "error", f"{type(e).__name__}: {str(e)[:500]}")], FINDING)
        out = out.unionByName(got)
    return out


#: Categories of signals, the first that has one of them counts.
SIGNALS = {
    "actionable_ambiguity": ["ambiguity", "ambiguous", "mapping_ambiguity", "source_sense_ambiguity", "concept_ambiguity"],
    "conflict": ["conflict", "reconciliation_conflict", "correction_conflict"],
    "failure": ["failure", "exception", "model_failure", "execution_failure"],
    "fallback": ["fallback", "parser_fallback", "model_fallback", "diagnostic_placeholder", "retry_exhaustion"],
    "validation": ["validation", "validation_error", "malformed_output", "invalid_response"],
    "correction_impact": ["correction_impact", "correction", "dirty_set"],
}


def actionable(signals: Column) -> Column:
    """The category of an array of signals, or null if none asks for an action."""
    hit = [F.when(F.arrays_overlap(signals, F.array(*[F.lit(x) for x in names])), k) for k, names in SIGNALS.items()]
    return F.coalesce(*hit)


def page_stages(blocks: DataFrame, translated: DataFrame, mentions: DataFrame, page: str) -> DataFrame:
    """(page, stage, errors): the six named stages of a page's check, all of them for each page that has a translation.

    blocks: (page, block_id, type, text, reading_order, illustrations), translated: (page, block_id, target_lang, translated_text),
    mentions: (page, block_id, found): whether a term's target stands in the translation of its block.
    """
    pages = translated.select(page).distinct()
    b = blocks.join(pages, page, "left_semi")
    schema = block_schema(b, page).where("rule <> 'empty_text'").groupBy(page).agg(F.sum("n").alias("block_schema"))
    empty = b.groupBy(page).agg(F.count_if(blank(F.col("text"))).alias("_s"), F.count_if(F.col("type") == "illustration").alias("_i"), F.max("illustrations").alias("_n"))
    t = translated.groupBy(page).agg(F.count_if(blank(F.col("translated_text"))).alias("_t"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "translated_text"))), lambda x: F.coalesce(x["translated_text"], F.lit(""))), "\n").alias("_x"), F.min("target_lang").alias("_l"))
    found = detect_language(F.col("_x"))
    ids = correspondence(b, translated, [page, "block_id"]).groupBy(page).agg(F.count("*").alias("block_id_correspondence"))
    terms = mentions.groupBy(page).agg(F.count_if(~F.col("found")).alias("glossary_consistency"))
    j = pages
    for part in (schema, empty, t, ids, terms):
        j = j.join(part, page, "left")
    none = F.lit(0).cast("long")
    counts = {
        "block_schema": F.col("block_schema"), "non_empty_text": F.coalesce("_s", none) + F.coalesce("_t", none), "translation_language": (found != F.lower("_l")).cast("long"),
        "illustration_count": (F.coalesce("_n", none) != F.coalesce("_i", none)).cast("long"), "block_id_correspondence": F.col("block_id_correspondence"), "glossary_consistency": F.col("glossary_consistency"),
    }
    stages = F.array(*[F.struct(F.lit(k).alias("stage"), F.coalesce(c, none).alias("errors")) for k, c in counts.items()])
    return j.select(page, F.explode(stages).alias("x")).select(page, "x.stage", "x.errors")


def effective_rules(segments: DataFrame, page: str, segment: str, text: str, expected: str) -> dict[str, Callable[[], DataFrame]]:
    """The shipped rules over effective segments, for :func:`run_rules`: structure, non-empty text, language."""
    sub = F.concat_ws("/", page, segment)

    def found(df: DataFrame, rule: str, detail: Column) -> DataFrame:
        return df.select(F.col("_subject").alias("subject"), F.lit(rule).alias("rule"), F.lit("warning").alias("severity"), detail.alias("detail"))

    s = segments.withColumn("_subject", sub)
    said = detect_language(F.col(text))
    return {
        "effective_structure": lambda: found(s.groupBy("_subject").agg(F.count("*").alias("n")).where("n > 1"), "effective_structure", F.lit("the segment stands twice")),
        "non_empty_text": lambda: found(s.where(blank(F.col(text))), "non_empty_text", F.lit("the text is empty")),
        "language": lambda: found(s.withColumn("_said", said).where((F.col(expected) != "und") & (F.col("_said") != F.lower(expected))), "language", F.concat(F.lit("appears to be "), F.col("_said"), F.lit(", expected "), F.col(expected))),
    }


def sealed_invariants(segments: DataFrame, page: str, segment: str, lang: str, mode: str) -> DataFrame:
    """One row (segments, in_several_pages, languages, modes, sealed): every segment in exactly one page, one target language, no mix of modes."""
    per = segments.groupBy(segment).agg(F.countDistinct(page).alias("n"))
    a = per.agg(F.count("*").alias("segments"), F.count_if(F.col("n") > 1).alias("in_several_pages"))
    b = segments.where(F.col(mode) != "diagnostic").agg(F.countDistinct(lang).alias("languages"), F.countDistinct(mode).alias("modes"))
    return a.join(F.broadcast(b)).withColumn("sealed", (F.col("in_several_pages") == 0) & (F.col("languages") <= 1) & (F.col("modes") <= 1))
