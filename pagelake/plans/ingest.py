"""Queries on pages, blocks, segments and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import ids
from pagelake.functions.canon import STOP_WORDS, detect_language, escape_xml
from pagelake.operators import corpus, quality, render
from pagelake.sources.tables import spread, table

#: The day that parts the history from the pages found now.
SINCE = "2023-01-01"


def _pages(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """page_extractions with repeated rows as one."""
    return table(spark, root, "page_extractions", "extraction_id", *columns).dropDuplicates(["extraction_id"])


def _blocks(spark: SparkSession, root: str, *keep: str, wide: bool = False) -> DataFrame:
    """The blocks of all pages; wide: on all cores, for queries that take their words apart."""
    p = table(spark, root, "page_extractions", "extraction_id", "blocks", *keep)
    return corpus.blocks(corpus.once(spread(p) if wide else p, "extraction_id"), "extraction_id", *keep)


def page_identity(spark: SparkSession, root: str) -> DataFrame:
    return _pages(spark, root, "sha256").select("extraction_id", ids.page_id(F.col("sha256")).alias("content_page_id"))


def placement_dedup(spark: SparkSession, root: str) -> DataFrame:
    p = _pages(spark, root, "sha256", "image_path")
    return p.groupBy("sha256").agg(F.min("extraction_id").alias("first_extraction"), F.count("*").alias("placements"), F.min("image_path").alias("first_path"))


def book_identity(spark: SparkSession, root: str) -> DataFrame:
    return _pages(spark, root, "book_id", "page_id").groupBy("book_id").agg(ids.book_id(F.collect_set("page_id")).alias("content_book_id"), F.countDistinct("page_id").alias("pages"))


def history_reconcile(spark: SparkSession, root: str) -> DataFrame:
    p = _pages(spark, root, "sha256", "page_id", "extracted_at")
    now, before = (p.where(F.col("extracted_at") >= SINCE), p.where(F.col("extracted_at") < SINCE))
    return corpus.reconcile(now.select("extraction_id", "sha256"), before, "sha256", "page_id").select("extraction_id", "status", "known_id")


def missing_pages(spark: SparkSession, root: str) -> DataFrame:
    p = _pages(spark, root, "page_id", "extracted_at")
    now, before = (p.where(F.col("extracted_at") >= SINCE), p.where(F.col("extracted_at") < SINCE))
    return corpus.missing(before.select("page_id").distinct(), now, "page_id")


def root_segments(spark: SparkSession, root: str) -> DataFrame:
    b = _blocks(spark, root)
    anchor = ids.anchor(F.col("type"), F.col("reading_order") + 1, F.col("text"))
    return corpus.segments(b, "extraction_id", anchor).select("extraction_id", "anchor", "kind", "reading_order", "placements")


def page_text(spark: SparkSession, root: str) -> DataFrame:
    return corpus.page_texts(_blocks(spark, root), "extraction_id").select("extraction_id", F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("chars"))


def language_check(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents", "doc_id", "lang", "text")
    d = d.select("lang", detect_language(F.col("text")).alias("detected"))
    return d.groupBy("lang", "detected").agg(F.count("*").alias("documents"))


def corpus_report(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents", "lang", "source", "text").select("source", "lang", detect_language(F.col("text")).alias("found"), F.coalesce(F.trim("text") != "", F.lit(False)).alias("full"))
    return quality.confusion(d, "source", F.coalesce(F.col("lang").isin("en", "fr", "es", "de", "ja", "zh", "ko"), F.lit(False)), F.coalesce(F.col("found") == F.col("lang"), F.lit(False)))


def block_faults(spark: SparkSession, root: str) -> DataFrame:
    return quality.block_schema(_blocks(spark, root), "extraction_id")


def id_correspondence(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "translated_blocks", "translated_id", "extraction_id", "block_id").dropDuplicates(["translated_id"])
    b = _blocks(spark, root).join(t.select("extraction_id").distinct(), "extraction_id", "left_semi")
    return quality.correspondence(b, t, ["extraction_id", "block_id"])


def neighbour_context(spark: SparkSession, root: str) -> DataFrame:
    b = _blocks(spark, root, "book_id", "page_number")
    usable = F.coalesce((F.col("type") != "illustration") & (F.trim("text") != ""), F.lit(False))
    n = corpus.neighbours(b, "book_id", ["page_number", "extraction_id", "item"], F.col("text"), usable)
    return n.select("extraction_id", "item", F.sha2("previous", 256).alias("previous_hash"), F.sha2("following", 256).alias("following_hash"))


def page_boundaries(spark: SparkSession, root: str) -> DataFrame:
    b = _blocks(spark, root, "book_id", "page_number").where("text is not null")
    return corpus.boundaries(b, "book_id", "page_number").select("book_id", "page_number", *[F.sha2(c, 256).alias(c) for c in ("head", "tail", "previous_tail", "next_head")])


def ordered_languages(spark: SparkSession, root: str) -> DataFrame:
    p = _pages(spark, root, "book_id", "page_number", "source_lang")
    return corpus.first_seen(p, "book_id", "source_lang", F.struct("page_number", "extraction_id"))


def render_pages(spark: SparkSession, root: str) -> DataFrame:
    x = render.xhtml(_blocks(spark, root, "source_lang"), ["extraction_id"], "source_lang")
    return x.select("extraction_id", F.sha2("body", 256).alias("body_hash"), F.length("body").cast("long").alias("chars"))


def content_invariants(spark: SparkSession, root: str) -> DataFrame:
    """Blocks with text per page and type, and how many pages have none."""
    b = _blocks(spark, root)
    return b.groupBy("type").agg(F.countDistinct("extraction_id").alias("pages"), F.count("*").alias("blocks"), F.count_if(F.coalesce(F.trim("text") == "", F.lit(True))).alias("blank"), F.sum(F.length(escape_xml(F.col("text")))).alias("escaped_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        page_identity, placement_dedup, book_identity, history_reconcile, missing_pages, root_segments, page_text, language_check, corpus_report, block_faults,
        id_correspondence, neighbour_context, page_boundaries, ordered_languages, render_pages, content_invariants,
    )
}

_P = "p as (select distinct on (extraction_id) * from page_extractions)"
_B = f"{_P}, b as (select extraction_id, book_id, page_number, source_lang, (i - 1)::int as item, x.id as block_id, x.type as type, x.text as text, x.reading_order as reading_order from (select *, generate_subscripts(blocks, 1) as i, unnest(blocks) as x from p))"
_ESC = "replace(replace(replace(replace(replace(regexp_replace(text, '[\\x{0}-\\x{8}\\x{b}\\x{c}\\x{e}-\\x{1f}\\x{fffe}\\x{ffff}]', chr(65533), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


def _detect(text: str) -> str:
    n = {c: f"len(list_filter(w, lambda z: z in ({', '.join(repr(x) for x in v)})))" for c, v in STOP_WORDS.items()}
    most = f"greatest({', '.join(n.values())})"
    pick = " ".join(f"when {q} = m then '{c}'" for c, q in n.items())
    return f"""case when regexp_matches({text}, '[\\x{{3040}}-\\x{{30ff}}]') then 'ja' when regexp_matches({text}, '[\\x{{ac00}}-\\x{{d7af}}]') then 'ko' when regexp_matches({text}, '[\\x{{4e00}}-\\x{{9fff}}]') then 'zh'
  when trim({text}) = '' then null else (select case when m > 0 then case {pick} end end from (select w, {most} as m from (select regexp_extract_all(lower({text}), '[a-zA-ZÀ-ÿ]+') as w))) end"""


SQL = {
    "page_identity": f"with {_P} select extraction_id, sha256('page-v1'::blob || '\\x00'::blob || unhex(sha256)) as content_page_id from p",
    "placement_dedup": f"with {_P} select sha256, min(extraction_id) as first_extraction, count(*) as placements, min(image_path) as first_path from p group by 1",
    "book_identity": f"""with {_P} select book_id, sha256('book-v1'::blob || '\\x00'::blob || ('[' || string_agg(distinct '"' || page_id || '"', ',' order by '"' || page_id || '"') || ']')::blob) as content_book_id, count(distinct page_id) as pages from p group by 1""",
    "history_reconcile": f"""with {_P}, h as (select sha256, count(distinct page_id) as n, min(page_id) as k from p where extracted_at < '{SINCE}' and sha256 is not null group by 1)
select extraction_id, case when coalesce(n, 0) = 0 then 'new' when n = 1 then 'reused' else 'ambiguous' end as status, case when n = 1 then k end as known_id from p left join h using (sha256) where extracted_at >= '{SINCE}'""",
    "missing_pages": f"with {_P} select distinct page_id from p where extracted_at < '{SINCE}' and page_id not in (select page_id from p where extracted_at >= '{SINCE}')",
    "root_segments": f"""with {_B}, s as (select extraction_id, type as kind, text, reading_order + 1 as reading_order, sha256('anchor-v1' || chr(0) || '[' || to_json(type)::varchar || ',' || (reading_order + 1)::varchar || ',' || to_json(text)::varchar || ',{{}}]') as anchor from b where type is distinct from 'illustration'),
o as (select extraction_id, reading_order, count(distinct anchor) as n, bool_or(kind is null or kind not in ('heading','paragraph','caption','footnote','table','list_item','pull_quote','illustration','quote','page_number') or text is null or trim(text) = '' or reading_order < 1) as bad from s group by 1, 2),
g as (select extraction_id, bool_or(bad or n > 1) as bad from o group by 1)
select extraction_id, anchor, min(kind) as kind, min(reading_order)::int as reading_order, count(*) as placements from s where extraction_id in (select extraction_id from g where not bad) group by 1, 2
union all select extraction_id, null, 'diagnostic', 1, 1 from g where bad""",
    "page_text": f"with {_B}, t as (select extraction_id, string_agg(text, chr(10) || chr(10) order by reading_order, item) as text from b where type is distinct from 'illustration' and text is not null group by 1) select extraction_id, sha256(text) as text_hash, length(text) as chars from t",
    "language_check": f"select lang, {_detect('text')} as detected, count(*) as documents from documents group by 1, 2",
    "corpus_report": f"""with d as (select source, coalesce(lang in ('en', 'fr', 'es', 'de', 'ja', 'zh', 'ko'), false) as e, coalesce(({_detect('text')}) = lang, false) as a from documents)
select source, count(*) filter (e and a) as "both", count(*) filter (e and not a) as only_expected, count(*) filter (not e and a) as only_actual, count(*) filter (not e and not a) as neither from d group by 1""",
    "block_faults": f"""with {_B}, f as (
select extraction_id, 'empty_id' as rule, 1 as n from b where block_id is null or trim(block_id) = ''
union all select extraction_id, 'unsupported_type', 1 from b where type is null or type not in ('heading','paragraph','caption','footnote','table','list_item','pull_quote','illustration','quote','page_number')
union all select extraction_id, 'bad_order', 1 from b where reading_order is null or reading_order < 0
union all select extraction_id, 'empty_text', 1 from b where text is null or trim(text) = ''
union all select extraction_id, 'duplicate_id', count(*) - 1 from b where trim(block_id) <> '' group by extraction_id, block_id
union all select extraction_id, 'duplicate_order', count(*) - 1 from b where reading_order >= 0 group by extraction_id, reading_order)
select extraction_id, rule, sum(n)::bigint as n from f group by 1, 2 having sum(n) > 0""",
    "id_correspondence": f"""with {_B}, t as (select distinct on (translated_id) * from translated_blocks), s as (select extraction_id, block_id, count(*) as s from b where extraction_id in (select extraction_id from t) group by 1, 2),
u as (select extraction_id, block_id, count(*) as t from t group by 1, 2)
select * from (select extraction_id, block_id, case when t is null then 'missing' when s is null then 'extra' when t > 1 then 'duplicate' end as status from s full join u using (extraction_id, block_id)) where status is not null""",
    "neighbour_context": f"""with {_B}, n as (select extraction_id, item, lag(case when coalesce(type <> 'illustration' and trim(text) <> '', false) then text end) over w as a, lead(case when coalesce(type <> 'illustration' and trim(text) <> '', false) then text end) over w as c
from b window w as (partition by book_id order by page_number, extraction_id, item)) select extraction_id, item, sha256(a) as previous_hash, sha256(c) as following_hash from n""",
    "page_boundaries": f"""with {_B}, g as (select book_id, page_number, arg_min(text, (reading_order, item)) as h, arg_max(text, (reading_order, item)) as t from b where text is not null group by 1, 2)
select book_id, page_number, sha256(h) as head, sha256(t) as tail, sha256(lag(t) over w) as previous_tail, sha256(lead(h) over w) as next_head from g window w as (partition by book_id order by page_number)""",
    "ordered_languages": f"""with {_P}, f as (select book_id, source_lang, min((page_number, extraction_id)) as seen from p where source_lang is not null group by 1, 2)
select book_id, source_lang, row_number() over (partition by book_id order by seen, source_lang)::int as rank from f""",
    "render_pages": f"""with {_B}, t as (select extraction_id, min(source_lang) as l, string_agg('<' || case when type = 'heading' then 'h2' when type in ('quote', 'pull_quote') then 'blockquote' else 'p' end || '>' || {_ESC} || '</' || case when type = 'heading' then 'h2' when type in ('quote', 'pull_quote') then 'blockquote' else 'p' end || '>', '' order by reading_order, item) as x
from b where text is not null and type is distinct from 'illustration' group by 1), y as (select extraction_id, '<body lang="' || {_ESC.replace("text, '[", "coalesce(l, 'und'), '[")} || '">' || x || '</body>' as body from t)
select extraction_id, sha256(body) as body_hash, length(body) as chars from y""",
    "content_invariants": f"with {_B} select type, count(distinct extraction_id) as pages, count(*) as blocks, count(*) filter (coalesce(trim(text) = '', true)) as blank, sum(length({_ESC}))::bigint as escaped_chars from b group by 1",
}
