"""Queries on canonical forms, projections, checks, selections and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import canon, ids
from pagelake.operators import corpus, corrections, effective, graph, memo, quality, responses, selection, terms
from pagelake.operators.hierarchy import edges_of
from pagelake.plans.ingest import _B, _P, SINCE, _blocks, _detect, _pages
from pagelake.plans.terminology import _C, _E, _G, _IMPACT, _M, _W, _candidates, _groups, _impacts, _mentions
from pagelake.sources.tables import table


def _translations(spark: SparkSession, root: str) -> DataFrame:
    return corpus.once(table(spark, root, "translated_blocks", "translated_id", "extraction_id", "block_id", "book_id", "target_lang", "translated_text", "loaded_at"), "translated_id")


def _corrections(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return table(spark, root, "correction_records", "correction_id", *columns).dropDuplicates(["correction_id"])


def _links(spark: SparkSession, root: str) -> DataFrame:
    return edges_of(table(spark, root, "record_dependencies", "record_id", "dependency_id"), "record_id", "dependency_id", "d").select("parent", "child")


# --- canonical forms and identities -----------------------------------------------------------------------------------------


def text_nfc(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents", "doc_id", "text")
    return d.select("doc_id", F.sha2(canon.nfc("text"), 256).alias("text_hash"))


def canonical_scopes(spark: SparkSession, root: str) -> DataFrame:
    c = _corrections(spark, root, "scope", "base")
    return c.select("correction_id", canon.canonical_json("scope").alias("scope"), canon.canonical_json("base").alias("base"))


def history_faults(spark: SparkSession, root: str) -> DataFrame:
    """Per book: pages of the history, ids that are not those of their bytes, ids that stand for several contents, contents with several ids."""
    p = _pages(spark, root, "book_id", "page_id", "sha256").where("page_id is not null")
    odd = F.count_if(ids.page_id(F.col("sha256")) != F.col("page_id")).alias("other_id")
    a = p.groupBy("book_id").agg(F.count("*").alias("pages"), odd)
    per_id = p.groupBy("book_id", "page_id").agg(F.countDistinct("sha256").alias("n")).groupBy("book_id").agg(F.count_if(F.col("n") > 1).alias("several_contents"))
    per_hash = p.groupBy("book_id", "sha256").agg(F.countDistinct("page_id").alias("n")).groupBy("book_id").agg(F.count_if(F.col("n") > 1).alias("several_ids"))
    return a.join(per_id, "book_id").join(per_hash, "book_id")


def extraction_keys(spark: SparkSession, root: str) -> DataFrame:
    p = _pages(spark, root, "sha256", "model")
    key = ids.extraction_key(F.lit("page-1"), F.lit("Read the page."), F.lit("reader-1"), F.col("model"), F.col("sha256"), F.lit("low"))
    return p.select("extraction_id", key.alias("semantic_key"))


def membership_keys(spark: SparkSession, root: str) -> DataFrame:
    c = _candidates(spark, root)
    key = ids.membership_key(F.col("candidate_key"), F.coalesce("occurrence_ids", F.array()), F.coalesce("declared_block_ids", F.array()), F.lit("rules-1"))
    return c.where("candidate_key is not null").select("candidate_id", key.alias("semantic_key"))


def prompt_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """A translation prompt for each block, as JSON context with its neighbours' hashes, and its fingerprint."""
    b = _blocks(spark, root, "source_lang").where("text is not null and block_id is not null and type is not null")
    prompt = ids.json_object(block_id=ids.quoted(F.col("block_id")), kind=ids.quoted(F.col("type")), text=ids.quoted(F.col("text")))
    return b.select("extraction_id", "item", ids.fingerprint(F.concat(F.lit("Translate the block.\n"), prompt)).alias("fingerprint"))


# --- projections --------------------------------------------------------------------------------------------------------------


def native_projection(spark: SparkSession, root: str) -> DataFrame:
    e = effective.effective_segments(_blocks(spark, root, "source_lang"), None, [], "source_lang")
    return e.select("extraction_id", "item", F.sha2("effective_text", 256).alias("text_hash"), "render_lang", "mode")


def translated_projection(spark: SparkSession, root: str) -> DataFrame:
    t = _translations(spark, root).select("extraction_id", "block_id", "translated_text", "target_lang")
    e = effective.effective_segments(_blocks(spark, root, "source_lang"), t, ["extraction_id", "block_id"], "source_lang")
    return e.select("extraction_id", "item", F.sha2("effective_text", 256).alias("text_hash"), "render_lang", "mode")


def segment_provenance(spark: SparkSession, root: str) -> DataFrame:
    """Where each segment is from: its page's bytes, the translations of its block and the terms mentioned in it."""
    on = ["extraction_id", "block_id"]
    b = _blocks(spark, root, "page_id", "sha256").select("extraction_id", "item", "block_id", "page_id", "sha256")
    t = _translations(spark, root).groupBy(*on).agg(F.array_join(F.array_sort(F.collect_set(F.col("translated_id").cast("string"))), ",").alias("translations"))
    m = _mentions(spark, root).groupBy(*on).agg(F.count("*").alias("mentions"))
    return b.join(t, on, "left").join(m, on, "left").select("extraction_id", "item", "page_id", "sha256", F.coalesce("translations", F.lit("")).alias("translations"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


def safe_paths(spark: SparkSession, root: str) -> DataFrame:
    return _pages(spark, root, "image_path").select("extraction_id", effective.safe_path(F.col("image_path")).alias("safe"))


def occurrence_spans(spark: SparkSession, root: str) -> DataFrame:
    """Each mention in the order of its block with its span: repeated terms take successive places."""
    on = ["extraction_id", "block_id"]
    m = _mentions(spark, root).where("term <> ''").groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("mention_id", "term"))).alias("m"))
    b = _blocks(spark, root).where("text is not null").groupBy(*on).agg(F.min("text").alias("text"))
    j = m.join(b, on).withColumn("spans", effective.target_spans(F.col("text"), F.col("m.term")))
    x = j.select(F.explode(F.arrays_zip(F.col("m.mention_id").alias("i"), "spans")).alias("x"))
    return x.select(F.col("x.i").alias("mention_id"), F.col("x.spans.start").alias("start"), F.col("x.spans.end").alias("end"))


def variant_paths(spark: SparkSession, root: str) -> DataFrame:
    p = _pages(spark, root, "book_id", "page_number", "image_path").where("page_number is not null and image_path is not null and book_id is not null")
    v = effective.variant_names(p.withColumn("page", F.col("page_number").cast("string")), ["book_id", "page"], "image_path")
    return v.select("book_id", "page", "image_path", "name")


def mention_translations(spark: SparkSession, root: str) -> DataFrame:
    """Mentions with the translations of their block, and whether one of the translations has one of the term's forms."""
    m = _mentions(spark, root).where("term is not null").select("mention_id", "extraction_id", "block_id", "book_id", F.lower("term").alias("normalized_term"))
    t = _translations(spark, root).where("translated_text is not null").select("extraction_id", "block_id", F.lower("translated_text").alias("t"))
    g = _groups(spark, root).groupBy("book_id", "normalized_term").agg(F.array_distinct(F.flatten(F.collect_list("forms"))).alias("forms"))
    j = m.join(t, ["extraction_id", "block_id"]).join(g, ["book_id", "normalized_term"])
    hit = F.exists("forms", lambda f: F.contains(F.col("t"), F.lower(f)))
    return j.groupBy("mention_id", "extraction_id", "block_id").agg(F.count("*").alias("translations"), F.bool_or(hit).alias("found"))


# --- checks -------------------------------------------------------------------------------------------------------------------


def entry_check(spark: SparkSession, root: str) -> DataFrame:
    """Candidates of a key whose leading forms are exactly the key's forms, none twice."""
    c = _candidates(spark, root).where("candidate_key is not null").withColumn("group", F.concat_ws("/", "book_id", "candidate_key"))
    forms = table(spark, root, "terminology_candidates", "candidate_id", "source_forms").dropDuplicates(["candidate_id"])
    all_forms = c.join(forms, "candidate_id").select("group", F.explode("source_forms").alias("form"))
    return responses.check_entries(c.select("group", F.col("source_form").alias("form")), all_forms, "group", "form")


def correction_faults(spark: SparkSession, root: str) -> DataFrame:
    return corrections.faults(_corrections(spark, root, "kind", "scope", "base", "replacement"))


def correction_resolution(spark: SparkSession, root: str) -> DataFrame:
    """The records of the revision with most of them, all active, against the bases of every other record."""
    c = _corrections(spark, root, "kind", "scope", "base", "applies_to_revision_id", "supersedes_id")
    n = c.groupBy("applies_to_revision_id").count().where("applies_to_revision_id is not null")
    top = n.agg(F.max_by("applies_to_revision_id", F.struct("count", "applies_to_revision_id")).alias("r")).first()["r"] or ""
    artifacts = c.where("kind <> 'target_segment'").select(F.get_json_object("base", "$.artifact_id").alias("artifact_id"))
    return corrections.resolve_set(c, c.select("correction_id"), top, artifacts)


def page_validation(spark: SparkSession, root: str) -> DataFrame:
    b = _blocks(spark, root, "illustrations").withColumn("illustrations", F.coalesce(F.size("illustrations"), F.lit(0)).cast("long"))
    return quality.page_stages(b, _translations(spark, root), mention_translations(spark, root), "extraction_id")


def effective_findings(spark: SparkSession, root: str) -> DataFrame:
    e = effective.effective_segments(_blocks(spark, root, "source_lang"), None, [], "source_lang")
    f = quality.run_rules(spark, quality.effective_rules(e, "extraction_id", "block_id", "effective_text", "render_lang"))
    return f.groupBy("rule", "detail").agg(F.count("*").alias("findings"))


def sealed_content(spark: SparkSession, root: str) -> DataFrame:
    t = _translations(spark, root).select("extraction_id", "block_id", "translated_text", "target_lang")
    e = effective.effective_segments(_blocks(spark, root, "source_lang"), t, ["extraction_id", "block_id"], "source_lang").where("block_id is not null")
    return quality.sealed_invariants(e, "extraction_id", "block_id", "render_lang", "mode")


def impact_is_a_partition(spark: SparkSession, root: str) -> DataFrame:
    e = _links(spark, root)
    nodes = e.select(F.col("parent").alias("node")).union(e.select(F.col("child").alias("node")))
    return selection.partition_check(_impacts(spark, root), nodes, "node")


def token_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Per source: documents, tokens by the budget's estimate, and documents above the cap."""
    d = table(spark, root, "documents", "source", "text").select("source", canon.token_estimate(F.col("text")).cast("long").alias("n"))
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.count_if(F.col("n") > 2_400).alias("above"))


def signal_categories(spark: SparkSession, root: str) -> DataFrame:
    """Event kinds as signals of a finding, by their category."""
    e = table(spark, root, "events", "user_id", "event_type", "value")
    words = F.array(F.when(F.col("event_type") == "error", "exception").when(F.col("event_type") == "purchase", "correction").otherwise(F.col("event_type")), F.when(F.col("value") > 50, "fallback").otherwise("plain"))
    return e.select(quality.actionable(words).alias("category"), "user_id").groupBy("category").agg(F.count("*").alias("findings"), F.countDistinct("user_id").alias("subjects"))


def item_tags(spark: SparkSession, root: str) -> DataFrame:
    """Validation items by task and language, those with a blank text, and whether the language check agrees."""
    i = table(spark, root, "eval_items", "task", "lang", "text").withColumn("said", canon.detect_language(F.col("text")))
    return i.groupBy("task", "lang").agg(F.count("*").alias("items"), F.count_if(F.coalesce(F.trim("text") == "", F.lit(True))).alias("blank"), F.count_if(F.col("said") == F.col("lang")).alias("agrees"))


# --- selections -----------------------------------------------------------------------------------------------------------------


def new_corrections(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "correction_records", "correction_id", "replacement", "loaded_at")
    return memo.new_records(c.where(f"loaded_at >= '{SINCE}'").select("correction_id", "replacement"), c.where(f"loaded_at < '{SINCE}'").select("correction_id", "replacement"), "correction_id", "replacement").select("correction_id")


def records_holding(spark: SparkSession, root: str) -> DataFrame:
    """Corrections of terminology whose base names an artifact that an older correction names too."""
    c = _corrections(spark, root, "kind", "base", "recorded_at")
    old = c.where(f"recorded_at < '{SINCE}'").select(F.get_json_object("base", "$.artifact_id").alias("artifact_id"))
    return selection.holding(c, "kind", "terminology", "base", old, "artifact_id").select("correction_id", "held_id")


def closure_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges whose both ends are in the closure of the records with five or more dependents."""
    e = _links(spark, root)
    seeds = e.groupBy(F.col("parent").alias("node")).count().where("count >= 5").select("node")
    inside = graph.reach(e, seeds)
    return e.join(inside.withColumnRenamed("node", "parent"), "parent", "left_semi").join(inside.withColumnRenamed("node", "child"), "child", "left_semi").select("parent", "child")


def edge_lookup(spark: SparkSession, root: str) -> DataFrame:
    """Each record's edges forward and back."""
    e = _links(spark, root)
    f = e.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("forward"))
    b = e.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("reverse"))
    return f.join(b, "node", "full_outer").select("node", F.coalesce("forward", F.lit(0)).alias("forward"), F.coalesce("reverse", F.lit(0)).alias("reverse"))


def artifact_closure(spark: SparkSession, root: str) -> DataFrame:
    """What the record with most dependencies needs: records by dependency, and corrections as findings with the record that they supersede."""
    e = _links(spark, root)
    top = e.groupBy("child").count().agg(F.max_by("child", F.struct("count", "child")).alias("artifact"))
    c = _corrections(spark, root, "supersedes_id")
    found = c.where("supersedes_id is not null").select(F.col("supersedes_id").alias("artifact"), F.col("correction_id").alias("finding"), F.col("correction_id").alias("subject"))
    one = c.agg(F.min("supersedes_id").alias("artifact")).where("artifact is not null")
    return selection.two_relation_closure(e.select(F.col("child").alias("artifact"), F.col("parent").alias("needs")), found, top.union(one))


def refreshed_leaves(spark: SparkSession, root: str) -> DataFrame:
    """The last translation before, and the first since, of blocks that have both."""
    t = _translations(spark, root)
    on = ["extraction_id", "block_id", "target_lang"]
    old = t.where(f"loaded_at < '{SINCE}'").groupBy(*on).agg(F.max("translated_id").alias("leaf"))
    new = t.where(f"loaded_at >= '{SINCE}'").groupBy(*on).agg(F.min("translated_id").alias("leaf"))
    return effective.pair_leaves(old, new, on, "leaf")


def source_set_winners(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "terminology_candidates", "candidate_id", "source_forms", "candidate_key", "tier").dropDuplicates(["candidate_id"])
    w = selection.winners(c, "source_forms", "tier", "candidate_key", "candidate_id")
    return w.select(F.array_join("source_forms", "|").alias("source_forms"), "candidate_id", "tier", "variants")


def latest_plans(spark: SparkSession, root: str) -> DataFrame:
    """Per kind the correction with most events (records that supersede it), of equal ones the greatest id."""
    c = _corrections(spark, root, "kind", "supersedes_id")
    n = c.where("supersedes_id is not null").groupBy(F.col("supersedes_id").alias("correction_id")).agg(F.count("*").alias("events"))
    return selection.latest(c.join(n, "correction_id", "left").withColumn("events", F.coalesce("events", F.lit(0))), ["kind"], "events", "correction_id")


def first_near_page(spark: SparkSession, root: str) -> DataFrame:
    """For each page found now the nearest page of the history read by the same model: least distance, then least id; one only."""
    p = _pages(spark, root, "phash", "model", "page_id", "extracted_at").where("phash is not null and model is not null")
    now, before = p.where(F.col("extracted_at") >= SINCE), p.where(F.col("extracted_at") < SINCE)
    r = selection.first_near(now.select("extraction_id", "phash", "model"), before.select("phash", "model", "page_id"), "phash", ["model"], "page_id")
    return r.select("extraction_id", "result", "distance")


def translation_memo(spark: SparkSession, root: str) -> DataFrame:
    """The memo after its upserts: the last translation of each block and language."""
    t = _translations(spark, root).select("extraction_id", "block_id", "target_lang", "translated_id", "loaded_at")
    key = ["extraction_id", "block_id", "target_lang"]
    old = selection.upsert(t.limit(0), t.where(f"loaded_at < '{SINCE}'"), key, "translated_id")
    return selection.upsert(old, t.where(f"loaded_at >= '{SINCE}'"), key, "translated_id").select(*key, "translated_id")


def leaf_identities(spark: SparkSession, root: str) -> DataFrame:
    """Contents with the leaf to try, or why there is none: several pages have it."""
    p = _pages(spark, root, "sha256", "model", "page_id")
    n = p.where("page_id is not null").groupBy("sha256", "model").agg(F.countDistinct("page_id").alias("n"), F.min("page_id").alias("leaf"))
    return n.select("sha256", "model", F.when(F.col("n") == 1, F.col("leaf")).alias("leaf"), F.when(F.col("n") > 1, "ambiguous").otherwise("unique").alias("state"))


def degraded_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Whether any translation is blank: of the run, of each book and of each page."""
    t = _translations(spark, root).select("book_id", F.col("extraction_id").cast("string").alias("page"), "translated_text").where("book_id is not null")
    return selection.any_true(t, [[], ["book_id"], ["book_id", "page"]], canon.blank(F.col("translated_text")))


def any_separator_phrases(spark: SparkSession, root: str) -> DataFrame:
    """Phrases whose words any separator parts, by size."""
    p = terms.phrases(_blocks(spark, root, "book_id", wide=True), ["extraction_id", "item"], within="book_id", joins="")
    return p.groupBy("book_id", "size").agg(F.count("*").alias("phrases"), F.sum("blocks").alias("blocks"), F.max("blocks").alias("most"))


def frequent_phrases(spark: SparkSession, root: str) -> DataFrame:
    """The phrases themselves, of three words or more in eight blocks or more."""
    p = terms.phrases(_blocks(spark, root, "book_id", wide=True), ["extraction_id", "item"], least=3, within="book_id")
    return p.where("blocks >= 8").select("book_id", "phrase", "size", "blocks")


def empty_input(spark: SparkSession, root: str) -> DataFrame:
    """Pages per book of an input, or, where it has none, one diagnostic row."""
    p = _pages(spark, root, "book_id", "image_path").where("image_path like '%.heic'")
    n = p.groupBy("book_id").agg(F.count("*").alias("pages")).withColumn("status", F.lit("ok"))
    none = p.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("book_id"), F.lit(0).cast("long").alias("pages"), F.lit("empty_input").alias("status"))
    return n.unionByName(none)


QUERIES = {
    f.__name__: f
    for f in (
        text_nfc, canonical_scopes, history_faults, extraction_keys, membership_keys, prompt_fingerprints, native_projection, translated_projection, segment_provenance, safe_paths, occurrence_spans,
        variant_paths, mention_translations, entry_check, correction_faults, correction_resolution, page_validation, effective_findings, sealed_content, impact_is_a_partition, token_sizes,
        signal_categories, item_tags, new_corrections, records_holding, closure_edges, edge_lookup, artifact_closure, refreshed_leaves, source_set_winners, latest_plans, first_near_page,
        translation_memo, leaf_identities, degraded_rollup, any_separator_phrases, frequent_phrases, empty_input,
    )
}

_T = "t as (select distinct on (translated_id) * from translated_blocks)"
_R = "r as (select distinct on (correction_id) * from correction_records)"
_FLAT = "'{{' || array_to_string(list_sort(list_transform(json_keys({c}), lambda k: to_json(k)::varchar || ':' || json_extract({c}, '$.\"' || k || '\"')::varchar)), ',') || '}}'"
_LIST = "'[' || array_to_string(list_transform(list_sort(list_distinct(coalesce({c}, []))), lambda x: to_json(x)::varchar), ',') || ']'"
_NGRAM = """{b}, s as (select book_id, extraction_id, item, regexp_split_to_array(lower(text), '{split}') as ps from b where text is not null), q as (select book_id, extraction_id, item, unnest(ps) as p from s),
u as (select book_id, extraction_id, item, {w} as ws from q),
o as (select distinct book_id, extraction_id, item, n::int as size, array_to_string(ws[i:i + n - 1], ' ') as phrase from (select *, generate_subscripts(ws, 1) as i from u), (select unnest([{sizes}]) as n) where i + n - 1 <= len(ws)),
c as (select book_id, phrase, size, count(*) as blocks from o group by 1, 2, 3 having count(*) >= 2)"""
_NONE = r"[\x{10ffff}]"
_ODD = r"[^\p{L}\p{N}_]*[^\p{L}\p{N}_\p{Zs}\p{Pd}''’][^\p{L}\p{N}_]*"
_MT = f"""{_T}, mm as (select distinct on (mention_id) * from term_mentions), gg as (select distinct on (group_id) * from term_groups), gf as (select book_id, normalized_term, flatten(list(forms)) as forms from gg where forms is not null group by 1, 2),
mt as (select mention_id, mm.extraction_id, mm.block_id, count(*) as translations, bool_or(len(list_filter(forms, lambda f: contains(lower(translated_text), lower(f)))) > 0) as found
from mm join t on mm.extraction_id = t.extraction_id and mm.block_id = t.block_id join gf on gf.book_id = mm.book_id and gf.normalized_term = lower(term) where translated_text is not null group by 1, 2, 3)"""
_EFF = f"{_B}, {_T}, tt as (select extraction_id, block_id, min({{'a': translated_text, 'b': target_lang}}) as x from t where not coalesce(not regexp_matches(translated_text, '[^\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]'), true) group by 1, 2)"

SQL = {
    "text_nfc": "select doc_id, sha256(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) as text_hash from documents",
    "canonical_scopes": f"with {_R} select correction_id, {_FLAT.format(c='scope')} as scope, {_FLAT.format(c='base')} as base from r",
    "history_faults": f"""with {_P}, h as (select * from p where page_id is not null), a as (select book_id, count(*) as pages, count(*) filter (sha256('page-v1'::blob || '\\x00'::blob || unhex(sha256)) <> page_id) as other_id from h group by 1),
b as (select book_id, count(*) filter (n > 1) as several_contents from (select book_id, page_id, count(distinct sha256) as n from h group by 1, 2) group by 1),
c as (select book_id, count(*) filter (n > 1) as several_ids from (select book_id, sha256, count(distinct page_id) as n from h group by 1, 2) group by 1) select * from a join b using (book_id) join c using (book_id)""",
    "extraction_keys": f"""with {_P} select extraction_id, sha256('source-extraction-v2' || chr(0) || '{{"extraction_schema":"page-1","model_executable_identity":"reader-1","model_id":' || to_json(model)::varchar || ',"reasoning_level":"low"}}' || chr(0) || 'Read the page.' || chr(0) || sha256) as semantic_key from p""",
    "membership_keys": f"""with {_C} select candidate_id, sha256('membership-v1' || chr(0) || '{{"concept_id":' || to_json(candidate_key)::varchar || ',"evidence_shard_ids":' || {_LIST.format(c="declared_block_ids")} || ',"membership_rules_version":"rules-1","occurrence_ids":' || {_LIST.format(c="occurrence_ids")} || '}}') as semantic_key from c where candidate_key is not null""",
    "prompt_fingerprints": f"""with {_B} select extraction_id, item, left(sha256('Translate the block.' || chr(10) || '{{"block_id":' || to_json(block_id)::varchar || ',"kind":' || to_json(type)::varchar || ',"text":' || to_json(text)::varchar || '}}'), 12) as fingerprint from b where text is not null and block_id is not null and type is not null""",
    "native_projection": f"with {_B} select extraction_id, item, sha256(text) as text_hash, coalesce(nullif(trim(source_lang), ''), 'und') as render_lang, 'native' as mode from b",
    "translated_projection": f"with {_EFF} select extraction_id, item, sha256(x.a) as text_hash, case when x is not null then x.b else 'und' end as render_lang, case when x is not null then 'translated' else 'diagnostic' end as mode from b left join tt using (extraction_id, block_id)",
    "segment_provenance": f"""with {_B.replace("select extraction_id, book_id", "select extraction_id, page_id, sha256, book_id")}, {_T}, {_M}, x as (select extraction_id, block_id, string_agg(distinct translated_id::varchar, ',' order by translated_id::varchar) as translations from t group by 1, 2),
y as (select extraction_id, block_id, count(*) as mentions from m group by 1, 2) select extraction_id, item, page_id, sha256, coalesce(translations, '') as translations, coalesce(mentions, 0) as mentions from b left join x using (extraction_id, block_id) left join y using (extraction_id, block_id)""",
    "safe_paths": f"""with {_P} select extraction_id, coalesce(image_path <> '' and not regexp_matches(image_path, '\\\\|//|^/|/$|(^|/)\\.{{1,2}}(/|$)|[\\x00-\\x1f]'), false) as safe from p""",
    "occurrence_spans": f"""with {_B}, {_M}, x as (select extraction_id, block_id, min(text) as text from b where text is not null group by 1, 2), k as (select *, row_number() over (partition by extraction_id, block_id, term order by mention_id) as k from m where term <> ''),
s as (select mention_id, term, k, string_split(text, term) as ps from k join x using (extraction_id, block_id)), e as (select mention_id, case when k < len(ps) then list_sum(list_transform(ps[1:k], lambda y: length(y)))::int + ((k - 1) * length(term))::int else -1 end as start, length(term)::int as n from s)
select mention_id, start, case when start < 0 then -1 else start + n end as "end" from e""",
    "variant_paths": f"""with {_P}, d as (select distinct book_id, page_number::varchar as page, image_path from p where page_number is not null and image_path is not null and book_id is not null)
select book_id, page, image_path, book_id || '/' || page || case when count(*) over w > 1 then '#' || row_number() over (partition by book_id, page order by image_path) else '' end as name from d window w as (partition by book_id, page)""",
    "mention_translations": f"with {_MT} select * from mt",
    "entry_check": f"""with {_C}, e as (select book_id || '/' || candidate_key as "group", source_form as form, count(*) as n from c where candidate_key is not null group by 1, 2), f as (select distinct book_id || '/' || candidate_key as "group", unnest(source_forms) as form from c where candidate_key is not null)
select coalesce(e."group", f."group") as "group", bool_and(coalesce(n = 1 and f.form is not null, false)) as accepted from e full join f on e."group" = f."group" and e.form = f.form group by 1""",
    "correction_faults": f"""with {_R} select correction_id, case when kind not in ('source_text', 'target_segment', 'target_occurrence', 'terminology') or kind is null then 'kind' when scope is null or not json_valid(scope) or len(json_keys(scope)) = 0 then 'scope'
when len(list_filter(json_keys(scope), lambda k: not list_contains(case kind when 'terminology' then ['concept_id', 'selector'] when 'target_occurrence' then ['segment_id', 'start', 'end'] else ['segment_id'] end, k))) > 0 then 'scope_fields'
when base is null or not json_valid(base) then 'base' when replacement is null or trim(replacement) = '' then 'replacement' when nfc_normalize(replacement) <> replacement then 'not_nfc' end as fault from r""",
    "correction_resolution": f"""with recursive {_R}, c as (select correction_id, kind, scope, json_extract_string(base, '$.artifact_id') as artifact_id, applies_to_revision_id as rev, nullif(trim(supersedes_id), '') as s from r),
top as (select arg_max(rev, (n, rev)) as rev from (select rev, count(*) as n from c where rev is not null group by 1)), held as (select distinct artifact_id from c where kind <> 'target_segment'),
e as (select distinct correction_id as c, s as p from c where s is not null), anc(c, a) as (select c, p from e union select anc.c, e.p from anc join e on anc.a = e.c), loops as (select c from anc where c = a),
bad as (select c from loops union select anc.c from anc join loops l on anc.a = l.c), miss as (select distinct c from anc where a not in (select correction_id from c)),
od as (select e.c from e join c x on x.correction_id = e.c join c y on y.correction_id = e.p where x.kind is distinct from y.kind or x.scope is distinct from y.scope),
odd as (select c from od union select anc.c from anc join od on anc.a = od.c), over_ as (select distinct s as correction_id from c where s is not null and s <> correction_id),
st as (select correction_id, kind, scope, case when rev is distinct from (select rev from top) then 'base_mismatch' when artifact_id is null or artifact_id not in (select artifact_id from held where artifact_id is not null) then 'base_missing' when correction_id in (select c from bad) then 'cycle'
  when correction_id in (select c from miss) then 'ancestor_missing' when correction_id in (select c from odd) then 'ancestor_scope' when correction_id in (select correction_id from over_) then 'superseded' end as state from c),
n as (select kind, scope, count(*) as n from st where state is null group by 1, 2) select correction_id, coalesce(state, case when n > 1 then 'conflict' else 'active' end) as outcome from st left join n using (kind, scope)""",
    "page_validation": f"""with {_B.replace("select extraction_id, book_id", "select extraction_id, illustrations, book_id")}, {_MT}, g as (select distinct extraction_id from t), bb as (select * from b where extraction_id in (select extraction_id from g)),
f as (select extraction_id, 1 as n from bb where block_id is null or trim(block_id) = '' union all select extraction_id, 1 from bb where type is null or type not in ('heading','paragraph','caption','footnote','table','list_item','pull_quote','illustration','quote','page_number')
union all select extraction_id, 1 from bb where reading_order is null or reading_order < 0 union all select extraction_id, count(*) - 1 from bb where trim(block_id) <> '' group by extraction_id, block_id union all select extraction_id, count(*) - 1 from bb where reading_order >= 0 group by extraction_id, reading_order),
s1 as (select extraction_id, sum(n)::bigint as v from f group by 1), s2 as (select extraction_id, count(*) filter (coalesce(not regexp_matches(text, '[^\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]'), true)) as v, count(*) filter (type = 'illustration') as i, max(coalesce(len(illustrations), 0)) as n from bb group by 1),
tx as (select extraction_id, count(*) filter (coalesce(not regexp_matches(translated_text, '[^\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]'), true)) as v, string_agg(coalesce(translated_text, ''), chr(10) order by block_id nulls first, translated_text nulls first) as x, min(target_lang) as l from t group by 1),
s3 as (select extraction_id, v, l, ({_detect('x')}) as said from tx), sc as (select extraction_id, block_id, count(*) as s from bb group by 1, 2), tc as (select extraction_id, block_id, count(*) as t from t group by 1, 2),
s5 as (select extraction_id, count(*) as v from (select extraction_id, t, s from sc full join tc using (extraction_id, block_id)) where t is null or s is null or t > 1 group by 1), s6 as (select extraction_id, count(*) filter (not found) as v from mt group by 1),
j as (select g.extraction_id, coalesce(s1.v, 0) as a, coalesce(s2.v, 0) + coalesce(s3.v, 0) as b, coalesce((said <> lower(l))::bigint, 0) as c, (coalesce(s2.n, 0) <> coalesce(s2.i, 0))::bigint as d, coalesce(s5.v, 0) as e, coalesce(s6.v, 0) as f
from g left join s1 using (extraction_id) left join s2 using (extraction_id) left join s3 using (extraction_id) left join s5 using (extraction_id) left join s6 using (extraction_id))
select extraction_id, unnest(['block_schema', 'non_empty_text', 'translation_language', 'illustration_count', 'block_id_correspondence', 'glossary_consistency']) as stage, unnest([a, b, c, d, e, f])::bigint as errors from j""",
    "effective_findings": f"""with {_B}, s as (select concat_ws('/', extraction_id::varchar, block_id) as subject, text, coalesce(nullif(trim(source_lang), ''), 'und') as l, ({_detect('text')}) as said from b)
select 'effective_structure' as rule, 'the segment stands twice' as detail, count(*) as findings from (select subject from s group by 1 having count(*) > 1) having count(*) > 0
union all select 'non_empty_text', 'the text is empty', count(*) from s where coalesce(not regexp_matches(text, '[^\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]'), true) having count(*) > 0
union all select 'language', 'appears to be ' || said || ', expected ' || l, count(*) from s where l <> 'und' and said <> lower(l) group by 2""",
    "sealed_content": f"""with {_EFF}, e as (select extraction_id, block_id, case when x is not null then x.b else 'und' end as l, case when x is not null then 'translated' else 'diagnostic' end as m from b left join tt using (extraction_id, block_id) where block_id is not null),
a as (select count(*) as segments, count(*) filter (n > 1) as in_several_pages from (select block_id, count(distinct extraction_id) as n from e group by 1)), d as (select count(distinct l) as languages, count(distinct m) as modes from e where m <> 'diagnostic')
select *, in_several_pages = 0 and languages <= 1 and modes <= 1 as sealed from a, d""",
    "impact_is_a_partition": f"{_IMPACT}, k as (select node, count(*) as n from i group by 1) select (select count(*) from nodes) as universe, count(*) filter (n > 0) as assigned, count(*) filter (n > 1) as twice, count(*) filter (n is null) as missing, 0::bigint as strange, count(*) filter (n > 1) = 0 and count(*) filter (n is null) = 0 as exact from nodes left join k using (node)",
    "token_sizes": "select source, count(*) as documents, sum(strlen(text))::bigint as tokens, count(*) filter (strlen(text) > 2400) as above from documents group by 1",
    "signal_categories": """select case when event_type = 'error' then 'failure' when value > 50 then 'fallback' when event_type = 'purchase' then 'correction_impact' end as category, count(*) as findings, count(distinct user_id) as subjects from events group by 1""",
    "item_tags": f"select task, lang, count(*) as items, count(*) filter (coalesce(trim(text) = '', true)) as blank, count(*) filter (({_detect('text')}) = lang) as agrees from eval_items group by 1, 2",
    "new_corrections": f"select distinct correction_id from correction_records where loaded_at >= '{SINCE}' and correction_id not in (select correction_id from correction_records where loaded_at < '{SINCE}')",
    "records_holding": f"""with {_R}, a as (select correction_id, kind, json_extract_string(base, '$.artifact_id') as held_id, recorded_at from r) select correction_id, held_id from a where kind = 'terminology' and regexp_matches(held_id, '^[0-9a-f]{{64}}$') and held_id in (select held_id from a where recorded_at < '{SINCE}')""",
    "closure_edges": f"with recursive {_E}, hit(node) as (select p from e group by 1 having count(*) >= 5 union select e.c from hit join e on hit.node = e.p) select p as parent, c as child from e where p in (select node from hit) and c in (select node from hit)",
    "edge_lookup": f"with {_E}, f as (select p as node, count(*) as forward from e group by 1), b as (select c as node, count(*) as reverse from e group by 1) select node, coalesce(forward, 0) as forward, coalesce(reverse, 0) as reverse from f full join b using (node)",
    "artifact_closure": f"""with recursive {_E}, {_R}, top as (select arg_max(c, (n, c)) as id from (select c, count(*) as n from e group by 1)), one as (select min(supersedes_id) as id from r),
s as (select id from top where id is not null union select id from one where id is not null), need as (select c as a, p as b from e union select supersedes_id, correction_id from r where supersedes_id is not null),
w(id) as (select id from s union select need.b from w join need on w.id = need.a) select id, 'artifact' as what from w union all select distinct correction_id, 'finding' from r where supersedes_id in (select id from w)""",
    "refreshed_leaves": f"""with {_T}, o as (select extraction_id, block_id, target_lang, max(translated_id) as old_leaf from t where loaded_at < '{SINCE}' group by 1, 2, 3), n as (select extraction_id, block_id, target_lang, min(translated_id) as new_leaf from t where loaded_at >= '{SINCE}' group by 1, 2, 3) select * from o join n using (extraction_id, block_id, target_lang)""",
    "source_set_winners": f"""with {_C}, k as (select array_to_string(list_sort(list_distinct(source_forms)), '|') as source_forms, candidate_id, tier, candidate_key from c where source_forms is not null)
select source_forms, arg_min(candidate_id, (tier, candidate_key, candidate_id)) as candidate_id, min(tier) as tier, count(*) as variants from k group by 1""",
    "latest_plans": f"with {_R}, n as (select supersedes_id as correction_id, count(*) as events from r where supersedes_id is not null group by 1), j as (select kind, correction_id, coalesce(events, 0) as events from r left join n using (correction_id)) select kind, arg_max(correction_id, (events, correction_id)) as correction_id, max(events) as events from j group by 1",
    "first_near_page": f"""with {_P}, h as (select *, ('0x' || lower(phash))::ubigint as v from p where model is not null and regexp_matches(lower(phash), '^[0-9a-f]{{16}}$')), k as (select a.extraction_id, bit_count(xor(a.v, b.v))::int as d, b.page_id from h a join h b using (model) where a.extracted_at >= '{SINCE}' and b.extracted_at < '{SINCE}' and b.page_id is not null)
select extraction_id, arg_min(page_id, (d, page_id)) as result, min(d) as distance from k where d <= 5 group by 1""",
    "translation_memo": f"""with {_T}, k as (select extraction_id, block_id, target_lang, translated_id, loaded_at >= '{SINCE}' as late from t), m as (select extraction_id, block_id, target_lang, max(translated_id) filter (late) as n, max(translated_id) filter (not late) as o from k group by 1, 2, 3) select extraction_id, block_id, target_lang, coalesce(n, o) as translated_id from m where coalesce(n, o) is not null""",
    "leaf_identities": f"with {_P}, n as (select sha256, model, count(distinct page_id) as n, min(page_id) as leaf from p where page_id is not null group by 1, 2) select sha256, model, case when n = 1 then leaf end as leaf, case when n > 1 then 'ambiguous' else 'unique' end as state from n",
    "degraded_rollup": f"""with {_T}, k as (select book_id, extraction_id::varchar as page, coalesce(not regexp_matches(translated_text, '[^\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]'), true) as f from t where book_id is not null) select 'run' as level, '' as key, coalesce(bool_or(f), false) as flagged, count(*) as "of" from k
union all select 'book_id', book_id, bool_or(f), count(*) from k group by 2 union all select 'book_id/page', book_id || '/' || page, bool_or(f), count(*) from k group by 2""",
    "any_separator_phrases": f"with {_NGRAM.format(b=_B, split=_NONE, w=_W(t='p'), sizes='2, 3, 4, 5, 6')} select book_id, size, count(*) as phrases, sum(blocks)::bigint as blocks, max(blocks) as most from c group by 1, 2",
    "frequent_phrases": f"with {_NGRAM.format(b=_B, split=_ODD, w=_W(t='p'), sizes='3, 4, 5, 6')} select book_id, phrase, size, blocks from c where blocks >= 8",
    "empty_input": f"with {_P}, k as (select * from p where image_path like '%.heic') select book_id, count(*) as pages, 'ok' as status from k group by 1 union all select null, 0, 'empty_input' where not exists (select 1 from k)",
}
