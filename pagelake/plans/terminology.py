"""Queries on terms, candidates, corrections and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators import graph, intervals, memo, overlays, quality, similar, terms
from pagelake.operators.hierarchy import edges_of
from pagelake.plans.ingest import _B, _P, _blocks, _pages
from pagelake.sources.tables import table


def _mentions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "term_mentions", "mention_id", "extraction_id", "book_id", "block_id", "term", "category").dropDuplicates(["mention_id"])


def _groups(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "term_groups", "group_id", "book_id", "normalized_term", "forms", "provenance").dropDuplicates(["group_id"])


def _candidates(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "terminology_candidates", "candidate_id", "book_id", "candidate_key", "source_form", "tier", "declared_block_ids", "occurrence_ids").dropDuplicates(["candidate_id"])


def term_occurrences(spark: SparkSession, root: str) -> DataFrame:
    b = _blocks(spark, root).where("text is not null").select("extraction_id", "block_id", "text")
    o = terms.occurrences(_mentions(spark, root), b, ["extraction_id", "block_id"])
    return o.groupBy("mention_id").agg(F.count("*").alias("occurrences"), F.min("start").alias("first_start"))


def proper_name_runs(spark: SparkSession, root: str) -> DataFrame:
    runs = terms.name_runs(_blocks(spark, root, "book_id", wide=True), ["book_id", "extraction_id", "item"])
    return runs.groupBy("book_id", "phrase", "size").agg(F.count("*").alias("runs"))


def ngram_phrases(spark: SparkSession, root: str) -> DataFrame:
    p = terms.phrases(_blocks(spark, root, "book_id", wide=True), ["book_id", "extraction_id", "item"], within="book_id")
    return p.groupBy("book_id", "size").agg(F.count("*").alias("phrases"), F.sum("blocks").alias("blocks"), F.max("blocks").alias("most"))


def technical_terms(spark: SparkSession, root: str) -> DataFrame:
    t = terms.technical_words(_blocks(spark, root, wide=True), ["extraction_id", "item"])
    return t.groupBy("word", "kind").agg(F.count("*").alias("blocks"))


def candidate_merge(spark: SparkSession, root: str) -> DataFrame:
    c = _candidates(spark, root).select("book_id", "candidate_key", "tier", F.col("source_form").alias("form"), F.col("declared_block_ids").alias("blocks"), F.col("occurrence_ids").alias("occurrences"))
    m = terms.merge_candidates(c, ["book_id", "candidate_key"])
    return m.select("book_id", "candidate_key", "tier", "form", F.size("blocks").alias("n_blocks"), F.size("occurrences").alias("n_occurrences"))


def candidate_topk(spark: SparkSession, root: str) -> DataFrame:
    c = _candidates(spark, root).select("book_id", "candidate_key", "tier", F.col("source_form").alias("form"), F.col("declared_block_ids").alias("blocks"), F.col("occurrence_ids").alias("occurrences"))
    m = terms.top_candidates(terms.merge_candidates(c, ["book_id", "candidate_key"]), "book_id", "candidate_key")
    return m.select("book_id", "candidate_key", "tier", "rank")


def concept_membership(spark: SparkSession, root: str) -> DataFrame:
    m = terms.memberships(_mentions(spark, root).select("book_id", F.lower("term").alias("form"), "mention_id"), ["book_id", "form"], "mention_id")
    return m.select("book_id", "form", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def alias_index(spark: SparkSession, root: str) -> DataFrame:
    g = _groups(spark, root).select("book_id", F.explode("forms").alias("alias"), "group_id")
    m = terms.memberships(g, ["book_id", "alias"], "group_id")
    return m.select("book_id", "alias", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def conflicting_categories(spark: SparkSession, root: str) -> DataFrame:
    m = _mentions(spark, root).select("book_id", F.lower("term").alias("form"), "category", "mention_id")
    return terms.conflicts(m, ["book_id", "form"], "category", "mention_id")


def glossary_slice(spark: SparkSession, root: str) -> DataFrame:
    g = _groups(spark, root).select("book_id", "group_id", "normalized_term")
    b = _blocks(spark, root, "book_id").select("book_id", "extraction_id", "item", "text")
    hit = terms.terms_in_texts(g, b, "book_id", "normalized_term", "text", ["extraction_id", "item"])
    return hit.groupBy("group_id").agg(F.countDistinct("extraction_id", "item").alias("blocks"))


def missing_term(spark: SparkSession, root: str) -> DataFrame:
    g = _groups(spark, root).select("book_id", "group_id", "normalized_term").where("normalized_term rlike '[\\\\p{L}\\\\p{N}_]'")
    b = _blocks(spark, root, "book_id").select("book_id", "extraction_id", "item", "text")
    hit = terms.terms_in_texts(g, b, "book_id", "normalized_term", "text", ["extraction_id", "item"])
    return g.join(hit.select("group_id").hint("merge"), "group_id", "left_anti").select("group_id")


def projection_scope(spark: SparkSession, root: str) -> DataFrame:
    """Candidates with a declared block of their book that a term group has as provenance."""
    c = _candidates(spark, root).select(F.col("candidate_id").alias("id"), F.expr("transform(coalesce(declared_block_ids, array()), x -> concat(book_id, '/', x))").alias("scope"))
    g = _groups(spark, root).select("book_id", F.explode("provenance").alias("b")).select(F.concat("book_id", F.lit("/"), "b").alias("target"))
    return overlays.scoped(c, "scope", g, "target").select(F.col("id").alias("candidate_id"))


def selector_overlap_conflict(spark: SparkSession, root: str) -> DataFrame:
    c = _candidates(spark, root)
    return overlays.overlapping(c, ["book_id", "tier"], "candidate_id", "source_form", "declared_block_ids").select("tier", F.col("a").alias("candidate_id_a"), F.col("b").alias("candidate_id_b"))


def token_budget_packing(spark: SparkSession, root: str) -> DataFrame:
    size = F.octet_length("normalized_term") + F.expr("aggregate(forms, 0, (a, x) -> a + octet_length(x))") + F.expr("aggregate(provenance, 0, (a, x) -> a + octet_length(x))")
    g = _groups(spark, root).select("book_id", "group_id", size.cast("int").alias("size"))
    return terms.greedy_batches(g, "book_id", "group_id", "size", 2_400).select("book_id", "group_id", "size", "batch")


def frozen_terminology(spark: SparkSession, root: str) -> DataFrame:
    return terms.frozen_hash(_groups(spark, root), "book_id", F.concat_ws("\t", "normalized_term", F.array_join("forms", "|")))


def glossary_versions(spark: SparkSession, root: str) -> DataFrame:
    """Forms whose category, as first mentioned, differs from that last mentioned."""
    m = _mentions(spark, root).where("category is not null").select("book_id", F.lower("term").alias("form"), "category", "mention_id")
    m = m.withColumn("concept", F.concat_ws("/", "book_id", "form"))
    per = m.groupBy("concept").agg(F.min_by("category", "mention_id").alias("a"), F.max_by("category", "mention_id").alias("b"))
    return terms.glossary_diff(per.select("concept", F.col("a").alias("target")), per.select("concept", F.col("b").alias("target")), "concept", "target")


def near_pages(spark: SparkSession, root: str) -> DataFrame:
    p = _pages(spark, root, "phash").where("phash is not null")
    return similar.near_hashes(p, "phash", 5)


def near_rescans(spark: SparkSession, root: str) -> DataFrame:
    """Pages against rescans of them: the same hashes with the last four bits cleared."""
    p = _pages(spark, root, "phash").where("phash is not null").select("phash")
    again = p.select(F.concat(F.left("phash", F.length("phash") - 1), F.lit("0")).alias("phash"))
    return similar.near_hashes(p.union(again), "phash", 5)


def semantic_cache(spark: SparkSession, root: str) -> DataFrame:
    p = _pages(spark, root, "sha256", "model", "source_lang", "page_id", "extracted_at")
    old = p.where("extracted_at < '2023-01-01'")
    hits = memo.lookup(p.where("extracted_at >= '2023-01-01'").select("extraction_id", "sha256", "model"), old, ["sha256", "model"], "page_id")
    return hits.select("extraction_id", "status", "result")


def overlay_resolution(spark: SparkSession, root: str) -> DataFrame:
    return overlays.resolve(table(spark, root, "correction_records", "correction_id", "kind", "scope", "replacement", "supersedes_id"))


def correction_latest(spark: SparkSession, root: str) -> DataFrame:
    """Per kind and scope the last recorded correction, of equal times the greatest id."""
    c = table(spark, root, "correction_records", "correction_id", "kind", "scope", "recorded_at").dropDuplicates(["correction_id"])
    return c.groupBy("kind", "scope").agg(F.max_by("correction_id", F.struct("recorded_at", "correction_id")).alias("correction_id"), F.count("*").alias("records"))


def _impacts(spark: SparkSession, root: str) -> DataFrame:
    e = edges_of(table(spark, root, "record_dependencies", "record_id", "dependency_id"), "record_id", "dependency_id", "d").select("parent", "child")
    nodes = e.select(F.col("parent").alias("node")).union(e.select(F.col("child").alias("node"))).distinct()
    n = e.groupBy(F.col("child").alias("node")).agg(F.countDistinct("parent").alias("n"))
    changed = e.groupBy(F.col("parent").alias("node")).count().where("count >= 5").select("node")
    loops = e.where("parent = child").select(F.col("child").alias("node"))
    leaves = nodes.join(e.select(F.col("parent").alias("node")), "node", "left_anti").join(n.where("n >= 2"), "node", "left_semi")
    return graph.impact(e, nodes, changed, leaves, loops)


def impact_partition(spark: SparkSession, root: str) -> DataFrame:
    """What a change of the records with five or more direct dependents would do to each record."""
    return _impacts(spark, root)


def execution_impact(spark: SparkSession, root: str) -> DataFrame:
    i = _impacts(spark, root)
    c = table(spark, root, "record_dependencies", "record_id").select(F.col("record_id").alias("node"))
    return graph.execution(i, i.where("impact = 'protected'").select("node"), c).groupBy("outcome").agg(F.count("*").alias("records"))


def dangling_links(spark: SparkSession, root: str) -> DataFrame:
    """Parents of corrections that are no correction themselves."""
    c = table(spark, root, "correction_records", "correction_id", "supersedes_id")
    e = edges_of(c, "correction_id", "supersedes_id", "c").select("parent", "child")
    return graph.dangling(e, c.select(F.col("correction_id").alias("node"))).withColumnRenamed("node", "correction_id")


def findings_rollup(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events", "user_id", "event_type", "value")
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 50, "warning").otherwise("info")
    kind = F.when(F.col("event_type") == "signup", "review_request").otherwise(F.col("event_type"))
    g = e.select("user_id", quality.category(kind, severity).alias("category"))
    return g.groupBy("category").agg(F.count("*").alias("findings"), F.countDistinct("user_id").alias("subjects"))


def interval_union(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events", "event_type", "ts", "value")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = e.select("event_type", start.alias("a"), (start + F.floor(F.col("value")).cast("long") * 1_000_000).alias("b"))
    return intervals.union_total(rows, "event_type", "a", "b")


QUERIES = {
    f.__name__: f
    for f in (
        term_occurrences, proper_name_runs, ngram_phrases, technical_terms, candidate_merge, candidate_topk, concept_membership, alias_index, conflicting_categories,
        glossary_slice, missing_term, projection_scope, selector_overlap_conflict, token_budget_packing, frozen_terminology, glossary_versions, near_pages, near_rescans,
        semantic_cache, overlay_resolution, correction_latest, impact_partition, execution_impact, dangling_links, findings_rollup, interval_union,
    )
}

_M = "m as (select distinct on (mention_id) * from term_mentions)"
_G = "g as (select distinct on (group_id) * from term_groups)"
_C = "c as (select distinct on (candidate_id) * from terminology_candidates)"
_WORDS = "regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+')"
_W = _WORDS.format
_CM = """cm as (select book_id, candidate_key, min(tier) as tier, min(source_form) as form,
  len(list_distinct(flatten(list(coalesce(declared_block_ids, []))))) as n_blocks, len(list_distinct(flatten(list(coalesce(occurrence_ids, []))))) as n_occurrences from c group by 1, 2)"""
_HIT = f"""with {_B.replace("b as (", "bb as (", 1)}, {_G}, b as (select * from bb where text is not null),
hit as (select group_id, extraction_id, item from g join b using (book_id) where normalized_term <> '' and contains(lower(text), lower(normalized_term))
  and len(list_filter(generate_series(1, length(text)), lambda i: substr(lower(text), i, length(normalized_term)) = lower(normalized_term)
    and not regexp_matches(substr(' ' || lower(text), i, 1), '[\\p{{L}}\\p{{N}}_]') and not regexp_matches(substr(lower(text) || ' ', i + length(normalized_term), 1), '[\\p{{L}}\\p{{N}}_]'))) > 0)"""
_E = "e as (select distinct trim(dependency_id) as p, trim(record_id) as c from record_dependencies where trim(dependency_id) <> '' and trim(record_id) <> '')"
_IMPACT = f"""with recursive {_E}, nodes as (select p as node from e union select c from e), changed as (select p as node from e group by 1 having count(*) >= 5),
hit(node) as (select node from changed union select e.c from hit join e on hit.node = e.p), loops as (select distinct c as node from e where p = c),
leaves as (select node from nodes where node not in (select p from e) and node in (select c from e group by 1 having count(distinct p) >= 2)),
i as (select node, case when node in (select node from loops) then 'ambiguous' when node in (select node from leaves) then 'protected' when node in (select node from hit) then 'affected' else 'unaffected' end as impact from nodes)"""

SQL = {
    "term_occurrences": f"""with {_B}, {_M}, j as (select mention_id, term, text from m join b using (extraction_id, block_id) where term <> '' and text is not null and contains(text, term)),
o as (select mention_id, term, list_filter(generate_series(1, length(text)), lambda i: substr(text, i, length(term)) = term and not regexp_matches(substr(' ' || text, i, 1), '[\\p{{L}}\\p{{N}}_]')
  and not regexp_matches(substr(text || ' ', i + length(term), 1), '[\\p{{L}}\\p{{N}}_]')) as spots from j)
select mention_id, sum(len(spots))::bigint as occurrences, (min(spots[1]) - 1)::int as first_start from o where len(spots) > 0 group by 1""",
    "proper_name_runs": f"""with {_B}, w as (select book_id, extraction_id, item, i, ws[i] as word, sp[i] as sep from (select *, generate_subscripts(ws, 1) as i from (select book_id, extraction_id, item, {_W(t="text")} as ws, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}_]+') as sp from b where text is not null))),
k as (select *, regexp_matches(word, '^[0-9_]*[\\p{{Lu}}\\p{{Lt}}]') as cap from w), f as (select *, cap and not (coalesce(lag(cap) over r, false) and regexp_matches(sep, '^\\p{{Zs}}+$')) as starts from k window r as (partition by extraction_id, item order by i)),
s as (select *, sum(starts::int) over (partition by extraction_id, item order by i) as run from f), a as (select book_id, extraction_id, item, run, count(*)::int as size, string_agg(word, ' ' order by i) as phrase from s where cap group by 1, 2, 3, 4)
select book_id, phrase, size, count(*) as runs from a where size between 2 and 6 group by 1, 2, 3""",
    "ngram_phrases": f"""with {_B}, t as (select book_id, extraction_id, item, {_W(t="lower(text)")} as ws, regexp_split_to_array(lower(text), '[\\p{{L}}\\p{{N}}_]+') as sp from b where text is not null),
w as (select book_id, extraction_id, item, i, n::int as size, array_to_string(ws[i:i + n - 1], ' ') as phrase, sp[i + 1:i + n - 1] as between_ from (select *, generate_subscripts(ws, 1) as i from t), (select unnest([2, 3, 4, 5, 6]) as n) where i + n - 1 <= len(ws)),
o as (select distinct book_id, extraction_id, item, size, phrase from w where len(list_filter(between_, lambda x: not regexp_matches(x, '^[\\p{{Zs}}\\p{{Pd}}''’]+$'))) = 0),
c as (select book_id, phrase, size, count(*) as blocks from o group by 1, 2, 3 having count(*) >= 2) select book_id, size, count(*) as phrases, sum(blocks)::bigint as blocks, max(blocks) as most from c group by 1, 2""",
    "technical_terms": f"""with {_B}, t as (select extraction_id, item, text, {_W(t="text")} as ws from b where text is not null), x as (
select distinct extraction_id, item, word, 'identifier' as kind from (select extraction_id, item, unnest(ws) as word from t) where regexp_matches(word, '^[A-Za-z0-9_]*[A-Za-z][A-Za-z0-9_]*$') and regexp_matches(word, '[0-9_]')
union all select distinct extraction_id, item, word, 'capitals' from (select extraction_id, item, unnest(ws) as word from t) where regexp_matches(word, '^\\p{{Lu}}{{2,}}$')
union all select distinct extraction_id, item, word, 'compound' from (select extraction_id, item, unnest(regexp_extract_all(text, '[A-Za-z0-9]+[-/][A-Za-z0-9]+')) as word from t)) select word, kind, count(*) as blocks from x group by 1, 2""",
    "candidate_merge": f"with {_C}, {_CM} select book_id, candidate_key, tier, form, n_blocks::int as n_blocks, n_occurrences::int as n_occurrences from cm",
    "candidate_topk": f"""with {_C}, {_CM}, r as (select book_id, candidate_key, tier, row_number() over (partition by book_id order by tier, n_blocks desc, n_occurrences desc, candidate_key, form) as rank, sum((tier = 0)::int) over (partition by book_id) as held from cm)
select book_id, candidate_key, tier, rank::int as rank from r where tier = 0 or (rank <= greatest(64, held) and held <= 64)""",
    "concept_membership": f"with {_M} select book_id, lower(term) as form, string_agg(mention_id::varchar, ',' order by mention_id) as members from m group by 1, 2",
    "alias_index": f"with {_G}, x as (select distinct book_id, unnest(forms) as alias, group_id from g) select book_id, alias, string_agg(group_id::varchar, ',' order by group_id) as members from x group by 1, 2",
    "conflicting_categories": f"with {_M} select book_id, lower(term) as form, count(distinct category) as n_values, arg_min(category, mention_id) as first from m where category is not null group by 1, 2 having count(distinct category) > 1",
    "glossary_slice": f"{_HIT} select group_id, count(*) as blocks from hit group by 1",
    "missing_term": f"{_HIT} select group_id from g where regexp_matches(normalized_term, '[\\p{{L}}\\p{{N}}_]') and group_id not in (select group_id from hit)",
    "projection_scope": f"with {_C}, {_G}, x as (select candidate_id, book_id, unnest(declared_block_ids) as b from c), y as (select distinct book_id, unnest(provenance) as b from g) select distinct candidate_id from x join y using (book_id, b)",
    "selector_overlap_conflict": f"""with {_C}, x as (select book_id, tier, candidate_id, source_form, unnest(declared_block_ids) as b from c)
select distinct p.tier, p.candidate_id as candidate_id_a, q.candidate_id as candidate_id_b from x p join x q using (book_id, tier, b) where p.candidate_id < q.candidate_id and p.source_form <> q.source_form""",
    "token_budget_packing": f"""with recursive {_G}, s as (select book_id, group_id, (strlen(normalized_term) + coalesce(list_sum(list_transform(forms, lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(provenance, lambda x: strlen(x))), 0))::int as size,
  row_number() over (partition by book_id order by group_id) as n from g),
r(book_id, group_id, size, n, used, batch) as (select book_id, group_id, size, n, size, 0 from s where n = 1
  union all select s.book_id, s.group_id, s.size, s.n, case when r.used + s.size > 2400 then s.size else r.used + s.size end, r.batch + (r.used + s.size > 2400)::int from r join s on s.book_id = r.book_id and s.n = r.n + 1)
select book_id, group_id, size, batch from r""",
    "frozen_terminology": f"with {_G}, x as (select distinct book_id, concat_ws(chr(9), normalized_term, array_to_string(forms, '|')) as e from g) select book_id, count(*) as entries, sha256(string_agg(e, chr(10) order by e)) as hash from x group by 1",
    "glossary_versions": f"with {_M}, x as (select concat_ws('/', book_id, lower(term)) as concept, arg_min(category, mention_id) as a, arg_max(category, mention_id) as b from m where category is not null group by 1) select concept, a as old, b as new from x where a <> b",
    "near_pages": f"""with {_P}, h as (select distinct lower(phash) as h, ('0x' || phash)::ubigint as v from p where regexp_matches(lower(phash), '^[0-9a-f]{{16}}$'))
select x.h as a, y.h as b, bit_count(xor(x.v, y.v))::int as distance from h x join h y on x.h < y.h where bit_count(xor(x.v, y.v)) <= 5""",
    "near_rescans": f"""with {_P}, k as (select phash from p union select left(phash, length(phash) - 1) || '0' from p), h as (select distinct lower(phash) as h, ('0x' || phash)::ubigint as v from k where regexp_matches(lower(phash), '^[0-9a-f]{{16}}$'))
select x.h as a, y.h as b, bit_count(xor(x.v, y.v))::int as distance from h x join h y on x.h < y.h where bit_count(xor(x.v, y.v)) <= 5""",
    "semantic_cache": f"""with {_P}, a as (select sha256, model, count(distinct page_id) as n, min(page_id) as r from p where extracted_at < '2023-01-01' and page_id is not null group by 1, 2)
select extraction_id, case when coalesce(n, 0) = 0 then 'miss' when n = 1 then 'hit' else 'ambiguous' end as status, case when n = 1 then r end as result from p left join a using (sha256, model) where extracted_at >= '2023-01-01'""",
    "overlay_resolution": """with r as (select distinct on (correction_id) * from correction_records), s as (select correction_id, kind, scope, case
  when correction_id in (select supersedes_id from r where supersedes_id <> '' and supersedes_id <> correction_id) then 'superseded' when replacement is null or trim(replacement) = '' or scope is null then 'invalid' end as state from r),
n as (select kind, scope, count(*) as n from s where state is null group by 1, 2) select correction_id, coalesce(state, case when n > 1 then 'conflict' else 'active' end) as outcome from s left join n using (kind, scope)""",
    "correction_latest": "with c as (select distinct on (correction_id) * from correction_records) select kind, scope, arg_max(correction_id, (recorded_at, correction_id)) as correction_id, count(*) as records from c group by 1, 2",
    "impact_partition": f"{_IMPACT} select node, impact from i",
    "execution_impact": f"""{_IMPACT}, h as (select node from i where impact = 'protected' union select record_id from record_dependencies), o as (select case when impact = 'affected' then 'regenerated' when impact in ('unaffected', 'protected') and node in (select node from h) then 'reused' end as outcome from i)
select outcome, count(*) as records from o where outcome is not null group by 1""",
    "dangling_links": "select distinct trim(supersedes_id) as correction_id from correction_records where trim(supersedes_id) <> '' and trim(supersedes_id) not in (select correction_id from correction_records)",
    "findings_rollup": """select case when event_type = 'signup' then 'review' when event_type = 'error' then 'failure' when value > 50 then 'uncertainty' else 'content' end as category, count(*) as findings, count(distinct user_id) as subjects from events group by 1""",
    "interval_union": """with r as (select event_type, epoch_us(ts) as a, epoch_us(ts) + floor(value)::bigint * 1000000 as b from events where ts is not null and value is not null and floor(value) >= 0),
f as (select *, (coalesce(a > max(b) over (partition by event_type order by a, b rows between unbounded preceding and 1 preceding), true))::int as n from r), s as (select *, sum(n) over (partition by event_type order by a, b rows between unbounded preceding and current row) as island from f),
i as (select event_type, island, min(a) as a, max(b) as b from s group by 1, 2) select event_type, count(*) as islands, sum(b - a)::bigint as total from i group by 1""",
}
