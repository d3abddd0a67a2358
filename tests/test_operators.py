import io
import json
import os
import random
import re
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from pagelake.functions import canon, ids
from pagelake.operators import corpus, graph, intervals, memo, models, overlays, quality, render, similar, terms
from pagelake.plans import terminology
from pagelake.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_canonical_forms(spark):
    df = spark.createDataFrame([("é\r\nx", ' {"b": 1, "a": "é"}'), (None, None), ("", "{"), ("Ａ  b", '{"a": NaN}')], "t string, j string")
    got = df.select(canon.nfc("t"), canon.canonical_json("j"), canon.term_key("t")).collect()
    assert [r[0] for r in got] == ["é\nx", None, "", "Ａ  b"]
    assert [r[1] for r in got] == ['{"a":"é","b":1}', None, None, None]
    assert got[3][2] == "a b"


def test_ids_change_with_each_input_only(spark):
    df = spark.createDataFrame([("aa" * 32, "p", "x"), ("aa" * 32, "q", "x"), ("bb" * 32, "p", "x")], "h string, p string, t string")
    got = df.select(ids.page_id(F.col("h")), ids.placement_id(ids.page_id(F.col("h")), F.col("h"), F.col("p")), ids.semantic_key("k", F.col("h"), F.col("p")), ids.anchor(F.col("p"), F.lit(1), F.col("t"))).collect()
    assert got[0][0] == got[1][0] != got[2][0]
    assert len({r[1] for r in got}) == len({r[2] for r in got}) == 3
    assert all(re.fullmatch("[0-9a-f]{64}", x) for r in got for x in r)
    import hashlib

    assert got[0][0] == hashlib.sha256(b"page-v1\0" + b"\xaa" * 32).hexdigest()


def test_golden_ids(spark):
    """The recipes, computed a second time from the bytes."""
    import hashlib

    def h(tag, *parts):
        return hashlib.sha256(b"\0".join([tag.encode(), *[p if isinstance(p, bytes) else p.encode() for p in parts]])).hexdigest()

    def j(x):
        return json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    text, path = 'a "q" \\ é\n日', "p/é.jpg"
    df = spark.createDataFrame([("ab" * 32, text, path, ["b", "a", "b"])], "h string, t string, p string, ids array<string>")
    c = F.col
    got = df.select(
        ids.placement_id(c("t"), c("h"), c("p")), ids.book_id(c("ids")), ids.anchor(F.lit("quote"), F.lit(3), c("t")), ids.segment_id(c("h"), c("t")), ids.occurrence_id(c("h"), F.lit(1), F.lit(4), c("t")), ids.concept_id(F.lit("en"), c("t"), c("ids")),
        ids.artifact_id(F.lit("K"), F.lit('{"x":1}'), c("ids")), ids.edge_id(c("h"), F.lit("p"), F.lit("c"), F.lit("s"), F.lit("k")), ids.attestation_id(c("h"), F.lit("K"), F.lit("key"), c("ids")),
    ).first()
    assert list(got) == [
        h("placement-v1", text, bytes.fromhex("ab" * 32), path), h("book-v1", j(["a", "b"])), h("anchor-v1", j(["quote", 3, text, {}])), h("segment-v1", "ab" * 32, text), h("occurrence-v1", "ab" * 32, "1", "4", text), h("concept-v1", j(["en", text, ["a", "b"]])),
        h("artifact-v1", j({"schema_version": "schema-v1", "kind": "K", "payload": {"x": 1}, "dependency_ids": ["a", "b"]})),
        h("dependency-edge-v1", j({"schema_version": "schema-v1", "stable_subject_id": "ab" * 32, "parent_artifact_id": "p", "child_artifact_id": "c", "stage": "s", "edge_kind": "k"})),
        h("artifact-semantic-attestation-v1", j({"artifact_id": "ab" * 32, "kind": "K", "semantic_key": "key", "dependency_ids": ["a", "b"]})),
    ]


def test_language_heuristic(spark):
    df = spark.createDataFrame([("the cat and the dog",), ("le la les",), ("あ漢",), ("漢",), ("",), (None,), ("zzz",), ("de la",)], "t string")
    assert [r[0] for r in df.select(canon.detect_language(F.col("t"))).collect()] == ["en", "fr", "ja", "zh", None, None, None, "fr"]


def test_term_positions(spark):
    df = spark.createDataFrame([("a key, keys; keyé key", "key"), ("x.y x.y", "x.y"), ("\\E \\E", "\\E"), ("", "a"), ("aaa", "")], "t string, w string")
    assert [r[0] for r in df.select(canon.term_positions(F.col("t"), F.col("w"))).collect()] == [[2, 18], [0, 4], [0, 3], [], []]


def test_segments_and_pages(spark):
    b = spark.createDataFrame(
        [(1, 0, "a", "paragraph", "x", 0), (1, 1, "b", "paragraph", "x", 0), (1, 2, "c", "illustration", "pic", 1), (2, 0, "a", "odd", "x", 0), (3, 0, "a", "quote", "x", 0), (3, 1, "b", "quote", "y", 0), (4, 0, "a", "quote", None, 0)],
        "p int, item int, block_id string, type string, text string, reading_order int",
    )
    s = corpus.segments(b, "p", F.concat_ws("|", "type", "text", "reading_order"))
    assert sorted((r.p, r.kind, r.placements, r.diagnostic) for r in s.collect()) == [(1, "paragraph", 2, False), (2, "diagnostic", 1, True), (3, "diagnostic", 1, True), (4, "diagnostic", 1, True)]
    assert rows(corpus.page_texts(b, "p", "/")) == [(1, "x/x"), (2, "x"), (3, "x/y")]
    faults = {(r.p, r.rule): r.n for r in quality.block_schema(b, "p").collect()}
    assert faults == {(1, "duplicate_order"): 1, (2, "unsupported_type"): 1, (3, "duplicate_order"): 1, (4, "empty_text"): 1}


def test_neighbours_leave_out_but_do_not_skip(spark):
    b = spark.createDataFrame([("k", 1, "a", True), ("k", 2, "b", False), ("k", 3, "c", True), ("m", 1, "d", True)], "book string, o int, t string, ok boolean")
    got = corpus.neighbours(b, "book", ["o"], F.col("t"), F.col("ok")).select("t", "previous", "following")
    assert sorted(got.collect()) == [("a", None, None), ("b", "a", "c"), ("c", None, None), ("d", None, None)]


def test_reconcile_and_missing(spark):
    now = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "i int, sha string")
    old = spark.createDataFrame([("p", "x"), ("p", "x"), ("q", "y"), ("r", "y"), ("s", None)], "page string, sha string")
    assert sorted((r.i, r.status, r.known_id) for r in corpus.reconcile(now, old, "sha", "page").collect()) == [(1, "reused", "p"), (2, "ambiguous", None), (3, "new", None), (4, "new", None)]
    assert rows(corpus.dedupe(spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "k int, v string"), "k", "v")) == [(1, "a"), (2, None)]


def test_runs_phrases_technical(spark):
    t = spark.createDataFrame([(1, "Old Tom Bee met A B C D E F G. Ann"), (2, "red sea-wall MK_3 and/or ABC b2"), (3, "the red sea-wall"), (4, None), (5, "")], "i int, text string")
    assert rows(terms.name_runs(t, ["i"])) == [(1, 0, 3, "Old Tom Bee")]
    assert {r.phrase for r in terms.phrases(t, ["i"]).collect()} == {"red sea", "sea wall", "red sea wall"}
    assert {(r.word, r.kind) for r in terms.technical_words(t, ["i"]).where("i = 2").collect()} == {("MK_3", "identifier"), ("b2", "identifier"), ("ABC", "capitals"), ("sea-wall", "compound"), ("and/or", "compound")}


def test_candidates_keep_tier_zero(spark):
    c = spark.createDataFrame([("b", f"k{i}", 0 if i < n else 1 + i % 3, f"f{i}", [str(i)], None) for b, n in (("b", 2),) for i in range(9)], "book string, key string, tier int, form string, blocks array<string>, occurrences array<string>")
    m = terms.merge_candidates(c.union(c), ["book", "key"])
    assert m.count() == 9
    top = terms.top_candidates(m, "book", "key", 4).collect()
    assert len(top) == 4 and sum(r.tier == 0 for r in top) == 2
    only = terms.top_candidates(m, "book", "key", 1).collect()
    assert [r.tier for r in only] == [0, 0]


def test_greedy_batches(spark):
    rng = random.Random(1)
    data = [(g, i, rng.randrange(1, 60)) for g in "ab" for i in range(40)] + [("a", 50, 500)]
    got = {(r.g, r.i): r.batch for r in terms.greedy_batches(spark.createDataFrame(data, "g string, i int, s int"), "g", "i", "s", 100).collect()}
    for g in "ab":
        used, batch = 0, 0
        for _, i, s in sorted(x for x in data if x[0] == g):
            if used and used + s > 100:
                used, batch = 0, batch + 1
            used += s
            assert got[g, i] == batch


def test_terms_in_texts_by_brute_force(spark):
    t = spark.createDataFrame([("b", 1, "Sea wall"), ("b", 2, "wall"), ("b", 3, None), ("b", 4, "!"), ("c", 5, "sea")], "book string, g int, term string")
    x = spark.createDataFrame([("b", 1, "A sea WALL here"), ("b", 2, "seawall"), ("c", 3, None)], "book string, i int, text string")
    assert rows(terms.terms_in_texts(t, x, "book", "term", "text", ["i"]).select("g", "i")) == [(1, 1), (2, 1)]


def test_terms_in_texts_gathers_nothing_in_the_driver(spark, tmp_path):
    """Tables of small files hold many words; Spark would broadcast them by the size of the files."""
    spark.createDataFrame([("b", 1, "Sea wall"), ("b", 2, "wall"), ("b", 3, "a sea")], "book string, g int, term string").write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([("b", 1, "A sea WALL here"), ("b", 2, "a wall, a sea")], "book string, i int, text string").write.parquet(f"{tmp_path}/x")
    hit = terms.terms_in_texts(spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/x"), "book", "term", "text", ["i"]).select("g", "i")
    assert "Broadcast" not in hit._jdf.queryExecution().executedPlan().toString()
    assert rows(hit) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2)]


def test_missing_term_broadcasts_repeated_ids_only(spark, data):
    plan = terminology.missing_term(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert all("extraction_id" in x.split("],")[0] and "[_" not in x for x in plan.splitlines() if "BroadcastHashJoin" in x)
    assert "group_id" in plan and "BroadcastNestedLoopJoin" not in plan


def test_scoped_gathers_nothing_in_the_driver(spark, tmp_path):
    spark.createDataFrame([(1, ["a", "b"]), (2, ["c", None]), (3, [None]), (4, None), (5, ["b", "b"])], "id int, s array<string>").write.parquet(f"{tmp_path}/r")
    spark.createDataFrame([(["b", "x", None],), (["b"],)], "t array<string>").write.parquet(f"{tmp_path}/t")
    got = overlays.scoped(spark.read.parquet(f"{tmp_path}/r"), "s", spark.read.parquet(f"{tmp_path}/t").select(F.explode("t").alias("t")), "t").select("id")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == [(1,), (5,)]


@pytest.mark.parametrize("radius", [0, 3, 5])
def test_near_hashes_are_exact(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(12)]
    for v in list(base):
        for n in range(1, 8):
            w = v
            for b in rng.sample(range(64), n):
                w ^= 1 << b
            base.append(w)
    hashes = [f"{v:016x}" for v in base]
    want = {(a, b) for a in set(hashes) for b in set(hashes) if a < b and bin(int(a, 16) ^ int(b, 16)).count("1") <= radius}
    df = spark.createDataFrame([(h,) for h in [*hashes, hashes[0], "", "xyz"]] + [(None,)], "phash string")
    assert {(r.a, r.b) for r in similar.near_hashes(df, "phash", radius).collect()} == want


def test_interval_union(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 2, 4), ("a", 9, 9), ("a", 11, 12), ("b", 5, 4), ("b", None, 4)], "k string, s long, e long")
    assert rows(intervals.union_total(df, "k", "s", "e")) == [("a", 3, 5)]


def test_overlays(spark):
    c = spark.createDataFrame(
        [("1", "t", "s1", "x", None), ("2", "t", "s1", "y", "1"), ("3", "t", "s2", "x", None), ("4", "t", "s2", "z", None), ("5", "t", "s3", " ", None), ("6", "t", None, "z", ""), ("7", "t", "s7", "q", "7"), ("7", "t", "s7", "q", "7")],
        "correction_id string, kind string, scope string, replacement string, supersedes_id string",
    )
    assert rows(overlays.resolve(c)) == [("1", "superseded"), ("2", "active"), ("3", "conflict"), ("4", "conflict"), ("5", "invalid"), ("6", "invalid"), ("7", "active")]
    base = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    assert rows(overlays.apply_overlays(base, spark.createDataFrame([(1, "b")], "k int, replacement string"), "k", "t").select("k", "t", "overlaid").where("k = 1")) == [(1, "b", True)]
    s = spark.createDataFrame([("abcdef", [(1, 2, "XX"), (4, 6, "")])], "t string, e array<struct<start:int,end:int,replacement:string>>")
    assert s.select(overlays.splice(F.col("t"), F.col("e"))).first()[0] == "aXXcd"
    o = spark.createDataFrame([("g", 1, "a", ["x", "y"]), ("g", 2, "b", ["y"]), ("g", 3, "a", ["x"]), ("h", 4, "c", ["y"]), ("g", 5, None, ["y"])], "g string, i int, v string, s array<string>")
    assert rows(overlays.overlapping(o, ["g"], "i", "v", "s")) == [("g", 1, 2)]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "e"), (None, "x")], "parent string, child string")
    n = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    one = lambda x: spark.createDataFrame([(x,)], "node string")
    assert rows(graph.reach(e, one("a"))) == [("a",), ("b",), ("c",)]
    assert rows(graph.reach(e, one("e"), forward=False)) == [("d",), ("e",)]
    i = graph.impact(e, n, one("a"), one("c"), one("d"))
    assert rows(i) == [("a", "affected"), ("b", "affected"), ("c", "protected"), ("d", "ambiguous"), ("e", "unaffected")]
    assert rows(graph.execution(i, one("b"), n)) == [("a", "regenerated"), ("c", "reused"), ("e", "reused")]
    assert rows(graph.dangling(e, one("a"))) == [("b",), ("c",), ("d",), ("e",), ("x",)]


def test_memo_and_revisions(spark, tmp_path):
    old = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, body string")
    new = spark.createDataFrame([("2", "y"), ("3", "z"), ("3", "z")], "id string, body string")
    assert rows(memo.new_records(new, old, "id", "body")) == [("3", "z")]
    with pytest.raises(memo.Conflict):
        memo.new_records(spark.createDataFrame([("1", "other")], "id string, body string"), old, "id", "body")
    req = spark.createDataFrame([("k",), ("m",), ("n",)], "key string")
    att = spark.createDataFrame([("k", "r"), ("k", "r"), ("m", "a"), ("m", "b")], "key string, res string")
    assert sorted((r.key, r.status, r.result) for r in memo.lookup(req, att, ["key"], "res").collect()) == [("k", "hit", "r"), ("m", "ambiguous", None), ("n", "miss", None)]
    folder = str(tmp_path / "rev")
    assert memo.seal(old, folder, "r1", "id", "body") == memo.manifest(old.repartition(3), "id", "body").first()["hash"]
    assert memo.verify(spark, folder, "r1", "id", "body")
    spark.createDataFrame([("9", "evil")], "id string, body string").write.mode("append").parquet(f"{folder}/revision=r1/members")
    assert not memo.verify(spark, folder, "r1", "id", "body")
    pointer = str(tmp_path / "active.json")
    assert memo.active(pointer) is None
    memo.activate(pointer, "r1")
    assert memo.active(pointer) == "r1"


def test_rules_never_stop_the_job(spark):
    good = lambda: spark.createDataFrame([("s", "r", "info", "d")], quality.FINDING)

    def broken():
        raise RuntimeError("no")

    got = quality.run_rules(spark, {"good": good, "broken": broken}).collect()
    assert sorted((r.rule, r.severity) for r in got) == [("broken", "error"), ("r", "info")]
    a = spark.createDataFrame([(1, "x"), (1, "y")], "p int, b string")
    b = spark.createDataFrame([(1, "y"), (1, "y"), (1, "z")], "p int, b string")
    assert rows(quality.correspondence(a, b, ["p", "b"])) == [(1, "x", "missing"), (1, "y", "duplicate"), (1, "z", "extra")]


def test_models_fall_back(spark):
    def client(r):
        if r == "bad":
            raise ValueError("no")
        return r.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "k int, r string")
    got = models.call_models(df, "k", "r", client, retries=1, concurrency=2, wait=lambda n: 0)
    assert sorted((r.k, r.result, r.status, r.attempts) for r in got.collect()) == [(1, "A", "ok", 1), (2, None, "fallback", 2), (3, None, "skipped", 0)]
    assert [models.pause(i) for i in range(6)] == [1, 2, 4, 8, 16, 16]


def test_render_is_deterministic(spark, tmp_path):
    b = spark.createDataFrame([("k", 1, 0, "heading", "A & B", 0, "en"), ("k", 1, 1, "paragraph", "<x>", 1, "en"), ("k", 2, 0, "illustration", "p", 0, None), ("k", 3, 0, "quote", "q\x01", 0, None)], "book string, page int, item int, type string, text string, reading_order int, lang string")
    x = render.xhtml(b, ["book", "page"], "lang")
    assert rows(x) == [("k", 1, '<body lang="en"><h2>A &amp; B</h2><p>&lt;x&gt;</p></body>'), ("k", 3, '<body lang="und"><blockquote>q�</blockquote></body>')]
    got = render.books(x.withColumn("lang", F.lit("en")), "book", "page", str(tmp_path), "lang").collect()
    assert [(r.book, r.pages) for r in got] == [("k", 2)]
    first = open(got[0].path, "rb").read()
    with zipfile.ZipFile(io.BytesIO(first)) as z:
        assert z.namelist() == ["mimetype", "META-INF/container.xml", "page-1.xhtml", "page-3.xhtml", "nav.xhtml", "provenance.json", "book.opf"]
        told = json.loads(z.read("provenance.json"))
        assert [p["name"] for p in told["pages"]] == ["page-1", "page-3"] and b"<dc:language>en</dc:language>" in z.read("book.opf") and b"dcterms:modified" in z.read("book.opf")
        for n in z.namelist()[1:]:
            if n.endswith(("xhtml", "opf", "xml")):
                ElementTree.fromstring(z.read(n))
    again = render.books(x.withColumn("lang", F.lit("en")), "book", "page", f"file://{tmp_path}/again", "lang").collect()
    assert [r.pages for r in again] == [2] and sorted(p.name for p in (tmp_path / "again").iterdir()) == ["k.epub"]
    assert render.epub_bytes("t", [("a", "<body/>")]) == render.epub_bytes("t", [("a", "<body/>")])


def test_sources_and_stream(spark, tmp_path):
    from pagelake.streaming import discovery

    folder = tmp_path / "in"
    folder.mkdir()
    for n, c in (("2.jpg", b"x"), ("1.png", b"y"), ("3.JPEG", b"x"), ("no.txt", b"z")):
        (folder / n).write_bytes(c)
    images = files.page_images(spark, str(folder))
    assert images.count() == 3 and images.select("page_id").distinct().count() == 2 and images.select("placement_id").distinct().count() == 3
    assert rows(files.manifest(images)) == [(1, "1.png"), (2, "2.jpg"), (3, "3.JPEG")]
    assert files.state_size(spark, str(folder)).first() == (4, 4)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    discovery.discover(discovery.page_stream(spark, str(folder)), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    (folder / "4.jpg").write_bytes(b"new")
    (folder / "5.jpg").write_bytes(b"y")
    # a file may be of any age
    (folder / "6.jpg").write_bytes(b"old")
    os.utime(folder / "6.jpg", (1_000_000_000, 1_000_000_000))
    discovery.discover(discovery.page_stream(spark, str(folder)), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == spark.read.parquet(out).select("page_id").distinct().count() == 4
    case = tmp_path / "cases" / "case_1"
    case.mkdir(parents=True)
    (case / "config.json").write_text(json.dumps({"name": "one", "expected": {"block_schema": True}, "risk_tags": ["t"]}))
    assert files.validation_cases(spark, str(tmp_path / "cases")).first()["name"] == "one"
