"""Corrections from apply to supersede in a store, consolidation in rounds, selections, closures and rules."""

import json

import pytest
from pyspark.sql import functions as F

from pagelake.functions import canon
from pagelake.operators import corpus, corrections, memo, quality, selection, stages, terms


def payload(segment, text, artifact="a1"):
    return json.dumps({"kind": "source_text", "scope": {"segment_id": segment}, "base": {"artifact_id": artifact}, "replacement": text})


def test_correction_life_cycle(spark, tmp_path):
    store = str(tmp_path / "store")
    arts = spark.createDataFrame([("a1",)], "artifact_id string")
    ident = lambda raw, over=None: corrections.correction_id(corrections.parse(raw), over)
    one = payload("s1", "x")
    first = corrections.publish(spark, store, "r1", "apply", one, artifacts=arts)
    assert memo.active(f"{store}/active_set", spark) == first
    two = payload("s1", "y")
    second = corrections.publish(spark, store, "r1", "supersede", two, supersedes=ident(one), artifacts=arts)
    row = spark.read.parquet(f"{store}/sets").where(F.col("set_id") == second).first()
    assert row.active == [ident(two, ident(one))] and len(row.events) == 2
    # not allowed: nothing is written and the pointer stays
    for kind, raw, more in (("apply", payload("s2", "z", "gone"), {}), ("apply", payload("s1", "other"), {}), ("apply", "{", {}), ("revert", None, {"correction": "nobody"}), ("supersede", payload("s1", "w"), {"supersedes": "nobody"})):
        with pytest.raises(corrections.Invalid):
            corrections.publish(spark, store, "r1", kind, raw, artifacts=arts, **more)
    with pytest.raises(corrections.Invalid):
        corrections.publish(spark, store, "r2", "apply", payload("s3", "v"), artifacts=arts)
    assert memo.active(f"{store}/active_set", spark) == second and spark.read.parquet(f"{store}/records").count() == 2
    corrections.publish(spark, store, "r1", "revert", correction=ident(two, ident(one)), artifacts=arts)
    last = spark.read.parquet(f"{store}/sets").where(F.col("set_id") == memo.active(f"{store}/active_set", spark)).first()
    assert last.active == [] and len(last.events) == 3


def test_resolution_by_cases(spark):
    rows = [
        ("ok", "k", "s0", "a", "r", None), ("base", "k", "s1", "a", "other", None), ("gone", "k", "s2", "zz", "r", None), ("l1", "k", "s3", "a", "r", "l2"), ("l2", "k", "s3", "a", "r", "l1"),
        ("orphan", "k", "s4", "a", "r", "nowhere"), ("child", "k", "s5", "a", "r", "parent"), ("parent", "k", "s6", "a", "r", None), ("new", "k", "s7", "a", "r", "old"), ("old", "k", "s7", "a", "r", None),
        ("c1", "k", "s8", "a", "r", None), ("c2", "k", "s8", "a", "r", None),
    ]
    df = spark.createDataFrame([(i, k, s, json.dumps({"artifact_id": a}), r, o) for i, k, s, a, r, o in [*rows, rows[0]]], "correction_id string, kind string, scope string, base string, applies_to_revision_id string, supersedes_id string")
    active = spark.createDataFrame([(r[0],) for r in rows] + [("none",), (None,)], "correction_id string")
    got = {r.correction_id: r.outcome for r in corrections.resolve_set(df, active, "r", spark.createDataFrame([("a",)], "artifact_id string")).collect()}
    assert got == {
        "ok": "active", "base": "base_mismatch", "gone": "base_missing", "l1": "cycle", "l2": "cycle", "orphan": "ancestor_missing", "child": "ancestor_scope", "parent": "superseded", "new": "active", "old": "superseded",
        "c1": "conflict", "c2": "conflict", "none": "missing",
    }


def test_consolidation_must_shrink(spark):
    df = spark.createDataFrame([("b", i, f"g{i:02}", 40) for i in range(12)], "book string, id int, name string, size int")

    def halve(batched):
        return batched.groupBy("book", "batch").agg(F.min("id").alias("id"), F.min("name").alias("name"), F.min("size").alias("size"))

    got, rounds = selection.consolidate(df, "book", "id", "size", 100, halve)
    assert rounds == [(6, 12, 480), (3, 6, 240), (2, 3, 120), (1, 2, 80)] and got.count() == 1
    with pytest.raises(selection.NoProgress):
        selection.consolidate(df, "book", "id", "size", 100, lambda b: b)
    with pytest.raises(selection.NoProgress):
        selection.consolidate(df, "book", "id", "size", 100, halve, rounds=2)
    assert selection.consolidate(df.limit(0), "book", "id", "size", 100, halve)[0].isEmpty()


def test_selections(spark):
    e = spark.createDataFrame([(["b", "a"], 2, 1, "x"), (["a", "b", "a"], 1, 9, "y"), (["c"], 3, 3, "z"), (None, 0, 0, "n")], "forms array<string>, tier int, rank int, id string")
    assert sorted((tuple(r.forms), r.id, r.variants) for r in selection.winners(e, "forms", "tier", "rank", "id").collect()) == [(("a", "b"), "y", 2), (("c",), "z", 1)]
    old = spark.createDataFrame([("k", 1, "o"), ("m", 1, "p")], "k string, n int, v string")
    new = spark.createDataFrame([("k", 2, "q"), ("k", 3, "r"), ("l", 1, "s")], "k string, n int, v string")
    assert sorted(tuple(r) for r in selection.upsert(old, new, ["k"], "n").collect()) == [("k", 3, "r"), ("l", 1, "s"), ("m", 1, "p")]
    u = spark.createDataFrame([("a",), ("b",)], "node string")
    check = lambda *parts: tuple(selection.partition_check(spark.createDataFrame([(p,) for p in parts], "node string"), u, "node").first())
    assert check("a", "b") == (2, 2, 0, 0, 0, True) and check("a", "a") == (2, 1, 1, 1, 0, False) and check("a", "b", "c") == (2, 2, 0, 0, 1, False)
    twice = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z")], "id int, text string")
    assert sorted((r.id, r.text) for r in corpus.once(twice.where("id is not null"), "id").collect()) == [(1, "x"), (2, "y")]


def test_near_matches_give_the_first(spark):
    stored = spark.createDataFrame([("00000000000000ff", "m", "far"), ("0000000000000001", "m", "near"), ("0000000000000003", "m", "two"), ("0000000000000000", "other", "wrong"), ("0000000000000001", "m", "also")], "h string, model string, r string")
    asked = spark.createDataFrame([(1, "0000000000000000", "m"), (2, "ffffffffffffffff", "m"), (3, "00000000000000FF", "m"), (4, None, "m")], "id int, h string, model string")
    got = {r.id: (r.result, r.distance) for r in selection.first_near(asked, stored, "h", ["model"], "r").collect()}
    assert got == {1: ("also", 1), 3: ("far", 0)}


def test_closure_over_artifacts_and_findings(spark):
    d = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("s", "t")], "artifact string, needs string")
    f = spark.createDataFrame([("b", "f1", "s"), ("t", "f2", "t"), ("x", "f3", "x")], "artifact string, finding string, subject string")
    got = sorted((r.id, r.what) for r in selection.two_relation_closure(d, f, spark.createDataFrame([("a",), (None,)], "artifact string")).collect())
    assert got == [("a", "artifact"), ("b", "artifact"), ("c", "artifact"), ("f1", "finding"), ("f2", "finding"), ("s", "artifact"), ("t", "artifact")]


def test_variants_and_blanks(spark):
    cases = [("Two ponies ran.", "pony", True), ("The lamps' light", "lamp", True), ("boxes", "box", True), ("lampshade", "lamp", False), ("keyies", "key", False), ("eine Mühle.", "mühle", True), (None, "x", False), ("x", "", False)]
    df = spark.createDataFrame([(t, w) for t, w, _ in cases], "t string, w string")
    assert [r[0] for r in df.select(canon.contains_variant(F.col("t"), F.col("w"))).collect()] == [ok for _, _, ok in cases]
    b = spark.createDataFrame([(None,), ("",), (" \t\n",), ("　\xa0",), ("x",)], "t string")
    assert [r[0] for r in b.select(canon.blank(F.col("t"))).collect()] == [True] * 4 + [False]


def test_rules_run_once_and_break_alone(spark):
    ran = []

    def good():
        ran.append(1)
        return spark.createDataFrame([("s", "good", "info", "d")], quality.FINDING)

    def bad():
        raise ValueError("no")

    got = quality.run_rules(spark, {"good": good, "bad": bad})
    assert sorted((r.rule, r.severity) for r in got.collect()) == [("bad", "error"), ("good", "info")] and ran == [1]


def test_phrases_of_long_texts_and_any_separator(spark):
    long = " ".join(f"w{i % 50}" for i in range(20_000))
    df = spark.createDataFrame([("b", 1, "One two, three"), ("b", 2, "one two; three"), ("b", 3, long), ("b", 4, None)], "book string, i int, text string")
    plain = {(r.phrase, r["size"]) for r in terms.phrases(df, ["i"], within="book").collect()}
    assert plain == {("one two", 2)}
    loose = {(r.phrase, r["size"]) for r in terms.phrases(df, ["i"], within="book", joins="").collect()}
    assert loose == {("one two", 2), ("two three", 2), ("one two three", 3)}


def test_a_run_from_pages_to_a_revision(spark, tmp_path):
    p = spark.createDataFrame([(1, "b", 1, "en", [("a", "paragraph", "The lamp and the mill.", 0)]), (2, "b", 2, "en", [("a", "paragraph", " ", 0)])], "extraction_id long, book_id string, page_number int, source_lang string, blocks array<struct<id string, type string, text string, reading_order int>>")
    have, report = stages.run_stages(spark, [*stages.core(), *stages.tail(str(tmp_path / "out"), "rev-1")], {"pages": p}, str(tmp_path / "work"))
    assert report.status == "ok" and [s["stage"] for s in report.stages] == ["segments", "terms", "effective", "checks", "render", "seal"]
    assert have["segments"].count() == 2 and {r.rule for r in have["findings"].collect()} == {"non_empty_text"} and have["book_files"].first().pages == 1
    assert memo.verify(spark, str(tmp_path / "out"), "rev-1", "id", "content") and memo.active(str(tmp_path / "out" / "active"), spark) is None
    empty, report = stages.run_stages(spark, stages.core(), {"pages": p.limit(0)}, str(tmp_path / "none"))
    assert report.status == "ok" and [r.status for r in empty["run_status"].collect()] == ["empty_input"]
