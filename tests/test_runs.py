import json

import pytest
from pyspark.sql import functions as F

from pagelake import config
from pagelake.operators import corrections, effective, responses, stages


def test_parse_pages(spark):
    block = {"id": "a", "type": "paragraph", "text": "x", "reading_order": 0}
    page = lambda *b, **more: json.dumps({"blocks": list(b), **more})
    cases = {
        "ok": page(block, source_lang="en"), "fenced": "```json\n" + page(block) + "\n```", "not_json": "{", "null": None, "unknown_field": page(block, foo=1), "missing_field": "{}",
        "block_fields": page({**block, "x": 1}), "block_type": page({**block, "type": "odd"}), "block_id": page(block, {**block, "reading_order": 1}), "block_order": page({**block, "reading_order": -1}), "empty": page(),
    }
    df = spark.createDataFrame(list(cases.items()), "k string, r string")
    got = {r.k: r for r in responses.parse_pages(df, "k", "r").collect()}
    faults = {k: r.fault for k, r in got.items()}
    assert faults == {k: None if k in ("ok", "fenced", "empty") else "not_json" if k == "null" else k for k in cases}
    assert got["ok"].page.blocks[0].text == "x" and got["ok"].page.source_lang == "en" and got["block_id"].page is None


def test_entries_are_checked(spark):
    c = spark.createDataFrame([("g", "x", 0), ("g", "y", 1), ("h", "z", 0), ("i", "q", 0)], "g string, form string, tier int")
    e = spark.createDataFrame([("g", "x"), ("g", "y"), ("h", "z"), ("h", "z"), ("i", "other")], "g string, form string")
    checked = responses.check_entries(e, c, "g", "form")
    assert {r.g: r.accepted for r in checked.collect()} == {"g": True, "h": False, "i": False}
    assert sorted(r.form for r in responses.fallback(c, checked, "g").collect()) == ["q", "z"]


def test_effective(spark):
    s = spark.createDataFrame([(1, "a", "en"), (2, "b", None), (3, "c", "fr")], "k int, text string, lang string")
    t = spark.createDataFrame([(1, "A", "de"), (1, "A", "de"), (2, " ", "de")], "k int, translated_text string, target_lang string")
    assert [(r.effective_text, r.render_lang, r.mode) for r in effective.effective_segments(s, None, ["k"], "lang").orderBy("k").collect()] == [("a", "en", "native"), ("b", "und", "native"), ("c", "fr", "native")]
    assert [(r.effective_text, r.render_lang, r.mode) for r in effective.effective_segments(s, t, ["k"], "lang").orderBy("k").collect()] == [("A", "de", "translated"), (None, "und", "diagnostic"), (None, "und", "diagnostic")]
    m = spark.createDataFrame([("ab ab cd", ["ab", "cd", "ab", "ab"])], "t string, w array<string>").select(effective.target_spans(F.col("t"), F.col("w"))).first()[0]
    assert [(x.target, x.start, x.end) for x in m] == [("ab", 0, 2), ("cd", 6, 8), ("ab", 3, 5), ("ab", -1, -1)]
    v = spark.createDataFrame([("x", "1"), ("x", "2"), ("x", "2"), ("y", "1")], "b string, v string")
    assert sorted(r.name for r in effective.variant_names(v, ["b"], "v").collect()) == ["x#1", "x#2", "y"]
    p = spark.createDataFrame([("a/b.jpg",), ("/a",), ("a//b",), ("../a",), ("a\\b",), ("",), (None,)], "p string")
    assert [r[0] for r in p.select(effective.safe_path(F.col("p"))).collect()] == [True] + [False] * 6


def test_correction_grammar_and_transitions():
    good = {"kind": "source_text", "scope": {"segment_id": "s"}, "base": {}, "replacement": "x"}
    assert corrections.parse(json.dumps(good)) == good
    for bad in ({**good, "kind": "no"}, {**good, "scope": {"x": 1}}, {**good, "more": 1}, {**good, "replacement": "e\u0301"}, [1]):
        with pytest.raises(corrections.Invalid):
            corrections.parse(json.dumps(bad))
    for raw in ("{", '{"kind":"a","kind":"b"}'):
        with pytest.raises(corrections.Invalid):
            corrections.parse(raw)
    a, b = corrections.correction_id(good), corrections.correction_id(good, "x" * 64)
    assert a != b == corrections.correction_id(dict(reversed(good.items())), "x" * 64)
    active, events = corrections.transition(set(), [], "r", "apply", a)
    active, events = corrections.transition(active, events, "r", "supersede", b, a)
    assert active == {b} and len(set(events)) == 2
    with pytest.raises(corrections.Invalid):
        corrections.transition(active, events, "r", "revert", a)
    assert corrections.transition(active, events, "r", "revert", b)[0] == set()
    assert corrections.set_id("r", [a, b], []) == corrections.set_id("r", [b, a, a], [])


def test_stages_report_and_go_on(spark, tmp_path):
    base = {"x": spark.range(3).toDF("n")}
    ok = stages.Stage("double", ("x",), ("y",), lambda x: {"y": x.select((F.col("n") * 2).alias("n"))})
    bad = stages.Stage("bad", ("y",), ("z",), lambda y: {"other": y})
    after = stages.Stage("after", ("z",), ("w",), lambda z: {"w": z})
    have, report = stages.run_stages(spark, [ok, bad, after], base, str(tmp_path))
    assert [s["status"] for s in report.stages] == ["ok", "failed", "skipped"] and report.status == "degraded"
    assert sorted(r.n for r in have["y"].collect()) == [0, 2, 4] and json.loads(report.to_json())["mode"] == "native"
    assert stages.union_ns([(0, 5), (3, 7), (7, 8), (10, 11)]) == 9 and stages.union_ns([]) == 0


def test_config():
    assert config.load([], {}).concurrency == 4
    assert config.load([], {"PAGELAKE_CONCURRENCY": "8"}).concurrency == 8
    assert config.load(["--concurrency", "2"], {"PAGELAKE_CONCURRENCY": "8"}).concurrency == 2
    with pytest.raises(ValueError):
        config.load(["--retries", "9"], {})
