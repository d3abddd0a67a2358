"""Look-alikes, scans, names, languages and pairs: brute force, fixed cases and held-out accuracy."""

import random
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagelake.llm import editor, language, lookalikes, names, pairs, scans


def test_shape_and_candidates():
    assert lookalikes.shape("Ｆｕｌｌ　ｗｉｄｔｈ") == "Full width"
    assert lookalikes.shape("é​­x‑y z") == "éx-y z"
    assert lookalikes.shape("ﬁlter Ⅱ") == "filter II" and lookalikes.shape("x²") == "x²" and lookalikes.shape("ı") == "ı"
    assert lookalikes.shape("ｶﾞ夕ー") == "ガター" and lookalikes.shape("夕口") == "夕口"
    assert lookalikes.candidates("Bebеdo")[0] == "Bebedo"
    assert lookalikes.candidates("filter") == [] and "датчик" in [w.lower() for w in lookalikes.candidates("дaтчик")]


def test_same_look_pairs_by_brute_force(spark):
    forms = [(1, "b", "Bebedo filter"), (2, "b", "Bebеdo filter"), (3, "b", "bebedo filter"), (4, "b", "Bébedo filter"), (5, "b", "Bébedo filter"), (6, "c", "Bebеdo filter"), (7, "b", "Ｂebedo filter"), (8, "b", ""), (9, "b", None), (10, None, "x​"), (11, None, "x")]
    g = spark.createDataFrame([*forms, forms[0]], "group_id long, book string, form string")
    c = lookalikes.canonical_terms(g.withColumnRenamed("form", "term").withColumn("canonical", F.lit("clash")))
    got = {(r[0], r[1]) for r in lookalikes.same_look_pairs(g, c).collect()}
    # 1 and 3 differ in case only
    assert got == {(1, 2), (2, 3), (1, 7), (2, 7), (3, 7), (4, 5), (10, 11)}
    assert lookalikes.canonical_terms(g.where("1 = 0").withColumnRenamed("form", "term")).isEmpty()


def test_repair_needs_the_vocabulary(spark):
    t = spark.createDataFrame([("b", "Tоtо"), ("b", "other")], "book string, term string")
    assert {r.term: r.canonical for r in lookalikes.canonical_terms(t).collect()}["Tоtо"] == "Tоtо"
    t = t.union(spark.createDataFrame([("d", "toto")], "book string, term string"))
    assert {r.term: r.canonical for r in lookalikes.canonical_terms(t).collect()}["Tоtо"] == "Toto"


def test_operations_turn_what_was_read_into_what_is_true():
    for true, read in editor.PAIRS:
        assert editor.apply(f"x{read}y", editor.operations(true, read, 1)) == f"x{true}y"
    assert {o[0] for t, r in editor.PAIRS for _, o in editor.operations(t, r)} == {"R", "D", "I"}
    rng = random.Random(2)
    for w in ("northern", "dictionary", "million", "1881"):
        for edits in (1, 2):
            made = editor.noise(w, rng, edits)
            if made:
                assert made[0] != w and editor.apply(*made) == w and w in {v for v, _, _ in editor.readings(made[0])}
    assert list(editor.readings("")) == []


KNOWN = ["northern", "library", "expedition", "garden", "measured", "inventory", "dictionary", "mountain", "instrument", "company", "letters", "weather", "compared", "described", "translator", "committee", "river", "winter", "modern", "corner", "return"]


def _told(e, read, true, n, known):
    """What is chosen for ``read`` if the corpus has it n times and ``true`` known times."""
    return e.margin(read, editor.restoring(read, true, 1), editor.evidence(n, n, False, 1, known, known, 5, known, n)) > 0


def test_editor_restores_held_out_words_and_keeps_real_ones():
    e = editor.Editor()
    held = [("rnountain", "mountain"), ("gardcner", "gardener"), ("inventorics", "inventories"), ("weathercd", "weathered"), ("cornpanies", "companies"), ("winteis", "winters"), ("diedared", "dieclared")]
    held = [(r, t) for r, t in held if t in {v for v, _, _ in editor.readings(r)}]
    assert len(held) >= 5
    # without training nothing is taken
    assert not any(_told(e, r, t, 1, 900) for r, t in held)
    two = [("modem", "modern"), ("com", "corn"), ("bear", "hear"), ("form", "farm"), ("cat", "eat")]
    kept = []
    for a, b in two:
        for x, y in ((a, b), (b, a)):
            for v, n, _ in editor.readings(x):
                if v == y:
                    kept += [(x, editor.restoring(x, y, n), editor.evidence(k, k, False, n, m * k, m * k, 5, k, k)) for k in (3, 30, 300) for m in (1, 2, 3)]
    e.fit_words([(w, 900, 880, 5) for w in KNOWN] * 3, kept)
    assert all(_told(e, r, t, 1, 900) for r, t in held)
    assert not _told(e, "modem", "modern", 300, 310) and not _told(e, "bear", "hear", 100, 90)


def test_joins_and_lines_without_training_are_not_taken(spark):
    e = editor.Editor()
    assert e.join_margin("wea", "-", "ther", ["wj"]) == 0 and e.lines.score(["lmarked"]) == 0
    joined = [("wea", "-", "ther"), ("lib", "-", "rary"), ("moun", "-", "tain"), ("let", "-", "ters"), ("com", "-", "pany")]
    own = [("well", "-", "known"), ("half", "-", "open"), ("deep", "-", "sea"), ("long", "-", "lost"), ("hand", "-", "made")]
    e.fit_joins([(*x, ["wj"], ["p00", "m0"], True) for x in joined] + [(*x, ["wo"], ["p22", "m0"], False) for x in own])
    assert e.join_margin("gar", "-", "den", ["p00", "m0", "wj"]) > 0 > e.join_margin("old", "-", "world", ["p22", "m0", "wo"])


def test_scans(spark):
    page = "The northern library kept the weather record and the inventory of the garden."
    texts = [("p", i, 0, "b", i, "paragraph", False, page) for i in range(1, 31)]
    texts += [("p", 40 + i, 0, f"c{i % 4}", i, "paragraph", False, page) for i in range(20)]
    cases = {
        100: ("The nortbern library kept the wea-\nther record of the long garden here.", {"misread", "hyphen"}),
        101: ("THE OLD GARDEN   7\nThe library kept the record.", {"header", "page_number"}),
        102: ("- 102 -", {"page_number"}),
        103: ("The library kept a well-\nknown record. A well-known one.", set()),
        104: ("", set()),
        105: (None, set()),
        106: ("It was kept in 1847. (1847)", set()),
    }
    # what the lines are learnt from: headers that other books repeat, lines within blocks, numbers of pages
    sure = {300 + i: (f"THE LONG RIVER   {300 + i}\nThe library kept the record.", {"header", "page_number"}) for i in range(5)} | {310 + i: (f"- {310 + i} -", {"page_number"}) for i in range(3)}
    plain = {320 + i: (f"The widow number {'abcdefgh'[i]}\nOf the garden kept the record of the weather.", set()) for i in range(6)}
    cases |= sure | plain
    texts += [("p", k, 0, "b", 7 if k == 101 else k, "paragraph", False, t) for k, (t, _) in cases.items()]
    texts += [("p", 200 + i, 0, "b", 200 + i, "paragraph", False, "A well-known record, well-known to all.") for i in range(5)]
    df = spark.createDataFrame([*texts, texts[0]], "record_table string, record_id long, item int, book string, page int, kind string, first boolean, text string")
    s = scans.Scan(df)
    got: dict = {}
    for r in s.defects().collect():
        got.setdefault(r.record_id, set()).add(r.defect)
    for k, (_, want) in cases.items():
        assert got.pop(k, set()) == want, k
    assert not got
    fixed = {r.record_id: r.text for r in scans.repaired(s).collect()}
    assert fixed[100] == "The northern library kept the weather record of the long garden here."
    assert fixed[101] == "The library kept the record." and fixed[103] == "The library kept a well-known record. A well-known one." and fixed[104] == "" and 105 not in fixed
    assert scans.Scan(df.where("1 = 0")).defects().isEmpty()


def _misread(spark, texts):
    df = spark.createDataFrame([("p", i, 0, b, i, "paragraph", False, t) for i, (b, t) in enumerate(texts)], "record_table string, record_id long, item int, book string, page int, kind string, first boolean, text string")
    s = scans.Scan(df)
    return {texts[r.record_id][1] for r in s.defects().where("defect = 'misread'").collect()}, {texts[r.record_id][1]: r.text for r in scans.repaired(s).collect()}


def test_misread_words_of_one_book(spark):
    """A form is damage however often one book has it; names of one book are none."""
    clean = "the fine record came from the garden of the northern library."
    texts = [(f"b{i % 5}", clean) for i in range(200)] + [(f"b{i % 5}", "so Elizabeth met Kamape there.") for i in range(60)]
    hot = [("hot", f"page {i}: it came frorn there.") for i in range(12)]
    corpus = [("", f"part {i}: the nortbern gate.") for i in range(3)]
    names = [("n", f"page {i}: then Tine met Komape and Eilzabeth here.") for i in range(10)]
    both = [("n", "Tine had a tine lamp.")]
    got, fixed = _misread(spark, texts + hot + corpus + names + both)
    assert got == {t for _, t in hot + corpus + both}
    assert fixed[both[0][1]] == "Tine had a fine lamp." and fixed[hot[0][1]] == "page 0: it came from there."


def test_the_editor_decides_names(spark):
    texts = [("n", "There came Rnasa.")] + [(f"b{i % 4}", "There came Masa.") for i in range(40)]
    rows = [("word", None, None, None, b, w.lower().strip("."), None, 1, int(w.islower()), None) for b, t in texts for w in t.split()]
    facts = spark.createDataFrame(rows, scans.FACTS)
    e, words = editor.Editor(), scans.vocabulary(facts)
    found = scans.word_readings(words, facts)
    assert scans.misread_words(found, e).isEmpty()
    e.words.weights = {"cr>Rm": 1.0}
    assert [tuple(r) for r in scans.misread_words(found, e).collect()] == [("rnasa", "masa", True)]


def test_edit_metric_and_near():
    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in "ab")
        assert names.levenshtein(a, b) == slow(a, b)
        swaps = {a[:i] + a[i + 1 : i + 2] + a[i : i + 1] + a[i + 2 :] for i in range(len(a))}
        assert names.near(a, b) == (slow(a, b) <= 1 or b in swaps)


def test_names(spark):
    same = [("Dr. Susannah Dokawick", "Dokawick, Sukey"), ("J Misoford", "Johannes Misoford"), ("JR Tisariworth", "Johannes R. Tisariworth"), ("DmitriKamamark", "Dmitri Kamamark"), ("Univ. of Nero, Fac. of Clock Making", "Faculty of Clock Making, University of Nero"), ("N.A.C.G.", "Neta Association of Comparative Grammar"), ("г-н Весути Т.", "Таса Весути"), ("コス・スドタ博士", "スドタ コス")]
    other = [("Dorothy J. Dokawick", "Susannah Dokawick"), ("Neta Association of Printing History", "Neta Association of Comparative Grammar"), ("J. P. Misoford", "Johannes R. Misoford"), ("Mikhail Tirihaven", "Edward Tirihaven")]
    same += [("R. Mitetastad Acad. of Tidal Res.", "Royal Acad. of Tidal Res. (Mitetastad)"), ("Royal Rirasaburg Academy of Salt Chemistry", "R. Riraaburg Academy of Salt Chemistry")]
    for a, b in same:
        assert names.same(names.Name(a), names.Name(b)) and names.same(names.Name(b), names.Name(a)), (a, b)
    for a, b in other:
        assert not names.same(names.Name(a), names.Name(b)) and not names.same(names.Name(b), names.Name(a)), (a, b)
    forms = [("b", 1, "Ann Misoford"), ("b", 2, "A. Misoford"), ("b", 3, "Misoford, Ann"), ("b", 4, "Carl Misoford"), ("b", 5, "Rori gauge"), ("b", 6, "Rori-gauge"), ("b", 7, None), ("b", 8, " "), ("c", 9, "Ann Misoford"), ("b", 10, "Ann Misofrod"), (None, 11, "Bo Lee Tan")]
    labelled = [("b", "Rori gauge", "technical_term"), ("b", "Tema gauge", "technical_term"), ("b", "Ann Misoford", "proper_name"), ("b", None, None)]
    f = spark.createDataFrame([*forms, forms[0]], "book string, id long, form string")
    sets: dict = {}
    for r in names.name_sets(f, spark.createDataFrame(labelled, "book string, form string, category string")).collect():
        sets.setdefault((r.book, r.root), set()).add(r.id)
    assert sorted(map(sorted, sets.values())) == [[1, 2, 3, 10], [4], [9], [11]]
    assert names.name_sets(f.where("1 = 0"), spark.createDataFrame([], "book string, form string, category string")).isEmpty()


def test_ambiguous_initials_join_no_one(spark):
    f = spark.createDataFrame([("b", 1, "Anna Misoford"), ("b", 2, "Alice Misoford"), ("b", 3, "A. Misoford")], "book string, id long, form string")
    s = names.name_sets(f, spark.createDataFrame([], "book string, form string, category string"))
    assert s.select("root").distinct().count() == 3


def test_radius_join_misses_nothing(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(4, 7))) for _ in range(150)]
    df = spark.createDataFrame([("b", w) for w in words], "book string, word string")
    want = {(x, y) for x in set(words) for y in set(words) if x <= y and names.near(x, y)}
    for cell in (3, 20, 1_000):
        got = [(r.a, r.b) for r in names.meeting(df, cell).collect()]
        assert set(got) == want and len(got) == len(want)


def test_pairs_need_the_rarest_word_only(spark):
    """Names that share only a common given name do not meet; all that fit do."""
    rng = random.Random(7)
    given = ["john", "james", "william", "bill", "anna", "annie"]
    last = ["".join(rng.choice("aeioklmnrst") for _ in range(6)) for _ in range(40)]
    forms = sorted({f"{rng.choice(given)} {rng.choice(last)}".title() for _ in range(150)} | {f"{w}, Bill".title() for w in last[:9]} | {f"W. {w}".title() for w in last[:9]} | {"John", f"Anna{last[0].title()}"})
    t = next(names._parse(iter([pd.DataFrame({"book": "b", "form": forms})]))).assign(id=range(len(forms)))
    df = spark.createDataFrame([tuple(r) for r in t[["book", "id", "form", "keys"]].itertuples(index=False)], "book string, id long, form string, keys array<struct<word: string, role: string, of: string>>")
    got = {(r.form_a, r.form_b) for r in names.candidate_pairs(df).collect()}
    parsed = {f: names.Name(f) for f in forms}
    want = {(x, y) for i, x in enumerate(forms) for y in forms[i + 1 :] if names.same(parsed[x], parsed[y])}
    assert want <= got and len(got) < 0.2 * len(forms) ** 2 / 2


def test_long_names_do_not_stall():
    long = " ".join(f"Word{chr(97 + i)}ing" for i in range(14))
    assert names.same(names.Name(long), names.Name(" ".join(reversed(long.split()))))
    assert not names.same(names.Name(long), names.Name(long.replace("ing", "est")))


@pytest.fixture(scope="module")
def model(spark, data):
    return language.fit(language.texts_of(spark, data.replace("sf0.001", "sf0.01")))


@pytest.fixture(scope="module")
def ends(spark, data):
    t = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/translated_blocks.parquet").select(F.col("translated_text").alias("response"))
    return pairs.fit_ends(t)


def test_language_held_out(spark, data, model):
    """Documents are no part of the sample; a few in a hundred are indexes and keyword lists without sentences."""
    d = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet").where("lang is not null and trim(lang) <> ''").select("lang", "text").collect()
    told = [(r.lang, model.decode(r.text)[0]) for r in d]
    known = [(a, b) for a, b in told if b and a in model.languages]
    assert len(known) > 500 and sum(a == b for a, b in known) >= 0.95 * len(known)
    assert model.decode(None) == (None, 0.0) and model.decode("") == (None, 0.0) and model.decode("12 - 3") == (None, 0.0)
    lang, sure = model.decode("The committee of the royal garden found the broken lamp. " * 3_000)
    assert lang == "en" and sure > 0.9


def test_pages_and_segments(spark, model):
    en, de, es = "The museum of the royal garden kept the sea chart.", "Der Archivar der Salzgesellschaft fand die Seekarte.", "El comité de la segunda expedición abrió el inventario."
    rows = [("t", 1, "en-GB", [en, en, de], None), ("t", 2, "de", [en, en], ["paragraph", "paragraph"]), ("t", 3, None, [es, es], None), ("t", 4, "en", [None, "", "12"], None), ("t", 5, "en", None, None), ("t", 6, "English", [en, de], ["paragraph", "illustration"])]
    df = spark.createDataFrame([*rows, rows[0]], "record_table string, record_id long, source_lang string, texts array<string>, types array<string>")
    got = {(r.record_id, r.item): (r.lang, r.label) for r in language.languages(df, model).collect()}
    assert got[1, -1] == ("en", "en") and got[1, 2] == ("de", "en") and got[2, -1] == ("en", "de") and got[3, -1] == ("es", None) and got[6, -1] == ("en", "en")
    assert not {k for k in got if k[0] in (4, 5)} and (6, 1) not in got
    empty = language.Model([], [])
    assert language.languages(df, empty).isEmpty()


def test_languages_are_those_of_the_labels(spark):
    """A language that no table names is learnt from its two-letter code, once it has enough paragraphs."""
    nl = "De oude archivaris van het zoutbedrijf vond de zeekaart in de molen en de weduwe kocht het houten model na de vergadering."
    en = "The old archivist of the salt company found the sea chart in the mill and the widow bought the wooden model after the meeting."
    rows = [("t", i, f"b{i % 3}", lab, [t, t + " " + t], None) for i in range(24) for lab, t in [("nl-BE", nl) if i % 3 else ("en", en)]] + [("t", 99, "z", "sv", [en], None)]
    df = spark.createDataFrame(rows, "record_table string, record_id long, book string, source_lang string, texts array<string>, types array<string>")
    m = language.fit(df)
    assert m.languages == ["en", "nl"]
    got = {(r.record_id, r.item): r for r in language.languages(df, m).collect()}
    assert got[1, -1].lang == got[1, -1].label == "nl" and got[99, -1].lang == "en" and got[99, -1].label == "sv"


def test_ambiguous_texts_are_flagged(spark, model):
    en, de = "The museum of the royal garden kept the sea chart.", "Der Archivar der Salzgesellschaft fand die Seekarte."
    df = spark.createDataFrame([("t", 1, None, [en, de], None), ("t", 2, None, [en, en, "The museum der Salzgesellschaft kept die Seekarte of the royal Garten."], None)], "record_table string, record_id long, source_lang string, texts array<string>, types array<string>")
    got = {(r.record_id, r.item): r.ambiguous for r in language.languages(df, model).collect()}
    assert got[1, -1] and not got[2, -1] and not got[1, 0]
    unsure = language.languages(df, model, clear=1.1).where("item >= 0")
    assert unsure.count() == unsure.where("ambiguous").count() == 5


def test_codewords_are_apart():
    c = language.codewords(12)
    assert min((c[i] != c[j]).sum() for i in range(12) for j in range(i)) >= 7


def test_pair_defects(spark, model, ends):
    src = "Der Archivar der Salzgesellschaft fand die Seekarte vom Flusshafen. Die Witwe kaufte das Holzmodell nach der Sitzung. Der Drucker öffnete das Verzeichnis ohne jede Hilfe."
    right = "The archivist of the salt company found the sea chart from the river port. The widow bought the wooden model after the meeting. The printer opened the inventory without any help."
    other = "El archivero de la compañía de la sal encontró la carta marina del puerto fluvial. La viuda compró el modelo de madera después de la reunión."
    cases = [right] * 6 + [None, "", " ​", "[]", "I'm sorry, but I can't translate this passage.", "Note: Lo siento, pero no puedo traducir este texto.", src, "> " + src.replace("fand", "sah"), other, "The archivist of the salt company found", right[:75], right[:100] + "…"]
    want = [None] * 6 + ["empty"] * 4 + ["refusal"] * 2 + ["copy"] * 2 + ["wrong_language"] + ["truncated"] * 3
    df = spark.createDataFrame([("t", i, 0, src, r, "en", "x") for i, r in enumerate(cases)], "record_table string, record_id long, item int, source string, response string, due string, defect string")
    got = {r.record_id: r.defect for r in pairs.defects(df.union(df), model, ends).collect()}
    assert [got.get(i) for i in range(len(cases))] == want
    assert pairs.defects(df.where("1 = 0"), model, ends).isEmpty()
    assert unicodedata.normalize("NFC", src) == src


def test_short_copies_and_long_refusals(spark, model, ends):
    page = "Der Archivar der Salzgesellschaft fand die Seekarte vom Flusshafen."
    right = "The archivist of the salt company found the sea chart from the river port."
    no = "I am sorry, but I cannot translate this passage for you because it does not follow the rules that were given to me, and so I would ask you to send another passage that I may read and work on, or to turn to a person who knows the language well and can help you further"
    cases = [(page, right)] * 6 + [("Alte Karten", "Alte Karten"), ("Alte Karten", "Old maps"), ("12", "12"), (page, no + ".")]
    df = spark.createDataFrame([("t", i, 0, s, r, "en", page) for i, (s, r) in enumerate(cases)], "record_table string, record_id long, item int, source string, response string, due string, context string")
    assert {r.record_id: r.defect for r in pairs.defects(df, model, ends).collect()} == {6: "copy", 9: "refusal"}
    english = df.where("record_id = 6").withColumn("context", F.lit(right))
    assert pairs.defects(english, model, ends).isEmpty()


def test_good_translations_are_no_refusals(spark, model, ends):
    clean = [("Ich kann heute nicht kommen.", "I cannot come today."), ("Er wird nicht gehen.", "He will not go."), ("Es ist nicht möglich, zu gehen.", "It is not possible to go."), ("«Como máquina, no puedo ayudar», bromeó el impresor.", '"As a machine, I cannot help," joked the printer.')]
    bad = [("Der Archivar fand die Seekarte.", "I cannot translate this text."), ("Der Archivar fand die Seekarte.", "Unable to comply with this request.")]
    bad.append((clean[3][0] + " Der Archivar der Salzgesellschaft fand die Seekarte vom Flusshafen, und die Witwe kaufte das Holzmodell nach der Sitzung.", "I cannot translate this text."))
    assert not any(pairs.refuses(s, r) for s, r in clean) and all(pairs.refuses(s, r) for s, r in bad)


def test_copies_come_first(spark, model, ends):
    """A copy is one even if the model cannot tell its language."""
    undecided = language.Model(["the old mill"] * 3 + ["die alte Mühle"] * 3, ["en"] * 3 + ["de"] * 3)
    undecided.decode = lambda t: ("de", 1.0) if t and t.startswith("Der Archivar") and len(t) > 100 else (None, 0.0)
    src = "Der Archivar der Salzgesellschaft fand die Seekarte vom Flusshafen."
    assert pairs.measure(undecided, ends, src, src, "en", src * 2)[0] == "copy"
    assert pairs.measure(undecided, ends, src, src, "de", src * 2)[0] is None


def test_ends_of_held_out_texts(spark, data):
    texts = [r[0] for r in spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/corpus_pages.parquet").select(F.explode("target")).distinct().collect() if r[0] and len(r[0]) > 60 and r[0].rstrip()[-1] in ".!?"]
    half = len(texts) // 2
    e = pairs.Ends(texts[:half])
    rng = random.Random(3)
    told = [e.score(t) < 0 for t in texts[half:]] + [e.score(" ".join(w[: rng.randrange(4, len(w) - 2)])) > 0 for t in texts[half:] if len(w := t.split()) > 8]
    assert sum(told) > 0.9 * len(told)
    zero = pairs.Ends([])
    assert zero.score("It ends here.") == 0.0
