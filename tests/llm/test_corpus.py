"""Packing, leakage, mixing and spam: brute force, bounds and fixed cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import fmindex, leakage, mixing, packing, spam


@pytest.mark.parametrize("first", [True, False])
@pytest.mark.parametrize("seed", range(4))
def test_histogram_packs_all_within_capacity(seed, first):
    rng = random.Random(seed)
    h = {rng.randrange(0, 101): rng.randrange(1, 40) for _ in range(30)}
    packs = packing.pack_histogram(h, 100, first)
    used: dict = {}
    for n, p in packs:
        assert sum(p) <= 100 and n > 0
        for x in p:
            used[x] = used.get(x, 0) + n
    assert used == h
    assert sum(n for n, _ in packs) <= 1.25 * -(-sum(k * v for k, v in h.items()) // 100) + 2


def test_pack_items(spark):
    rng = random.Random(1)
    items = [("a", i, [rng.randrange(1, 60) for _ in range(rng.randrange(1, 4))]) for i in range(300)]
    items += [("b", 1, [90, 90, 30]), ("b", 2, [250]), ("b", 3, None), ("b", 4, [None, 5]), (None, 5, [7]), ("b", None, [7]), ("c", 6, []), ("d", 7, [100]), ("d", 8, [100])]
    df = spark.createDataFrame([*items, items[0], items[-1]], "key string, id long, entries array<int>")
    got = packing.pack_items(df.withColumn("size", F.lit(0)).withColumn("batch", F.lit(0)), 100).collect()
    size, parts = {}, {}
    for r in got:
        size[r.key, r.batch] = size.get((r.key, r.batch), 0) + r["size"]
        parts.setdefault((r.key, r.id), []).append((r.part, r["size"], r.batch))
    assert max(size.values()) <= 100
    want = {(k, i): sum(x or 0 for x in e or []) for k, i, e in items if i is not None}
    assert {k: sum(p[1] for p in v) for k, v in parts.items()} == want
    assert all((len(v) > 1) == (want[k] > 100) == (len({x[2] for x in v}) > 1) for k, v in parts.items())
    assert len(got) == sum(len(v) for v in parts.values()) == len({(r.key, r.id, r.part) for r in got})
    assert [p[1] for p in sorted(parts["b", 1])] == [90, 90, 30] and [p[1] for p in sorted(parts["b", 2])] == [100, 100, 50]
    least = -(-sum(v for (k, _), v in want.items() if k == "a") // 100)
    assert sum(k == "a" for k, _ in size) <= least * 1.15 + 1
    assert packing.pack_items(df.where("1 = 0"), 100).isEmpty()


def test_a_length_of_most_items_meets_few_ranges(spark):
    df = spark.range(3_000).select(F.lit("a").alias("key"), "id", F.array(F.when(F.col("id") % 7 == 0, 30).otherwise(25).cast("int")).alias("entries"))
    got = packing.pack_items(df, 100)
    sizes = got.groupBy("batch").agg(F.sum("size").alias("n"), F.count("*").alias("k")).collect()
    assert got.count() == 3_000 and max(r.n for r in sizes) <= 100 and len(sizes) <= 3_000 / 3.6


def test_p4_found_reads_the_plan(spark, data, monkeypatch):
    df = packing.p4_found(spark, data)
    assert not df.isEmpty()
    monkeypatch.setattr(packing, "pack_items", lambda items: spark.createDataFrame([("b", 1, 0, 5, 0), ("b", 1, 1, 5, 1), ("b", 2, 0, 5, 1)], "key string, id long, part int, size int, batch long"))
    assert [r[0] for r in packing.p4_found(spark, data).collect()] == [1]


def test_leaks_with_every_fourth_word_changed(spark):
    """What AGREE allows is found, whatever the pattern of changes."""
    rng = random.Random(12)
    item = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    docs = {}
    for k in range(4):
        docs[k] = [f"x{n}" if n % 4 == k else w for n, w in enumerate(item)]
    docs[4] = [x for n, w in enumerate(item) for x in ([f"y{n}", w] if n % 4 == 0 else [w])]
    docs[5] = [w for n, w in enumerate(item) if n % 5]
    docs[6] = [f"x{n}" if n % 2 else w for n, w in enumerate(item)]
    docs[7] = item[:21] + ["end"]
    docs[8] = item[:14] + ["end"]
    d = spark.createDataFrame([(k, "so it said: " + " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    got = {r.doc_id for r in leakage.leaks(d, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {0, 1, 2, 3, 4, 5, 7}


@pytest.mark.parametrize("seed", range(3))
def test_fm_index_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(1, 5, 400)
    f = fmindex.FMIndex(s, 5, every=7)
    for k in (1, 2, 4):
        p = np.concatenate((np.array([s[i : i + k] for i in rng.integers(0, 390, 20)]), rng.integers(1, 6, (10, k))))
        which, at = f.locate(*f.search(p))
        got = sorted(zip(which.tolist(), at.tolist()))
        want = sorted((n, i) for n, q in enumerate(p) for i in range(len(s) - k + 1) if (s[i : i + k] == q).all())
        assert got == want
    assert fmindex.FMIndex(np.array([], np.int64), 1).search(np.array([[1]]))[0][0] >= 0


ITEM = "The archivist found the copper plate in the mill. The widow measured a sea chart before winter. Nobody opened the broken lamp near the river port, although the clerks copied a bundle of letters."


def test_leaks(spark):
    half = ITEM[: len(ITEM) // 2]
    filler = "Every plain garden beside the long wall had been planted by the painters on the third day. "
    docs = {
        1: filler + half + filler, 2: filler + half.upper().replace(".", ""), 3: filler + half.replace("copper", "silver").replace(" ", "\n"), 4: filler + ITEM[:40], 5: filler,
        6: None, 7: "", 8: '{"text": "' + half.replace(" ", " \\n") + '"}', 9: filler + half.replace("measured", "mea-\nsured").replace("é", "é"), 10: filler * 400 + ITEM, 11: "Question: who found the lamp?", 12: filler + "Read the text below.",
    }
    items = [(1, "Read the text below.\n" + ITEM + "\nQuestion: who found the lamp?"), (2, "Read the text below.\nSomething else entirely about nothing at all in these pages."), (3, None), (4, "")]
    d = spark.createDataFrame([(k, t, k) for k, t in docs.items()] + [(1, docs[1], 1)], "doc_id long, text string, item_id long")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = leakage.leaks(d, i)
    assert sorted({(r.doc_id, r.item_id) for r in got.collect()}) == [(k, 1) for k in (1, 2, 3, 8, 9, 10)]
    small = leakage.leaks(d, i, shard=150)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == {(k, 1) for k in (1, 2, 3, 8, 9, 10)}
    # one block for each item: the rows stay, instruction lines are told by all items
    parts = leakage.leaks(d, i, part=1)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, got.collect()))
    spans = {r.doc_id: r for r in leakage.removal_spans(got).collect()}
    assert docs[1][spans[1].start : spans[1].end].startswith("The archivist found") and spans[1].item_ids == [1]
    assert leakage.leaks(d.where("1 = 0"), i).isEmpty() and leakage.leaks(d, i.where("1 = 0")).isEmpty()


def test_route_is_least_cost_and_full():
    room = {("a",): {"a": 10}, ("a", "b"): {"a": 10, "b": 10}, ("c",): {"c": 4}}
    once, repeats = {p: max(r.values()) for p, r in room.items()}, {"a": 2, "b": 1, "c": 3}
    got = mixing.route(room, once, {"a": 12, "b": 8, "c": 20}, repeats)
    by: dict = {}
    for (p, s), n in got.items():
        assert 0 < n <= room[p][s] * repeats[s]
        by[s] = by.get(s, 0) + n
    assert by == {"a": 12, "b": 8, "c": 12}
    # the shared text is used once at most: b needs 8 of it, so a takes no more than 2 and its own for the rest
    assert got[("a",), "a"] == 10 and got[("a", "b"), "a"] == 2 and got[("a", "b"), "b"] == 8
    # nobody loses what only he can use, however many copies there are
    many = mixing.route({("a", "b"): {"a": 5_000, "b": 10}}, {("a", "b"): 10}, {"a": 100_000, "b": 10}, {"a": 3, "b": 1})
    assert many == {(("a", "b"), "a"): 15_000, (("a", "b"), "b"): 10}


def _records(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, text string, size int")


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("aaab"), f"t{i}", rng.randrange(1, 50)) for i in range(2_000)] + [(5_000, "a", "both", 40), (5_005, "c", "both", 40), (5_001, None, "x", 9), (5_002, None, None, 9), (5_003, "b", "y", None), (5_004, "zz", "z", 70)]
    d = _records(spark, rows).withColumn("pattern", F.lit("clash"))
    targets = [("a", 0.4, 3), ("b", 0.5, 2), ("c", 0.1, 4), (None, 0.0, 1)]
    t = spark.createDataFrame([*targets, targets[0]], "source string, target_share double, max_repeats int")
    mixture, shares = mixing.mix(d, t)
    got = {r.source: r for r in shares.collect()}
    total = sum(x[3] or 0 for x in rows)
    assert abs(got["a"].share - 0.4) < 0.01 and not got["a"].short
    have = sum(x[3] or 0 for x in rows if x[1] == "b")
    assert got["b"].short == (have * 2 < 0.5 * total) and got["c"].short and got["c"].tokens == 160
    assert max(r.uses for r in mixture.where("source = 'b'").collect()) <= 2
    used = mixture.groupBy("source").agg(F.sum(F.col("uses") * F.col("size")).alias("n")).collect()
    assert {r.source: r.n for r in used} == {s: r.tokens for s, r in got.items() if r.tokens}
    assert sorted(map(tuple, mixture.collect())) == sorted(map(tuple, mixing.mix(d.repartition(3), t)[0].collect()))
    assert all(r.share == 0 for r in mixing.mix(d.where("1 = 0"), t)[1].collect())
    # beyond the patterns that the driver may hold each source has its own, with the same shares due
    assert {r.source: (r.short, r.quota, r.available) for r in mixing.mix(d, t, patterns=1)[1].collect()} == {s: (r.short, r.quota, r.available) for s, r in got.items()}


def test_a_shared_text_is_used_once_before_any_is_used_twice(spark):
    d = _records(spark, [(1, "a", "one", 10), (2, "b", "one", 10), (3, "a", "two", 10), (4, "b", "three", 10)])
    t = spark.createDataFrame([("a", 0.25, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    assert {(r.id, r.source, r.uses) for r in mixing.mix(d, t)[0].collect()} == {(3, "a", 1), (2, "b", 1), (4, "b", 1)}


def test_mixture_does_not_depend_on_the_number_of_patterns(spark):
    d = _records(spark, [(1, "a", "one", 10), (2, "b", "one", 10), (3, "a", "two", 10), (4, "b", "three", 10), (5, "b", "four", 10), (6, "c", "four", 10), (7, "y", "five", 10), (8, "z", "five", 10)])
    t = spark.createDataFrame([("a", 0.125, 2), ("b", 0.25, 2), ("c", 0.125, 2)], "source string, target_share double, max_repeats int")
    with pytest.warns(UserWarning, match="2 patterns"):
        mixture, shares = mixing.mix(d, t, patterns=1)
    text = {1: "one", 2: "one", 3: "two", 4: "three", 5: "four", 6: "four"}
    used = [text[r.id] for r in mixture.collect() for _ in range(r.uses)]
    assert sorted(used) == ["four", "one", "three", "two"]
    whole = mixing.mix(d, t)
    assert sorted(map(tuple, mixture.collect())) == sorted(map(tuple, whole[0].collect()))
    assert sorted(map(tuple, shares.collect())) == sorted(map(tuple, whole[1].collect()))


def test_short_follows_the_flow(spark, monkeypatch):
    d = _records(spark, [(1, "a", "x", 10), (2, "b", "y", 90)])
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    assert {r.source: r.short for r in mixing.mix(d, t)[1].collect()} == {"a": True, "b": False}
    monkeypatch.setattr(mixing, "route", lambda room, once, quota, repeats: {((s,), s): q for s, q in quota.items()})
    assert not any(r.short for r in mixing.mix(d, t)[1].collect())
    # 10.4 tokens are due, rounded to the 10 that there are
    monkeypatch.undo()
    t = spark.createDataFrame([("a", 0.104, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(d, t)[1].first().short


def test_token_count_is_exact(spark):
    import tiktoken  # noqa: F401

    df = spark.createDataFrame([("Hello world <|endoftext|>",), ("",), (None,), ("x" * 20_000,)], "t string")
    got = [r[0] for r in df.select(mixing.token_count(F.col("t"))).collect()]
    assert got[0] == 2 + 7 and got[1] == got[2] == 0 and got[3] > 0


def test_repeats_by_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        s = [rng.choice("abc") for _ in range(rng.randrange(1, 24))]
        want = []
        for i in range(len(s)):
            best = 0
            for n in range(1, i + 2):
                x = s[i - n + 1 : i + 1]
                if sum(s[j : j + n] == x for j in range(len(s) - n + 1)) > 1:
                    best = n
            want.append(best)
        assert spam.repeats(s) == want


def test_repeats_from_repeated_pairs():
    rng = random.Random(9)
    for _ in range(200):
        s = [rng.choice("abcdef") for _ in range(rng.randrange(0, 40))]
        assert spam.repeated_ends(s) == [k if k > 1 else 0 for k in spam.repeats(s)]


def test_repeats_of_long_pages():
    rng = random.Random(8)
    for _ in range(60):
        s = [rng.choice("abc") for _ in range(rng.randrange(1, 40))]
        assert spam.repeats_of_long(s) == spam.repeats(s)
    n, bare, under, cov, _ = spam.measure(" ".join(f"w{i}" for i in range(60_000)) + " " + " ".join(f"w{i}" for i in range(60_000)))
    assert n == bare == under == cov


def test_wide_stuffing_is_no_clause():
    stuffed = "羊毛毯子批发，羊毛毯子价格，羊毛毯子厂家，羊毛毯子报价。"
    prose = "老馆长在冬天之前把那张海图放进木箱。没有人打开河边的旧灯，尽管寡妇已经量过它。"
    n, bare, under, _, _ = spam.measure(stuffed * 6)
    assert bare > spam.BARE_SHARE * n and under > spam.SPAM_SHARE * bare
    assert spam.measure(prose * 3)[1] == 0


def test_spam(spark):
    prose = "The old clerks kept a wooden lamp near the river. Nobody opened the garden, although the widow measured it. In 1847 the painters drained seven ponds."
    docs = {
        1: ", ".join(["wool blanket", "Wool Blanket deals", "wool blanket buy"] * 12), 2: "\n".join(f"https://shop{i}.example/a-{i}" for i in range(30)), 3: prose + "\n\n" + " ".join(["glass lens price", "oak ladder price"] * 40),
        4: "\n".join(f"#tag{i}" for i in range(40)), 5: "Our oak ladder is the oak ladder for oak ladder buyers. " * 12,
        10: prose, 11: "INDEX\n" + "\n".join(f"{w}, {n}, {n + 7}" for n, w in enumerate(sorted(["lamp", "atlas", "bridge", "canal", "desert", "engine", "ferry"]))), 12: "CONTENTS\n" + "\n".join(f"Chapter {i}. The garden ........ {i * 9}" for i in range(1, 20)),
        13: prose + "\n\nSee also:\nhttps://archive.example/a\nhttps://archive.example/b", 14: (prose + "\nAs the record shows, a meadow was kept by the teachers.\n") * 3, 15: None, 16: "", 17: prose.replace(".", "").replace(",", ""), 18: "...",
    }
    df = spark.createDataFrame([(k, t, True) for k, t in docs.items()] + [(1, docs[1], True)], "doc_id long, text string, is_spam boolean")
    got = spam.spam_pages(df, "doc_id", "text")
    assert got.count() == len(docs)
    assert {r.doc_id for r in got.where("is_spam").collect()} == {1, 2, 3, 4, 5}
    assert spam.spam_pages(df.where("1 = 0"), "doc_id", "text").isEmpty()
    assert spam.measure("wool blanket " * 70_000)[3] > 700_000
