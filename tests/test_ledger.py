"""Timing ledger, stopwatch, memo runs, sealed manifests and settings of a run."""

import pytest
from pyspark.sql import functions as F

from pagelake.operators import ledger, memo


class Clock:
    def __init__(self):
        self.now = 0

    def __call__(self):
        return self.now


def test_ledger_counts_overlaps_once(spark):
    clock = Clock()
    watch = ledger.Stopwatch(clock)
    book = ledger.Ledger("r", clock)
    watch.start()
    with book.measure("model_execution"):
        clock.now = 10
        with book.measure("model_execution"):
            clock.now = 15
        with book.measure("durable_persistence"):
            clock.now = 25
    assert watch.pause() == 25 == watch.pause()
    clock.now = 40
    assert book.report() == {"model_execution": 25, "durable_persistence": 10, "whole_wall": 40, "deterministic": 15}
    watch.start()
    clock.now = 42
    assert watch.pause() == 27
    got = {r.category: (r.islands, r.total) for r in ledger.totals(book.table(spark)).collect()}
    assert got == {"model_execution": (1, 25), "durable_persistence": (1, 10)}
    with pytest.raises(ValueError), book.measure("other"):
        pass
    off = ledger.Ledger("r", clock, off=True)
    with off.measure("model_execution"):
        clock.now = 50
    assert off.report()["model_execution"] == 0 and ledger.totals(off.table(spark)).isEmpty()


def test_warm_runs_call_for_nothing(spark):
    ask = spark.createDataFrame([(i, f"t{i % 4}") for i in range(10)], "k int, q string")
    fixed = ask.withColumn("q", F.when(F.col("k") == 3, "new").otherwise(F.col("q")))
    got = {r.run: (r.calls, r.hits, r.same) for r in ledger.memo_runs(ask, fixed, "k", "q", lambda d: d.withColumn("result", F.upper("q"))).collect()}
    assert got == {"cold": (4, 0, 10), "warm": (0, 4, 10), "corrected": (1, 4, 9)}


def test_manifest_does_not_depend_on_partitions(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), F.concat(F.lit("c"), "id").alias("c"))
    whole = memo.manifest(df, "k", "c").first()
    assert whole.members == 500 and memo.manifest(df.repartition(7), "k", "c").first() == whole
    monkeypatch.setattr(memo, "STRETCH", 16)
    small = memo.manifest(df, "k", "c").first()
    assert small.members == 500 and small.hash == memo.manifest(df.repartition(5), "k", "c").first().hash
    assert memo.manifest(df.withColumn("c", F.when(F.col("k") == "7", "x").otherwise(F.col("c"))), "k", "c").first().hash != small.hash
    assert memo.manifest(df.limit(0), "k", "c").first().members == 0


def test_pointer_is_swapped_on_any_file_system(spark, tmp_path):
    at = f"file://{tmp_path}/pointer"
    assert memo.active(at, spark) is None
    for r in ("r1", "r2"):
        memo.activate(at, r, spark)
        assert memo.active(at, spark) == r
    assert [p.name for p in tmp_path.iterdir() if "part" in p.name and not p.name.startswith(".")] == []
