"""Time of a run by category, a stopwatch that can be paused, and a harness of cold, warm and corrected runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators.intervals import union_total
from pagelake.operators.stages import union_ns
from pagelake.session import cut

#: What time is spent on; the rest of the wall time is deterministic work.
CATEGORIES = ("model_execution", "durable_persistence")
SPANS = "run string, category string, start long, end long"


class Stopwatch:
    """Nanoseconds while it runs; pauses are left out."""

    def __init__(self, clock: Callable[[], int] = time.perf_counter_ns):
        self.clock, self.total, self.since = clock, 0, None

    def start(self) -> None:
        if self.since is None:
            self.since = self.clock()

    def pause(self) -> int:
        if self.since is not None:
            self.total += self.clock() - self.since
            self.since = None
        return self.total


class Ledger:
    """Spans of one run by category; spans of one category that overlap count once. ``off`` keeps nothing."""

    def __init__(self, run: str = "run", clock: Callable[[], int] = time.perf_counter_ns, off: bool = False):
        self.run, self.clock, self.off, self.began, self.spans = run, clock, off, clock(), []

    @contextmanager
    def measure(self, category: str) -> Iterator[None]:
        if category not in CATEGORIES:
            raise ValueError(f"the categories are {', '.join(CATEGORIES)}")
        a = self.clock()
        try:
            yield
        finally:
            if not self.off:
                self.spans.append((self.run, category, a, max(a, self.clock())))

    def report(self) -> dict[str, int]:
        """Nanoseconds by category, the whole wall time, and of it the deterministic rest (in no category)."""
        wall = self.clock() - self.began
        out = {c: union_ns([(a, b) for _, k, a, b in self.spans if k == c]) for c in CATEGORIES}
        any_ = union_ns([(a, b) for _, _, a, b in self.spans])
        return out | {"whole_wall": wall, "deterministic": wall - any_}

    def table(self, spark: SparkSession) -> DataFrame:
        """The spans as (run, category, start, end)."""
        return spark.createDataFrame(self.spans, SPANS)


def totals(spans: DataFrame) -> DataFrame:
    """(run, category, islands, total) of spans of any number of runs."""
    s = spans.withColumn("key", F.concat_ws("/", "run", "category"))
    return union_total(s, "key", "start", "end").select(F.substring_index("key", "/", 1).alias("run"), F.substring_index("key", "/", -1).alias("category"), "islands", "total")


def memo_runs(requests: DataFrame, corrected: DataFrame, key: str, request: str, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(run, calls, hits, same): a cold run, a warm one and one after a correction, through one memo.

    call: (key, request) to (key, request, result). A run calls only for requests that the memo does not have; the warm run must call for none,
    the corrected one for the changed requests only. same: rows whose result is that of the cold run.
    """
    spark = requests.sparkSession
    memo: DataFrame | None = None
    first: DataFrame | None = None
    rows = []
    for name, asked in (("cold", requests), ("warm", requests), ("corrected", corrected)):
        q = cut(asked.select(key, request).distinct())
        todo = q if memo is None else q.join(memo.select(request), request, "left_anti")
        made = cut(call(todo).select(request, "result").distinct())
        calls = todo.select(request).distinct().count()
        memo = made if memo is None else cut(memo.unionByName(made))
        got = cut(q.join(memo, request, "left"))
        first = got if first is None else first
        same = got.select(key, "result").join(first.select(key, F.col("result").alias("was")), key).where(F.col("result").eqNullSafe(F.col("was"))).count()
        rows.append((name, calls, q.select(request).distinct().count() - calls, same))
    return spark.createDataFrame(rows, "run string, calls long, hits long, same long")
