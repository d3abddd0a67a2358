"""Stages of a run: what each needs and gives, its time, and a report; one stage's failure is a finding of the run."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import ids
from pagelake.operators import corpus, memo, quality, render, terms
from pagelake.operators.effective import effective_segments


@dataclass(frozen=True)
class Stage:
    """A named step from tables to tables; ``gives`` are written before the next stage begins."""

    name: str
    needs: tuple[str, ...]
    gives: tuple[str, ...]
    run: Callable[..., dict[str, DataFrame]]


@dataclass
class Report:
    """What a run did: per stage its status, rows and milliseconds."""

    mode: str
    stages: list[dict] = field(default_factory=list)

    @property
    def status(self) -> str:
        return "degraded" if any(s["status"] != "ok" for s in self.stages) else "ok"

    def to_json(self) -> str:
        return json.dumps({"mode": self.mode, "status": self.status, "stages": self.stages}, sort_keys=True)


def union_ns(spans: list[tuple[int, int]]) -> int:
    """Total length of intervals, overlaps counted once."""
    total, until = 0, None
    for a, b in sorted(spans):
        if until is None or a > until:
            total, until = total + b - a, b
        elif b > until:
            total, until = total + b - until, b
    return total


def run_stages(spark: SparkSession, stages: list[Stage], tables: dict[str, DataFrame], folder: str, mode: str = "native") -> tuple[dict[str, DataFrame], Report]:
    """The tables after all stages, and the report. Each output is written under ``folder`` and read back, so a lost executor costs no earlier stage.

    A stage whose needs are missing, or that fails, is reported and skipped; later stages that need its tables are skipped too.
    """
    report = Report(mode)
    have = dict(tables)
    for s in stages:
        began = time.perf_counter_ns()
        row = {"stage": s.name, "status": "ok", "rows": {}}
        lacking = [n for n in s.needs if n not in have]
        try:
            if lacking:
                raise LookupError(f"missing {', '.join(lacking)}")
            out = s.run(**{n: have[n] for n in s.needs})
            if set(out) != set(s.gives):
                raise ValueError(f"the stage gives {sorted(out)}, not {sorted(s.gives)}")
            for name, df in out.items():
                df.write.mode("overwrite").parquet(f"{folder}/{s.name}/{name}")
                have[name] = spark.read.parquet(f"{folder}/{s.name}/{name}")
                row["rows"][name] = have[name].count()
        except Exception as e:  # noqa: BLE001 - reported, and the run goes on
            row |= {"status": "skipped" if lacking else "failed", "error": f"{type(e).__name__}: {str(e)[:300]}"}
        row["ms"] = (time.perf_counter_ns() - began) // 1_000_000
        report.stages.append(row)
    return have, report


def _segments(pages: DataFrame) -> dict[str, DataFrame]:
    one = corpus.once(pages, "extraction_id")
    b = corpus.blocks(one, "extraction_id")
    s = corpus.segments(b, "extraction_id", ids.anchor(F.col("type"), F.col("reading_order") + 1, F.col("text")))
    s = s.join(one.select("extraction_id", "book_id", "page_number", "source_lang"), "extraction_id")
    n = one.groupBy("book_id").agg(F.count("*").alias("pages")).withColumn("status", F.lit("ok"))
    none = one.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("book_id"), F.lit(0).cast("long").alias("pages"), F.lit("empty_input").alias("status"))
    ident = F.coalesce("anchor", F.lit("diagnostic"))
    return {"segments": s.withColumn("segment_id", ids.segment_id(F.col("extraction_id").cast("string"), ident)), "run_status": n.unionByName(none)}


def _terms(segments: DataFrame) -> dict[str, DataFrame]:
    rows = segments.where("text is not null")
    return {"phrases": terms.phrases(rows, ["segment_id"], within="book_id"), "technical": terms.technical_words(rows, ["book_id", "segment_id"])}


def _checks(effective: DataFrame) -> dict[str, DataFrame]:
    return {"findings": quality.run_rules(effective.sparkSession, quality.effective_rules(effective, "extraction_id", "segment_id", "effective_text", "render_lang"))}


def core() -> list[Stage]:
    """The stages from pages to checked content: segments, terms, effective content, findings. An empty input gives one diagnostic row."""
    return [
        Stage("segments", ("pages",), ("segments", "run_status"), _segments),
        Stage("terms", ("segments",), ("phrases", "technical"), _terms),
        Stage("effective", ("segments",), ("effective",), lambda segments: {"effective": effective_segments(segments, None, [], "source_lang")}),
        Stage("checks", ("effective",), ("findings",), _checks),
    ]


def tail(folder: str, revision: str) -> list[Stage]:
    """The stages from content to a sealed revision under ``folder``: books, then members with their manifest; sealing activates nothing."""

    def books(effective: DataFrame) -> dict[str, DataFrame]:
        rows = effective.select("book_id", "page_number", F.col("kind").alias("type"), F.col("effective_text").alias("text"), "reading_order", F.col("segment_id").alias("item"), "render_lang")
        pages = render.xhtml(rows, ["book_id", "page_number"], "render_lang")
        langs = rows.groupBy("book_id", "page_number").agg(F.min("render_lang").alias("lang"))
        return {"book_files": render.books(pages.join(langs, ["book_id", "page_number"]), "book_id", "page_number", f"{folder}/books/{revision}", "lang")}

    def seal(effective: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
        content = effective.select(F.col("segment_id").alias("id"), F.to_json(F.struct("extraction_id", "kind", "reading_order", "effective_text", "render_lang")).alias("content"))
        notes = findings.groupBy("subject", "rule").agg(F.min("detail").alias("d")).select(F.concat_ws("/", F.lit("finding"), "rule", "subject").alias("id"), F.coalesce("d", F.lit("")).alias("content"))
        got = memo.seal(content.unionByName(notes), folder, revision, "id", "content")
        return {"revision": effective.sparkSession.createDataFrame([(revision, got)], "revision string, hash string")}

    return [Stage("render", ("effective",), ("book_files",), books), Stage("seal", ("effective", "findings"), ("revision",), seal)]
